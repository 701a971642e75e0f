"""Whole-table summaries and the full profile."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import col, family, numeric_columns, text_columns
from tallyframe.operators.aggregate import auto_group
from tallyframe.operators.outliers import outlier_counts
from tallyframe.operators.text import text_analysis

from .correlation import correlation_matrix, strong_pairs
from .frequencies import categorical_profile, category_counts, top_categories
from .statistics import distinct_counts, missing_counts, moments, numeric_profile, pct, quantile_rows


def _kind(df: DataFrame, name: str) -> str:
    return {
        "integer": "numeric",
        "float": "numeric",
        "text": "categorical",
        "datetime": "datetime",
        "timedelta": "datetime",
    }.get(family(df.schema[name].dataType), "other")


def dataset_summary(df: DataFrame) -> DataFrame:
    """``section, name, value``: rows, columns, columns per kind, missing per column and in total."""
    kinds = [_kind(df, c) for c in df.columns]
    facts = [("shape", "columns", len(df.columns))]
    facts += [("kind", k, kinds.count(k)) for k in ("numeric", "categorical", "datetime", "other")]
    fixed = df.sparkSession.createDataFrame(facts, "section string, name string, value bigint")
    counted = missing_counts(df)
    parts = [
        fixed,
        counted.select(F.lit("missing").alias("section"), F.col("column").alias("name"), F.col("missing_count").alias("value")),
        counted.agg(F.max("row_count").alias("value")).select(F.lit("shape").alias("section"), F.lit("rows").alias("name"), "value"),
        counted.agg(F.sum("missing_count").alias("value")).select(
            F.lit("total").alias("section"), F.lit("missing_cells").alias("name"), "value"
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def column_kinds(df: DataFrame) -> DataFrame:
    """``position, column, dtype, kind`` from the schema alone."""
    return df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), _kind(df, f.name)) for i, f in enumerate(df.schema.fields)],
        "position int, `column` string, dtype string, kind string",
    )


def column_analysis(df: DataFrame, top_n: int = 5, exact: bool = True) -> DataFrame:
    """One row per column: range, centre, spread and outliers of numbers; distinct, mode and top values of the rest."""
    numbers = numeric_columns(df)
    others = [c for c in df.columns if c not in numbers]
    base = missing_counts(df)
    out = base.select(
        "position",
        "column",
        F.col("missing_count").alias("missing"),
        pct(F.col("missing_count"), F.col("row_count")).alias("missing_pct"),
    )
    if numbers:
        measured = moments(df, numbers).select("column", "min", "max", "mean", "std")
        counted = outlier_counts(df, numbers, exact=exact)
        medians = quantile_rows(df, numbers, {"median": 0.5}, exact)
        facts = measured.join(F.broadcast(counted), "column").join(medians, "column")
        out = out.join(F.broadcast(facts), "column", "left")
    else:
        for c in ("min", "max", "mean", "std", "q1", "q3", "median"):
            out = out.withColumn(c, F.lit(None).cast("double"))
        out = out.withColumn("outlier_count", F.lit(None).cast("bigint"))
    if others:
        counts = category_counts(df, others)
        tops = top_categories(counts, top_n).groupBy("column").agg(
            F.array_sort(F.collect_list(F.struct("rank", "value", "count"))).alias("_tops")
        )
        unique = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique_values"))
        out = out.join(F.broadcast(tops.join(unique, "column")), "column", "left")
    else:
        out = out.withColumn("_tops", F.lit(None).cast("array<struct<rank:int,value:string,count:bigint>>")).withColumn(
            "unique_values", F.lit(None).cast("bigint")
        )
    return (
        out.orderBy("position")
        .select(
            "column", "missing", "missing_pct", "min", "max", "mean", "median", "std", "q1", "q3", "outlier_count",
            "unique_values",
            F.get("_tops", F.lit(0))["value"].alias("mode"),
            F.get("_tops", F.lit(0))["count"].alias("mode_count"),
            F.array_join(
                F.transform("_tops", lambda t: F.concat(t["value"], F.lit("="), t["count"].cast("string"))), ", "
            ).alias("top_values"),
        )
    )


def numeric_limited(df: DataFrame, max_cols: int = 15, exact: bool = True) -> DataFrame:
    """Profile of the ``max_cols`` numeric columns with the most outliers."""
    names = numeric_columns(df)
    if len(names) > max_cols:
        counts = {r["column"]: r["outlier_count"] for r in outlier_counts(df, names, exact=exact).collect()}
        names = sorted(names, key=lambda c: -counts[c])[:max_cols]
    shown = moments(df, names).join(quantile_rows(df, names, {"median": 0.5}, exact), "column")
    missing = F.col("row_count") - F.col("count")
    return shown.orderBy("position").select(
        "column",
        missing.alias("missing"),
        F.round(F.try_divide(missing, F.col("row_count")) * 100, 1).alias("missing_pct"),
        "min", "max", "mean", "median", "std",
    )


def summary_flags(df: DataFrame, many: int = 10, exact: bool = True) -> DataFrame:
    """``flag, name, value``: columns per data type, texts with many distinct values, numbers with outliers."""
    types: dict[str, int] = {}
    for f in df.schema.fields:
        types[f.dataType.simpleString()] = types.get(f.dataType.simpleString(), 0) + 1
    parts = [
        df.sparkSession.createDataFrame(
            [("columns_of_type", t, n) for t, n in types.items()], "flag string, name string, value bigint"
        )
    ]
    texts = text_columns(df)
    if texts:
        parts.append(
            distinct_counts(df, texts, exact)
            .where(F.col("unique_count") > many)
            .select(F.lit("many_distinct").alias("flag"), F.col("column").alias("name"), F.col("unique_count").alias("value"))
        )
    if numeric_columns(df):
        parts.append(
            outlier_counts(df, exact=exact)
            .where("outlier_count > 0")
            .select(F.lit("has_outliers").alias("flag"), F.col("column").alias("name"), F.col("outlier_count").alias("value"))
        )
    return reduce(DataFrame.unionByName, parts)


def full_profile(
    df: DataFrame, free_text: Sequence[str] = (), exact: bool = True, corr_threshold: float = 0.7
) -> dict[str, DataFrame]:
    """Every part of the analysis as a table of its own. Declared free text is analysed as text, not as categories."""
    numbers = numeric_columns(df)
    texts = [c for c in text_columns(df) if c not in free_text]
    out = {"summary": dataset_summary(df)}
    if numbers:
        out["numeric"] = numeric_profile(df, numbers, exact)
    if texts:
        out["categorical"] = categorical_profile(df, texts)
    if len(numbers) >= 2:
        matrix = correlation_matrix(df, "pearson", numbers)
        out["correlation"] = matrix
        out["strong_correlation"] = strong_pairs(matrix, numbers, corr_threshold)
    if numbers and texts:
        grouped = auto_group(df, exact)
        if grouped is not None:
            out["group"] = grouped
    declared = [c for c in free_text if c in df.columns]
    if declared:
        out |= {f"text_{k}": t for k, t in text_analysis(df, declared).items()}
    return out


def long_form(tables: dict[str, DataFrame]) -> DataFrame:
    """``part, row, name, value``: several result tables flattened into one, a cell per row."""
    flat = []
    for part, table in tables.items():
        cells = F.array(*[F.struct(F.lit(c).alias("name"), col(c).cast("string").alias("value")) for c in table.columns])
        flat.append(
            table.select(F.lit(part).alias("part"), F.monotonically_increasing_id().alias("row"), F.inline(cells))
        )
    return reduce(DataFrame.unionByName, flat)


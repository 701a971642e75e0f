"""Missing values: dropping, filling and profiling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import col, family, is_missing, known
from tallyframe.functions.columns import as_double, present, with_values
from tallyframe.plans.quantiles import table_quantiles
from tallyframe.plans.statistics import missing_counts, pct


def columns_over_threshold(df: DataFrame, columns: Sequence[str] | None, threshold: float) -> list[str]:
    names = df.columns if columns is None else known(df, columns)
    if not names:
        return []
    counted = missing_counts(df, names).collect()
    over = {r["column"] for r in counted if r["row_count"] and r["missing_count"] / r["row_count"] > threshold}
    return [c for c in names if c in over]


def drop_missing_rows(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Drop rows with a gap in any column that has more than ``threshold`` of its values missing."""
    over = columns_over_threshold(df, columns, threshold)
    return reduce(lambda d, c: d.where(~is_missing(df, c)), over, df)


def drop_missing_columns(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.5) -> DataFrame:
    over = set(columns_over_threshold(df, columns, threshold))
    return df.select([col(c) for c in df.columns if c not in over])


def most_frequent(df: DataFrame, column: str) -> Any:
    """The most frequent value; among equals the smallest. Every value is counted, none is sampled."""
    row = (
        df.where(~is_missing(df, column))
        .groupBy(col(column).alias("v"))
        .count()
        .orderBy(F.desc("count"), F.asc("v"))
        .limit(1)
        .first()
    )
    return row["v"] if row else None


def fill_missing(
    df: DataFrame,
    fill_values: dict[str, Any] | None,
    columns: Sequence[str] | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """Fill gaps in columns over the threshold.

    Columns named in ``fill_values`` get that value; the others their mean
    (numbers) or most frequent value (texts). Without ``fill_values`` nothing
    is filled.
    """
    if not fill_values:
        return df
    over = columns_over_threshold(df, columns, threshold)
    fills: dict[str, Any] = {c: fill_values[c] for c in over if c in fill_values}
    rest = [c for c in over if c not in fill_values]
    means = [c for c in rest if family(df.schema[c].dataType) in ("integer", "float")]
    if means:
        row = df.agg(*[F.avg(as_double(df, c)).alias(c) for c in means]).first()
        fills.update(zip(means, row, strict=True))
    for c in rest:
        if family(df.schema[c].dataType) == "text":
            fills[c] = most_frequent(df, c)
    return _filled(df, fills)


def _filled(df: DataFrame, fills: dict[str, Any]) -> DataFrame:
    # Not na.fill: that would cast the fill to the column's type, 2.5 into 2.
    return with_values(
        df, {c: F.coalesce(present(df, c), F.lit(v)) for c, v in fills.items() if v is not None}
    )


def handle_missing_values(
    df: DataFrame,
    strategy: str = "drop_rows",
    columns: Sequence[str] | None = None,
    threshold: float = 0.5,
    fill_values: dict[str, Any] | None = None,
) -> DataFrame:
    if strategy == "drop_rows":
        return drop_missing_rows(df, columns, threshold)
    if strategy == "drop_columns":
        return drop_missing_columns(df, columns, threshold)
    if strategy == "fill_values":
        return fill_missing(df, fill_values, columns, threshold)
    raise ValueError(f"unknown strategy {strategy!r}")


def impute(df: DataFrame, column: str, method: str, value: Any = None) -> DataFrame:
    """Repair one column: drop, mean, median, mode or constant."""
    numeric = family(df.schema[column].dataType) in ("integer", "float")
    if method == "drop":
        return df.where(~is_missing(df, column))
    if method in ("mean", "median") and not numeric:
        raise ValueError(f"{method} needs a numeric column, {column} is not")
    if method == "mean":
        fill = df.agg(F.avg(as_double(df, column))).first()[0]
    elif method == "median":
        fill = table_quantiles(df, [column], [0.5])[column][0.5]
    elif method == "mode":
        fill = most_frequent(df, column)
    elif method == "constant":
        fill = float(value) if numeric else str(value)
    else:
        raise ValueError(f"unknown method {method!r}")
    return _filled(df, {column: fill})


def missing_profile(df: DataFrame, top_n: int | None = None) -> DataFrame:
    """``column, missing_count, missing_percent`` of columns with gaps, most first; the first ``top_n`` where asked for."""
    rows = (
        missing_counts(df)
        .where(F.col("missing_count") > 0)
        .select("column", "missing_count", pct(F.col("missing_count"), F.col("row_count")).alias("missing_percent"))
        .orderBy(F.desc("missing_count"), "column")
    )
    return rows if top_n is None else rows.limit(top_n)


def missing_summary(df: DataFrame) -> DataFrame:
    """One row: how many columns have gaps, how many are over 10 % and 50 %, cells in total."""
    ratio = F.try_divide("missing_count", "row_count")
    cells = F.sum("row_count")
    missing = F.sum("missing_count")
    return missing_counts(df).agg(
        F.count(F.when(F.col("missing_count") > 0, 1)).alias("columns_with_missing"),
        F.count(F.when(ratio > 0.1, 1)).alias("columns_over_10_percent"),
        F.count(F.when(ratio > 0.5, 1)).alias("columns_over_50_percent"),
        missing.alias("missing_cells"),
        F.coalesce(F.round(F.try_divide(missing, cells) * 100, 2), F.lit(0.0)).alias("missing_percent"),
    )

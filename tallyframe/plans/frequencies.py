"""Category frequencies over many columns at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import col, text_columns
from tallyframe.functions.columns import unpivot

from .statistics import distinct_counts, missing_counts, pct


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, count`` of every category: one shuffle, combined map-side."""
    return (
        unpivot(df, {c: col(c).cast("string") for c in columns})
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


# Texts over this length are counted by their beginning and a digest.
KEY_CHARS = 64


def _key(text: Column) -> Column:
    """Stands for the text and sorts by its beginning; no short text has the length of a long one's key."""
    long_key = F.concat(F.substring(text, 1, KEY_CHARS), F.lit("\u0000"), F.sha2(text, 256))
    return F.when(F.length(text) > KEY_CHARS, long_key).otherwise(text)


def keyed_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``category_counts`` with long texts as keys, so that they do not cross the shuffle whole."""
    return (
        unpivot(df, {c: _key(col(c).cast("string")) for c in columns})
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def with_whole_values(df: DataFrame, columns: Sequence[str], top: DataFrame) -> DataFrame:
    """``top`` (a few rows per column, with keys in ``value``) as a literal table with the texts themselves.

    Only if a long text is among them is the table read again, for those keys alone.
    """
    rows = top.collect()
    long_keys = {(r["column"], r["value"]) for r in rows if r["value"] is not None and len(r["value"]) > KEY_CHARS}
    texts: dict[tuple[str, str], str] = {}
    if long_keys:
        spark = df.sparkSession
        wanted = F.broadcast(spark.createDataFrame(sorted(long_keys), "`column` string, key string"))
        concerned = [c for c in columns if any(c == k for k, _ in long_keys)]
        whole = unpivot(df, {c: col(c).cast("string") for c in concerned}).where(F.length("value") > KEY_CHARS)
        met = whole.withColumn("key", _key(F.col("value"))).join(wanted, ["column", "key"])
        texts = {(r["column"], r["key"]): r["value"] for r in met.groupBy("column", "key").agg(F.min("value").alias("value")).collect()}
    place = top.columns.index("value")
    named = [tuple(texts.get((r["column"], r["value"]), v) if i == place else v for i, v in enumerate(r)) for r in rows]
    return df.sparkSession.createDataFrame(named, top.schema)


def top_categories(counts: DataFrame, top_n: int) -> DataFrame:
    """``rank`` 1..top_n per column. Spark keeps each task's own top before the shuffle."""
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def categorical_profile(df: DataFrame, columns: Sequence[str] | None = None, top_n: int = 10) -> DataFrame:
    """One row per column and top category.

    ``column, count, missing, missing_pct, unique_values, rank, value,
    value_count, value_pct``; percentages of categories are of the values
    present. A column without values has one row with no category. Equal counts
    are ordered by value, long texts that begin alike by a digest.
    """
    names = text_columns(df, columns)
    counts = keyed_counts(df, names)
    totals = counts.groupBy("column").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("unique"))
    top = top_categories(counts, top_n).select(
        "column", "rank", "value", F.col("count").alias("value_count")
    )
    top = with_whole_values(df, names, top)
    # All joined tables have a few rows per column.
    base = missing_counts(df, names)
    return (
        base.join(F.broadcast(totals), "column", "left")
        .join(F.broadcast(top), "column", "left")
        .orderBy("position", "rank")
        .select(
            "column",
            (F.col("row_count") - F.col("missing_count")).alias("count"),
            F.col("missing_count").alias("missing"),
            pct(F.col("missing_count"), F.col("row_count")).alias("missing_pct"),
            F.coalesce("unique", F.lit(0)).alias("unique_values"),
            "rank",
            "value",
            "value_count",
            F.round(F.col("value_count") / F.col("n") * 100, 2).alias("value_pct"),
        )
    )


def categorical_limited(
    df: DataFrame, max_cols: int = 15, top_n: int = 5, max_distinct: int = 30
) -> DataFrame:
    """Categories of the ``max_cols`` text columns with the fewest distinct values.

    Columns with more than ``max_distinct`` values show their counts but no categories.
    """
    names = text_columns(df)
    unique = {r["column"]: r["unique_count"] for r in distinct_counts(df, names).collect()}
    if len(names) > max_cols:
        names = sorted(names, key=lambda c: unique.get(c, 0))[:max_cols]
    shown = [c for c in names if unique.get(c, 0) <= max_distinct]
    base = missing_counts(df, names)
    labels = F.create_map(*[x for c in names for x in (F.lit(c), F.lit(unique.get(c, 0)).cast("bigint"))])
    out = base.select(
        "position",
        "column",
        F.col("missing_count").alias("missing"),
        F.round(F.try_divide("missing_count", "row_count") * 100, 1).alias("missing_pct"),
        labels[F.col("column")].alias("unique_values"),
    )
    top = top_categories(category_counts(df, shown), top_n) if shown else None
    if top is None:
        nothing = F.lit(None)
        out = out.withColumns({"rank": nothing.cast("int"), "value": nothing.cast("string"), "value_count": nothing.cast("bigint")})
    else:
        out = out.join(
            F.broadcast(top.select("column", "rank", "value", F.col("count").alias("value_count"))), "column", "left"
        )
    return out.orderBy("position", "rank").drop("position")

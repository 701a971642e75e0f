"""Type detection and conversion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import col, family, is_missing, known, text_columns
from tallyframe.functions.columns import columns_of, with_values
from tallyframe.functions.parsing import to_flag, to_moment, to_number, to_whole_number
from tallyframe.functions.words import shorten
from tallyframe.plans.statistics import distinct_counts, pct, per_column


def coerce_numeric(df: DataFrame, columns: Sequence[str] | None = None, max_failing: float = 0.3) -> DataFrame:
    """Turn text columns into numbers where fewer than 30 % of the values fail to parse.

    Values that fail become missing. One pass measures all text columns.
    """
    names = text_columns(df, columns)
    if not names:
        return df
    rates = per_column(
        df,
        names,
        lambda c: {"filled": F.count(col(c)), "failing": F.count(F.when(col(c).isNotNull() & to_number(col(c)).isNull(), 1))},
    ).collect()
    numeric = {r["column"] for r in rates if r["filled"] and r["failing"] / r["filled"] < max_failing}
    return with_values(df, {c: to_number(col(c)) for c in names if c in numeric})


_SPARK_TYPES = {
    "int": "bigint",
    "float": "double",
    "str": "string",
    "bool": "boolean",
    "datetime": "timestamp_ntz",
    "category": "string",
}


def _soft(name: str, target: str) -> Column:
    c = col(name)
    return {
        "int": lambda: to_whole_number(c),
        "float": lambda: to_number(c),
        "str": lambda: c.cast("string"),
        "bool": lambda: to_flag(c),
        "datetime": lambda: to_moment(c),
        "category": lambda: c.cast("string"),
    }[target]()


def convert_data_types(df: DataFrame, conversions: dict[str, str], errors: str = "coerce") -> DataFrame:
    """Convert columns to int, float, str, bool, datetime or category.

    ``coerce`` turns what cannot be converted into a missing value, ``raise``
    fails the query at that value, ``ignore`` leaves a column as it was when
    any value fails. Unknown columns and types are skipped.
    """
    if errors not in ("coerce", "raise", "ignore"):
        raise ValueError(f"errors must be coerce, raise or ignore, not {errors!r}")
    wanted = {c: t for c, t in conversions.items() if known(df, c) and t in _SPARK_TYPES}
    if not wanted:
        return df
    if errors == "raise":
        return with_values(df, {c: _strict(df, c, t) for c, t in wanted.items()})
    soft = {c: _soft(c, t) for c, t in wanted.items()}
    if errors == "ignore":
        failed = per_column(
            df, list(soft), lambda c: {"failing": F.count(F.when(~is_missing(df, c) & soft[c].isNull(), 1))}
        ).collect()
        keep = {r["column"] for r in failed if r["failing"] == 0}
        soft = {c: v for c, v in soft.items() if c in keep}
    return with_values(df, soft)


def _strict(df: DataFrame, name: str, target: str) -> Column:
    value = _soft(name, target)
    message = F.concat(F.lit(f"cannot read column {name} as {target}: "), col(name).cast("string"))
    failed = ~is_missing(df, name) & value.isNull()
    return F.when(failed, F.raise_error(message).cast(_SPARK_TYPES[target])).otherwise(value)


def column_types(df: DataFrame, exact: bool = True) -> DataFrame:
    """``column, dtype, category, missing_*, unique_*``.

    A text column is categorical when it has at most ten distinct values and
    at most one per ten rows.
    """
    facts = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), family(f.dataType)) for i, f in enumerate(df.schema.fields)],
        "position int, `column` string, dtype string, kind string",
    )
    counted = per_column(
        df,
        df.columns,
        lambda c: {"row_count": F.count(F.lit(1)), "missing_count": F.count(F.when(is_missing(df, c), 1))},
    ).drop("position")
    unique = F.coalesce("unique_count", F.lit(0))
    few = unique <= F.least(F.lit(10), F.floor(F.col("row_count") / 10))
    return (
        facts.join(F.broadcast(counted), "column")
        .join(F.broadcast(distinct_counts(df, df.columns, exact)), "column", "left")
        .orderBy("position")
        .select(
            "column",
            "dtype",
            F.when(F.col("kind") == "text", F.when(few, "categorical").otherwise("text"))
            .otherwise(F.col("kind"))
            .alias("category"),
            "missing_count",
            pct(F.col("missing_count"), F.col("row_count")).alias("missing_percent"),
            unique.alias("unique_count"),
            pct(unique, F.col("row_count")).alias("unique_percent"),
        )
    )


def detect_free_text(
    df: DataFrame, mean_length: float = 25, max_length: int = 100, columns: Sequence[str] | None = None
) -> DataFrame:
    """``column, avg_length, max_length, is_free_text, sample`` for text columns.

    The sample is the smallest value: a table without order has no first one.
    """
    names = text_columns(df, columns)

    def fields(name: str) -> dict[str, Column]:
        return {
            "avg_length": F.avg(F.length(col(name))),
            "max_length": F.max(F.length(col(name))),
            # Only the head can show; comparing heads keeps the state short.
            "_head": F.min(F.substring(col(name), 1, 51)),
        }

    return (
        per_column(df, names, fields)
        .orderBy("position")
        .select(
            "column",
            "avg_length",
            "max_length",
            F.coalesce(
                (F.col("avg_length") > mean_length) | (F.col("max_length") > max_length), F.lit(False)
            ).alias("is_free_text"),
            shorten(F.col("_head"), 50).alias("sample"),
        )
    )


# Signed integer types by the largest number they hold.
_SIGNED = ((127, T.ByteType()), (32_767, T.ShortType()), (2_147_483_647, T.IntegerType()))


def narrow_integers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cast integer columns to the smallest signed type that holds every value."""
    integers = columns_of(df, "integer")
    names = integers if columns is None else [c for c in known(df, columns) if c in integers]
    if not names:
        return df
    ranges = per_column(
        df, names, lambda c: {"lo": F.min(col(c)).cast("bigint"), "hi": F.max(col(c)).cast("bigint")}
    ).collect()
    casts = {}
    for r in ranges:
        if r["lo"] is None:
            continue
        for top, dtype in _SIGNED:
            if -top - 1 <= r["lo"] and r["hi"] <= top:
                casts[r["column"]] = col(r["column"]).cast(dtype)
                break
    return with_values(df, casts)


def categorical_candidates(df: DataFrame, max_ratio: float = 0.5, exact: bool = True) -> DataFrame:
    """Text columns with fewer distinct values than half the rows: ``column, unique_count, is_categorical``."""
    rows = df.count()
    return distinct_counts(df, text_columns(df), exact).select(
        "column", "unique_count", (F.col("unique_count") < F.lit(rows * max_ratio)).alias("is_categorical")
    )

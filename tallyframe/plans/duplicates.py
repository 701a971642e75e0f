"""Rows that are equal in chosen columns: a representative of each group, and who belongs to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import col, known, present

from .ranks import join_by_value
from .storage import scratch_path


def row_fingerprint(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of the columns' names and values, whatever order the columns have; missing equals missing, NaN too, and -0 is 0."""

    def value(name: str) -> Column:
        v = present(df, name)
        if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
            v = v + F.lit(0.0)
        return v

    # JSON quotes texts and leaves out missing fields, so no two different rows read alike.
    return F.sha2(F.to_json(F.struct(*[value(c).alias(c) for c in sorted(columns)])), 256)


def duplicate_rows(df: DataFrame, id_column: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``id_column, representative, copies`` for every row that has an equal in ``columns`` (all others by default).

    The representative is the least id of the group, and copies its number of
    rows. A missing id is never a representative unless all ids of the group are
    missing. Groups are counted before they meet their rows: the few with more than a
    thousandth of all rows are broadcast, so that a group of a third of the table
    does not end in one task.
    """
    names = [c for c in (df.columns if columns is None else known(df, columns)) if c != id_column]
    if not names:
        raise ValueError("no column to compare")
    spark = df.sparkSession
    path = scratch_path(spark, "fingerprints")
    df.select(col(id_column).alias("_id"), row_fingerprint(df, names).alias("fp")).write.parquet(path)
    rows = spark.read.parquet(path)
    groups_path = scratch_path(spark, "duplicate-groups")
    groups = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("w"), F.min("_id").alias("representative")).where("w > 1")
    groups.withColumn("copies", F.col("w")).write.parquet(groups_path)
    groups = spark.read.parquet(groups_path)
    met = join_by_value(rows, groups, [("fp", "fp")], {"representative": "representative", "copies": "copies"}, rows.count(), groups.count())
    return met.where(F.col("copies").isNotNull()).select(F.col("_id").alias(id_column), "representative", "copies")


def without_duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row of each group of equals; which one is not defined. Missing values are equal, NaN too."""
    names = df.columns if columns is None else known(df, columns)
    marked = df.withColumn("_fp", row_fingerprint(df, names))
    return marked.dropDuplicates(["_fp"]).drop("_fp")

"""Projections and derived columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import col, known


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the named columns; unknown names are ignored, none known leaves the table as it is."""
    names = known(df, columns)
    return df.select([col(n) for n in names]) if names else df


def add_calculated_column(df: DataFrame, new_column: str, formula: str) -> DataFrame:
    """Add a column from a Spark SQL expression over the others."""
    return df.withColumn(new_column, F.expr(formula))


def add_derived_column(df: DataFrame, new_column: str, formula: Callable[[DataFrame], Column]) -> DataFrame:
    """Add a column from a function of the table that returns a Column."""
    return df.withColumn(new_column, formula(df))

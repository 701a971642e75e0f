"""The tables a report is written from."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import col, numeric_columns
from tallyframe.operators.sorting import order_keys, sort_values

from .profile import column_kinds
from .statistics import describe, missing_counts, moments


def sample_rows(df: DataFrame, order_by: Sequence[str], rows: int = 5) -> DataFrame:
    """``row, column, value``: the first rows by a stated order, cell by cell as text."""
    top = sort_values(df, list(order_by)).limit(rows)
    numbered = top.select(F.row_number().over(Window.orderBy(*order_keys(df, order_by))).alias("row"), "*")  # ``rows`` rows at most
    cells = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), col(c).cast("string").alias("value")) for i, c in enumerate(df.columns)]
    return numbered.select("row", F.inline(F.array(*cells))).orderBy("row", "place").drop("place")


def report_tables(
    datasets: dict[str, DataFrame], exact: bool = True, sample_by: Sequence[str] | None = None, sample: int = 5
) -> dict[str, DataFrame]:
    """``shape``, ``columns`` and ``describe`` of several named tables, tagged by ``dataset``.

    With ``sample_by``, an order of rows, also ``sample``: the first rows of each table.
    """
    shapes, columns, stats = [], [], []
    for name, df in datasets.items():
        tag = F.lit(name).alias("dataset")
        counted = missing_counts(df)
        shapes.append(
            counted.agg(
                F.max("row_count").alias("rows"),
                F.count(F.lit(1)).alias("columns"),
                F.sum("missing_count").alias("missing_cells"),
            ).select(tag, "rows", "columns", "missing_cells")
        )
        kinds = F.broadcast(column_kinds(df).drop("position"))  # one row per column
        columns.append(counted.join(kinds, "column").select(tag, "column", "dtype", "kind", "missing_count"))
        if numeric_columns(df):
            stats.append(describe(df, exact=exact).select(tag, "*"))
    out = {"shape": reduce(DataFrame.unionByName, shapes), "columns": reduce(DataFrame.unionByName, columns)}
    if sample_by:
        parts = [sample_rows(df, sample_by, sample).select(F.lit(name).alias("dataset"), "*") for name, df in datasets.items()]
        out["sample"] = reduce(DataFrame.unionByName, parts)
    if stats:
        out["describe"] = reduce(DataFrame.unionByName, stats)
    return out


def before_after(original: DataFrame, processed: DataFrame) -> DataFrame:
    """Per numeric column: rows, missing, mean and spread before and after, side by side."""

    def side(df: DataFrame, suffix: str) -> DataFrame:
        return moments(df, numeric_columns(df)).select(
            "column",
            F.col("count").alias(f"count_{suffix}"),
            (F.col("row_count") - F.col("count")).alias(f"missing_{suffix}"),
            *[F.col(c).alias(f"{c}_{suffix}") for c in ("mean", "std", "min", "max")],
        )

    joined = side(original, "before").join(F.broadcast(side(processed, "after")), "column", "full_outer")
    return joined.withColumns(
        {
            "rows_removed": F.col("count_before") + F.col("missing_before") - F.col("count_after") - F.col("missing_after"),
            "mean_change": F.col("mean_after") - F.col("mean_before"),
        }
    )

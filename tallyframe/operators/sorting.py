"""Sorts, first rows and ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from tallyframe.functions import col, family, is_missing, known
from tallyframe.functions.columns import as_double, with_values


def sort_values(df: DataFrame, columns: Sequence[str] | str, ascending: bool | Sequence[bool] = True) -> DataFrame:
    """Global sort; missing values come last whichever way a column is sorted."""
    keys = order_keys(df, columns, ascending)
    return df.orderBy(*keys) if keys else df


def order_keys(df: DataFrame, columns: Sequence[str] | str, ascending: bool | Sequence[bool] = True) -> list[Column]:
    """The sort keys of ``sort_values``."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    flags = [ascending] * len(columns) if isinstance(ascending, bool) else list(ascending)
    if len(flags) != len(columns):
        raise ValueError(f"{len(columns)} columns but {len(flags)} directions")
    keys = []
    for name, up in zip(columns, flags, strict=True):
        if not known(df, name):
            continue
        if family(df.schema[name].dataType) == "float":
            keys.append(is_missing(df, name).asc())  # NaN would otherwise lead a descending sort
        keys.append(col(name).asc_nulls_last() if up else col(name).desc_nulls_last())
    return keys


def preview(df: DataFrame, rows: int = 5, order_by: Sequence[str] | str | None = None) -> DataFrame:
    """The first rows: by ``order_by``, or any that come first where no order is given."""
    return (sort_values(df, order_by) if order_by else df).limit(rows)


def line_series(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """Points of a line chart, one line per group, ordered by x; rows with a gap are left out."""
    names = [x, y] + ([group] if group and known(df, group) else [])
    out = df.select([col(n) for n in names])
    for n in names:
        out = out.where(~is_missing(df, n))
    if family(df.schema[y].dataType) == "timedelta":
        out = with_values(out, {y: as_double(df, y)})
    order = names[2:] + [x, y]
    return out.orderBy(*[col(n) for n in order])

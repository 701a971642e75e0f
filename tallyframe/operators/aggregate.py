"""Grouping, pivoting, value counts and row-wise concatenation.

Rows with a missing group key are left out, as data frame users expect.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import col, family, is_missing, known, numeric_columns
from tallyframe.functions.columns import present
from tallyframe.plans.quantiles import grouped_quantiles
from tallyframe.plans.statistics import distinct_counts

Aggregate = str | Callable[[Column], Column]

# The statistics a group analysis shows unless told otherwise.
DEFAULT_STATISTICS = ("count", "mean", "median", "std", "min", "max")

_BUILT_IN: dict[str, Callable[[Column], Column]] = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),  # nothing to add sums to 0
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "nunique": F.count_distinct,
}


def _as_list(x: str | Aggregate | Sequence) -> list:
    return [x] if isinstance(x, str) or callable(x) else list(x)


def _label(func: Aggregate) -> str:
    return func if isinstance(func, str) else func.__name__


def group_and_aggregate(
    df: DataFrame,
    group_by: str | Sequence[str],
    aggregates: dict[str, Aggregate | Sequence[Aggregate]],
    order_by: str | None = None,
    exact: bool = True,
    sort: bool = True,
) -> DataFrame:
    """``{column: function or [functions]}`` per group, in columns named ``column_function``.

    Functions: sum, mean, median, min, max, count, std, var, nunique, first,
    last, or any callable from Column to aggregate Column. ``first`` and
    ``last`` need ``order_by``, since rows have no order of their own.
    """
    keys = known(df, group_by)
    wanted = {c: _as_list(f) for c, f in aggregates.items() if known(df, c)}
    if not keys or not wanted:
        return df
    rows = df
    for k in keys:
        rows = rows.where(~is_missing(df, k))

    aggs: list[Column] = []
    medians: list[str] = []
    names: list[str] = []
    for c, funcs in wanted.items():
        for f in funcs:
            alias = f"{c}_{_label(f)}"
            names.append(alias)
            if f == "median":
                medians.append(c)
            else:
                aggs.append(_aggregate(df, c, f, order_by).alias(alias))
    out = rows.groupBy(*[col(k) for k in keys]).agg(*aggs) if aggs else None
    if medians:
        # Median through the bounded quantile plan: one group may hold most of the table.
        long = grouped_quantiles(rows, keys, medians, [0.5], exact=exact)
        # One row per group, without a shuffle when the quantiles came wide.
        wide = long.groupBy(*[col(k) for k in keys]).agg(
            *[F.max(F.when(F.col("column") == c, F.col("q")[0])).alias(f"{c}_median") for c in medians]
        )
        out = wide if out is None else out.join(wide, keys, "left")
    assert out is not None
    out = out.select(*[col(k) for k in keys], *[col(n) for n in names])
    return out.orderBy(*[col(k) for k in keys]) if sort else out


def _aggregate(df: DataFrame, column: str, func: Aggregate, order_by: str | None) -> Column:
    value = present(df, column)
    if callable(func):
        return func(value)
    if func in ("first", "last"):
        if order_by is None:
            raise ValueError(f"{func} needs order_by: rows of a table have no order of their own")
        place = F.when(value.isNotNull(), col(order_by))
        return F.min_by(value, place) if func == "first" else F.max_by(value, place)
    if func not in _BUILT_IN:
        raise ValueError(f"unknown aggregate {func!r}")
    return _BUILT_IN[func](value)


def group_analysis(
    df: DataFrame,
    group_by: str | Sequence[str],
    columns: Sequence[str] | None = None,
    functions: dict[str, Sequence[Aggregate]] | None = None,
    exact: bool = True,
) -> DataFrame:
    """Default statistics of every numeric column that is not a key, per group."""
    keys = [group_by] if isinstance(group_by, str) else list(group_by)
    absent = [k for k in keys if k not in df.columns]
    if absent:
        raise ValueError(f"no such column: {absent}")
    names = numeric_columns(df) if columns is None else known(df, columns)
    names = [c for c in names if c not in keys]
    if not names:
        raise ValueError("no column to aggregate")
    chosen = functions or {}
    return group_and_aggregate(df, keys, {c: chosen.get(c, DEFAULT_STATISTICS) for c in names}, exact=exact)


def union_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all tables, matched by column name; absent columns become missing."""
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def pivot_table(
    df: DataFrame,
    index: str | Sequence[str],
    columns: str | Sequence[str] | None = None,
    values: str | Sequence[str] | None = None,
    aggfunc: Aggregate | Sequence[Aggregate] | dict[str, Aggregate | Sequence[Aggregate]] = "mean",
    pivot_values: Sequence[str] | None = None,
    exact: bool = True,
    max_values: int | None = None,
) -> DataFrame:
    """Index by columns, one aggregate per cell.

    Cell columns are called ``<pivot value>`` when there is one value column
    with one function, else ``<pivot value>_<column>_<function>``. Several
    pivot columns join their values by ``_``; where two combinations would get
    one name, ``_`` and ``\\`` inside their values are escaped by ``\\``. Rows
    and columns without any value disappear. With more pivot values than
    ``max_values`` (by default what the engine allows) the call fails instead
    of leaving some out; ``pivot_cells`` has no such bound.
    """
    rows_by = [index] if isinstance(index, str) else list(index)
    across = [] if columns is None else _as_list(columns)
    long, cells = _pivot_cells(df, rows_by, across, values, aggfunc, exact)
    if not across:
        return long.orderBy(*[col(k) for k in rows_by])

    parts = [F.coalesce(col(c).cast("string"), F.lit("")) if len(across) > 1 else col(c).cast("string") for c in across]
    plain = F.concat_ws("_", *[col(c).cast("string") for c in across])
    labelled = long.withColumn("_key", F.to_json(F.array(*[col(c).cast("string") for c in across]))).withColumn("_plain", plain)
    if pivot_values is None:
        most = max_values or int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        escaped = F.concat_ws("_", *[F.regexp_replace(p, r"([_\\])", r"\\$1") for p in parts])
        found = labelled.select("_key", "_plain", escaped.alias("_escaped")).distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than {most} pivot values; name the wanted ones in pivot_values, or use pivot_cells")
        often = Counter(r["_plain"] for r in found)
        names = {r["_key"]: r["_plain"] if often[r["_plain"]] == 1 else r["_escaped"] for r in found}
        key, wanted = "_key", sorted(names, key=names.get)
    else:
        key, wanted = "_plain", list(pivot_values)
        names = {v: v for v in wanted}
    grouped = labelled.groupBy(*[col(k) for k in rows_by]).pivot(key, wanted)
    if len(cells) == 1:
        out = grouped.agg(F.first(col(cells[0]), ignorenulls=True))
    else:
        out = grouped.agg(*[F.first(col(c), ignorenulls=True).alias(c) for c in cells])
    # By place: the pivot's columns stand in the order of the wanted values.
    labels = [names[v] if len(cells) == 1 else f"{names[v]}_{c}" for v in wanted for c in cells]
    return out.toDF(*rows_by, *labels).orderBy(*[col(k) for k in rows_by])


def pivot_cells(
    df: DataFrame,
    index: str | Sequence[str],
    columns: str | Sequence[str],
    values: str | Sequence[str] | None = None,
    aggfunc: Aggregate | Sequence[Aggregate] | dict[str, Aggregate | Sequence[Aggregate]] = "mean",
    exact: bool = True,
) -> DataFrame:
    """The cells of a pivot in long form, one row per index and pivot values: no bound on their number."""
    rows_by = [index] if isinstance(index, str) else list(index)
    return _pivot_cells(df, rows_by, _as_list(columns), values, aggfunc, exact)[0]


def _pivot_cells(df: DataFrame, rows_by: list[str], across: list[str], values, aggfunc, exact: bool) -> tuple[DataFrame, list[str]]:
    if isinstance(aggfunc, dict):
        wanted = {c: _as_list(f) for c, f in aggfunc.items()}
        if values is not None:
            wanted = {c: f for c, f in wanted.items() if c in _as_list(values)}
    else:
        names = (
            [c for c in numeric_columns(df) if c not in (*rows_by, *across)]
            if values is None
            else known(df, _as_list(values))
        )
        wanted = {c: _as_list(aggfunc) for c in names}
    cells = [f"{c}_{_label(f)}" for c, fs in wanted.items() for f in fs]
    # Cells first, long: the pivot then only moves one row per cell.
    long = group_and_aggregate(df, [*rows_by, *across], wanted, exact=exact, sort=False)
    filled = F.lit(False)
    for c in cells:
        filled = filled | col(c).isNotNull()
    return long.where(filled), cells


def value_counts(df: DataFrame, column: str, top_n: int | None = None) -> DataFrame:
    """``value, count``, most frequent first, equal counts by value."""
    counted = (
        df.where(~is_missing(df, column))
        .groupBy(col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc("value"))
    )
    return counted if top_n is None else counted.limit(top_n)


def top_n_with_others(df: DataFrame, column: str, top_n: int = 5, others: bool = True) -> DataFrame:
    """``value, count, percent``: the most frequent values and, in one row, all the rest."""
    present_rows = df.where(~is_missing(df, column)).select(col(column).cast("string").alias("value"))
    # No more than top_n rows and one total reach the driver.
    shown = [(r["value"], r["count"]) for r in value_counts(present_rows, "value", top_n).collect()]
    total = present_rows.count() if others else sum(n for _, n in shown)
    rest = total - sum(n for _, n in shown)
    if rest:
        shown.append(("Others", rest))
    table = df.sparkSession.createDataFrame(shown, "value string, count bigint")
    return table.withColumn("percent", F.round(F.col("count") / F.lit(total) * 100, 1))


def automatic_group_column(df: DataFrame, low: int = 2, high: int = 10) -> str | None:
    """The text column with the most distinct values between ``low`` and ``high``; ties go to the earlier one."""
    texts = [f.name for f in df.schema.fields if family(f.dataType) == "text"]
    if not texts:
        return None
    counts = {r["column"]: r["unique_count"] for r in distinct_counts(df, texts).collect()}
    fitting = [c for c in texts if low <= counts.get(c, 0) <= high]
    return max(fitting, key=lambda c: counts[c]) if fitting else None


def auto_group(df: DataFrame, exact: bool = True) -> DataFrame | None:
    """Group analysis by the column chosen above, or None when no column fits."""
    key = automatic_group_column(df)
    return None if key is None else group_analysis(df, key, exact=exact)


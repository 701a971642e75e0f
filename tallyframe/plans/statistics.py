"""Fused per-column statistics: many columns, few passes, one row per column."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe import limits
from tallyframe.functions import col, family, is_missing, numeric_columns
from tallyframe.functions.columns import as_double, unpivot

from .quantiles import table_quantiles
from .ranks import count_values, rank_values


def per_column(df: DataFrame, columns: Sequence[str], fields: Callable[[str], dict[str, Column]]) -> DataFrame:
    """One row per column with the aggregates ``fields`` names for it.

    Columns are fused into aggregates of a bounded width. Each of these reads
    only its own columns, so the file bytes read in total stay those of one pass.
    """
    size = limits.FUSED_COLUMNS
    parts = []
    for i in range(0, len(columns), size):
        structs = []
        for position, name in enumerate(columns[i : i + size], start=i):
            aggs = [c.alias(alias) for alias, c in fields(name).items()]
            structs.append(F.struct(F.lit(position).alias("position"), F.lit(name).alias("column"), *aggs))
        parts.append(df.agg(F.array(*structs).alias("_all")).select(F.inline("_all")))
    return reduce(DataFrame.unionByName, parts)


def pct(part: Column, whole: Column) -> Column:
    """Percentage with two decimals, 0 for an empty table."""
    return F.coalesce(F.round(F.try_divide(part, whole) * 100, 2), F.lit(0.0))


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``position, column, row_count, missing_count`` for every column."""
    names = list(columns) if columns is not None else df.columns
    return per_column(
        df,
        names,
        lambda c: {
            "row_count": F.count(F.lit(1)),
            "missing_count": F.count(F.when(is_missing(df, c), 1)),
        },
    )


@dataclass(frozen=True)
class Facts:
    """What one light pass finds out about a column."""

    row_count: int
    count: int
    mean: float | None
    min: float | None
    max: float | None

    @property
    def varies(self) -> bool:
        return self.count > 0 and self.min != self.max


def one_row(df: DataFrame, columns: Sequence[str], values: Callable[[str], Column], aggregates: Sequence[str]) -> dict[str, list]:
    """SQL aggregates over ``v`` for every column, fetched as plain numbers.

    The values are projected first, so that each is worked out once per row,
    and columns go in blocks that stay inside one generated method.
    """
    out: dict[str, list] = {}
    size = limits.FUSED_COLUMNS
    for i in range(0, len(columns), size):
        block = columns[i : i + size]
        flat = df.select([values(c).alias(f"v{k}") for k, c in enumerate(block)])
        # Backquoted, so that no other name in an aggregate can be mistaken for the value.
        row = flat.selectExpr(*[a.replace("`v`", f"v{k}") for k in range(len(block)) for a in aggregates]).first()
        for k, c in enumerate(block):
            out[c] = list(row[k * len(aggregates) : (k + 1) * len(aggregates)])
    return out


def base_facts(df: DataFrame, columns: Sequence[str]) -> dict[str, Facts]:
    """Rows, values, mean, smallest and largest per column."""
    found = one_row(
        df, columns, lambda c: as_double(df, c), ["count(*)", "count(`v`)", "avg(`v`)", "min(`v`)", "max(`v`)"]
    )
    return {c: Facts(*f) for c, f in found.items()}


MOMENTS = (
    "position int, `column` string, row_count bigint, count bigint, mean double, std double, var double, "
    "min double, max double, skew double, kurtosis double"
)


def moments(df: DataFrame, columns: Sequence[str], facts: dict[str, Facts] | None = None) -> DataFrame:
    """Count, mean, spread and shape of numeric columns; skew and kurtosis adjusted for bias.

    A first pass gives the means, a second sums powers of the distance from
    them. Plain sums stay in generated code, where one built-in aggregate per
    moment would not, and centring keeps them as exact as the built-in ones.
    """
    facts = base_facts(df, columns) if facts is None else facts
    sums = one_row(
        df,
        columns,
        lambda c: as_double(df, c) - F.lit(facts[c].mean).cast("double"),
        ["sum(`v` * `v`)", "sum(`v` * `v` * `v`)", "sum(`v` * `v` * `v` * `v`)"],
    )
    rows = []
    for i, c in enumerate(columns):
        f = facts[c]
        rows.append((i, c, f.row_count, f.count, f.mean, *_spread(f, *sums[c])[:2], f.min, f.max, *_spread(f, *sums[c])[2:]))
    return few_rows(df, rows, MOMENTS)


def _spread(f: Facts, s2: float | None, s3: float | None, s4: float | None) -> tuple[float | None, ...]:
    """Standard deviation, variance, skew and kurtosis from sums of centred powers."""
    n = f.count
    if n < 2 or s2 is None:
        return (None, None, None, None)
    if not f.varies:
        return (0.0, 0.0, 0.0 if n > 2 else None, 0.0 if n > 3 else None)
    var = s2 / (n - 1)
    skew = kurtosis = None
    if n > 2:
        skew = math.sqrt(n) * s3 / s2**1.5 * math.sqrt(n * (n - 1)) / (n - 2)
    if n > 3:
        excess = n * s4 / (s2 * s2) - 3
        kurtosis = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * excess + 6)
    return (math.sqrt(var), var, skew, kurtosis)


def _distinct_key(df: DataFrame, name: str) -> tuple[str, Column]:
    """A shuffle key that is equal exactly when the values are.

    Long texts are keyed by their SHA-256, so that counting them does not
    send them whole through the shuffle.
    """
    kind = family(df.schema[name].dataType)
    if kind == "integer":
        return "long", col(name).cast("bigint")
    if kind == "float" and df.schema[name].dataType.typeName() != "decimal":
        return "double", as_double(df, name)
    text = col(name).cast("string")
    if kind == "text":
        text = F.when(F.length(text) > 64, F.sha2(text, 256)).otherwise(text)
    return "text", text


def distinct_counts(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """``column, unique_count``. Columns of missing values only are absent.

    Long form instead of several COUNT(DISTINCT): those would multiply every
    row by the number of columns before the shuffle without combining.
    """
    if not exact:
        return per_column(
            df, columns, lambda c: {"unique_count": F.approx_count_distinct(_distinct_key(df, c)[1])}
        ).select("column", "unique_count")
    kinds: dict[str, dict[str, Column]] = {}
    for name in columns:
        kind, key = _distinct_key(df, name)
        kinds.setdefault(kind, {})[name] = key
    counts = [
        unpivot(df, values).groupBy("column", "value").agg(F.lit(1)).groupBy("column").agg(
            F.count(F.lit(1)).alias("unique_count")
        )
        for values in kinds.values()
    ]
    return reduce(DataFrame.unionByName, counts)


def few_rows(df: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A literal table of one row per column; small by construction, so it may be broadcast."""
    return F.broadcast(df.sparkSession.createDataFrame(list(rows), schema))


def quantile_rows(
    df: DataFrame, columns: Sequence[str], names: dict[str, float], exact: bool = True
) -> DataFrame:
    """``column`` and one column per named quantile."""
    probs = list(dict.fromkeys(names.values()))
    found = table_quantiles(df, columns, probs, exact=exact)
    schema = "`column` string, " + ", ".join(f"`{n}` double" for n in names)
    return few_rows(df, [(c, *[found[c][p] for p in names.values()]) for c in columns], schema)


def order_facts(
    df: DataFrame, columns: Sequence[str], names: dict[str, float], facts: dict[str, Facts], exact: bool = True
) -> DataFrame:
    """``column, unique_count`` and one column per named quantile.

    While a column's values fit one task, its value counts give both: they
    are sorted once per column, and each quantile is read off at its known
    position. Larger tables take the two general plans.
    """
    largest = max((f.count for f in facts.values()), default=0)
    if not exact or largest > limits.ONE_TASK_ROWS:
        quantiles = quantile_rows(df, columns, names, exact)
        return quantiles.join(F.broadcast(distinct_counts(df, columns, exact)), "column", "left")
    counts = count_values(unpivot(df, {c: as_double(df, c) for c in columns}), ["column"])
    ranked = rank_values(counts, ["column"], largest)
    sizes = F.create_map(*[x for c, f in facts.items() for x in (F.lit(c), F.lit(f.count).cast("bigint"))])
    size = sizes[F.col("column")]
    reads = []
    for name, p in names.items():
        position = (size - 1) * F.lit(p)
        low, high = F.floor(position), F.ceil(position)
        part = position - low

        def holds(k: Column) -> Column:
            return (F.col("before") <= k) & (k < F.col("before") + F.col("w"))

        share = F.when(holds(low), 1 - part).otherwise(0.0) + F.when(holds(high), part).otherwise(0.0)
        reads.append(F.sum(F.when(holds(low) | holds(high), F.col("value") * share)).alias(name))
    read = ranked.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"), *reads)
    every = few_rows(df, [(c,) for c in columns], "`column` string")
    return every.join(F.broadcast(read), "column", "left")


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Full numeric profile, one row per numeric column in table order."""
    names = numeric_columns(df, columns)
    if not names:
        raise ValueError("no numeric column to profile")
    facts = base_facts(df, names)
    quantiles = {"median": 0.5, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}
    ordered = order_facts(df, names, quantiles, facts, exact)
    missing = F.col("row_count") - F.col("count")
    return (
        moments(df, names, facts)
        .join(F.broadcast(ordered), "column", "left")
        .select(
            "column",
            "count",
            missing.alias("missing"),
            pct(missing, F.col("row_count")).alias("missing_pct"),
            "mean", "median", "std", "var", "min", "max",
            (F.col("max") - F.col("min")).alias("range"),
            F.coalesce("unique_count", F.lit(0)).alias("unique_values"),
            "q10", "q25", "q50", "q75", "q90", "skew", "kurtosis",
            "position",
        )
        .orderBy("position")
        .drop("position")
    )


def describe(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    names = numeric_columns(df, columns)
    quantiles = quantile_rows(df, names, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, exact)
    return (
        moments(df, names)
        .join(quantiles, "column")
        .orderBy("position")
        .select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")
    )

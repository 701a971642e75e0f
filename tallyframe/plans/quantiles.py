"""Exact quantiles, linear between neighbours, at any table size and skew.

Groups whose rows were counted and fit one task use the built-in exact
percentile. Larger ones are narrowed first: values are counted in a fixed
number of bins between the least and the greatest, which combines in every
task, and the bin of each wanted position is cut into bins again until few
enough rows are left to be counted by value and ranked. The answer is the exact
order statistic; the bins only decide how much has to be looked at.

Whole columns count their bins as vectors, all columns in one pass, see
``bins``; groups by keys from the data count them as rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe import limits
from tallyframe.functions import col
from tallyframe.functions.columns import as_double, unpivot

from .bins import Target, narrowed
from .ranks import count_values, rank_values
from .storage import checkpointed, local_copy

# Accuracy of the built-in sketch, for groups of one task that need no exact answer.
SKETCH = 10_000

# Bins per round, rounds at most, and copies of a target where targets are too many to broadcast.
BINS = 2_048
ROUNDS = 12
SALTS = 16


def percentile_of(c: Column, probs: Sequence[float]) -> Column:
    return F.percentile(c, F.array(*[F.lit(float(p)) for p in probs]))


def group_sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*[col(k) for k in by]).agg(F.count(F.lit(1)).alias("n"))


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the biggest group; the counting job moves one row per group and task."""
    if not by:
        return df.count()
    return group_sizes(df, by).agg(F.max("n")).first()[0] or 0


def table_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    exact: bool = True,
    values: dict[str, Column] | None = None,
    one_task: int | None = None,
) -> dict[str, dict[float, float | None]]:
    """Quantiles of whole columns as plain numbers: ``{column: {p: value}}``."""
    one_task = limits.ONE_TASK_ROWS if one_task is None else one_task
    values = values or {c: as_double(df, c) for c in columns}
    out: dict[str, dict[float, float | None]] = {}
    if not values:
        return out
    if df.count() <= one_task:
        for block in _blocks(list(values)):
            if exact:
                aggs = [percentile_of(values[c], probs).alias(c) for c in block]
            else:
                aggs = [F.percentile_approx(values[c], list(probs), SKETCH).alias(c) for c in block]
            row = df.agg(*aggs).first()
            for c, got in zip(block, row, strict=True):
                out[c] = dict(zip(probs, got if got is not None else [None] * len(probs), strict=True))
        return out
    return _large_table_quantiles(df, values, probs, one_task)


def _large_table_quantiles(df: DataFrame, values: dict[str, Column], probs: Sequence[float], one_task: int) -> dict[str, dict[float, float | None]]:
    """One pass for the ranges, one per narrowing round, and one that ranks the few values left, each over all columns."""
    targets: dict[str, dict[float, Target]] = {}
    for c, (n, low, high) in _ranges(df, values).items():
        targets[c] = {p: Target((n - 1) * p, low, high, 0, n) for p in probs} if n else {}
    narrowed(df, values, {c: list(ts.values()) for c, ts in targets.items()}, one_task)
    _rank_the_rest(df, values, targets, one_task)
    return {c: {p: ts[p].value() if ts else None for p in probs} for c, ts in targets.items()}


def _ranges(df: DataFrame, values: dict[str, Column]) -> dict[str, tuple[int, float, float]]:
    """Per column the number of values and the least and greatest finite one (0 where there is none)."""
    out = {}
    for block in _blocks(list(values)):
        flat = df.select([values[c].alias(f"v{i}") for i, c in enumerate(block)])
        finite = "CASE WHEN abs(v{0}) < double('inf') THEN v{0} END"
        row = flat.selectExpr(*[e.format(i) for i in range(len(block)) for e in ("count(v{0})", f"min({finite})", f"max({finite})")]).first()
        for i, c in enumerate(block):
            n, low, high = row[3 * i : 3 * i + 3]
            out[c] = (n, low or 0.0, high or 0.0)
    return out


def _rank_the_rest(df: DataFrame, values: dict[str, Column], targets: dict[str, dict[float, Target]], one_task: int) -> None:
    """Targets in ranges of few values: those values alone are counted and ranked, and read off at the positions."""
    rest = {c: [(p, t) for p, t in ts.items() if t.found is None] for c, ts in targets.items()}
    rest = {c: ts for c, ts in rest.items() if ts}
    if not rest:
        return
    spans = {c: sorted({(t.low, t.high, t.below, t.inside) for _, t in ts}) for c, ts in rest.items()}

    def span_of(c: str) -> Column:
        """The number of the range that holds the value; null outside of all."""
        place = F.lit(None).cast("int")
        for i, (low, high, _, _) in enumerate(spans[c]):
            place = F.when(values[c].between(low, high), F.lit(i)).otherwise(place)
        return place

    # (range, value) of all columns as one long table; only values inside a range become rows.
    cells = unpivot(df, {c: F.when(span_of(c).isNotNull(), F.struct(span_of(c).alias("span"), values[c].alias("value"))) for c in rest})
    counts = count_values(cells.select("column", "value.span", "value.value"), ["column", "span"])
    most = max(t.inside for ts in rest.values() for _, t in ts)
    ranked = rank_values(counts, ["column", "span"], most, one_task=one_task)
    wanted = [
        (c, spans[c].index((t.low, t.high, t.below, t.inside)), p, end, int(end_of(t.position)) - t.below)
        for c, ts in rest.items()
        for p, t in ts
        for end, end_of in enumerate((np.floor, np.ceil))
    ]
    # One row per column, probability and end, so it may be broadcast.
    places = df.sparkSession.createDataFrame(wanted, "`column` string, span int, p double, end int, k long")
    held = (F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("w"))
    ends = {(r["column"], r["p"], r["end"]): r["value"] for r in ranked.join(F.broadcast(places), ["column", "span"]).where(held).collect()}
    for c, ts in rest.items():
        for p, t in ts:
            t.found = ends[c, p, 0], ends[c, p, 1]


def _blocks(names: list[str]) -> list[list[str]]:
    size = limits.FUSED_COLUMNS
    return [names[i : i + size] for i in range(0, len(names), size)]


def grouped_quantiles(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float],
    exact: bool = True,
    one_task: int | None = None,
) -> DataFrame:
    """One row per group and column: ``by..., column, q`` with q an array in the order of probs."""
    one_task = limits.ONE_TASK_ROWS if one_task is None else one_task
    by = list(by)
    values = {c: as_double(df, c) for c in columns}
    keys = [*by, "column"]
    if largest_group(df, by) <= one_task:
        pick = (
            (lambda c: percentile_of(c, probs))
            if exact
            else (lambda c: F.percentile_approx(c, list(probs), SKETCH).cast("array<double>"))
        )
        wide = df.groupBy(*[col(k) for k in by]).agg(
            F.array(*[F.struct(F.lit(c).alias("column"), pick(v).alias("q")) for c, v in values.items()]).alias("_all")
        )
        return wide.select(*[col(k) for k in by], F.inline("_all"))

    long = unpivot(df, values, by)
    facts = _group_facts(df, values, by)
    # At most (rows / bound) groups can be over the bound.
    over = facts.where(F.col("n") > one_task)
    marked = local_copy(over, limits.BROADCAST_ROWS)
    big = over if marked is None else marked
    all_big = facts.where((F.col("n") > 0) & (F.col("n") <= one_task)).isEmpty()
    hot_keys = big.select(*[col(k) for k in keys])
    hot_keys = hot_keys if marked is None else F.broadcast(hot_keys)
    same = [long[k].eqNullSafe(hot_keys[k]) for k in keys]
    hot = long if all_big else long.join(hot_keys, same, "left_semi")
    found = large_group_quantiles(hot, keys, probs, one_task, big)
    arrays = found.groupBy(*[col(k) for k in keys]).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pi", "q"))), lambda s: s["q"]).alias("q")
    )
    if all_big:
        return arrays
    small = (
        long.join(hot_keys, same, "left_anti")
        .groupBy(*[col(k) for k in keys])
        .agg(percentile_of(F.col("value"), probs).alias("q"))
    )
    return small.unionByName(arrays)


def _group_facts(df: DataFrame, values: dict[str, Column], by: Sequence[str]) -> DataFrame:
    """``by..., column, n, lo, hi`` from the rows as they are: values, the least and the greatest finite one of each group."""
    parts = []
    for block in _blocks(list(values)):
        flat = df.select(*[col(k) for k in by], *[values[c].alias(f"_v{i}") for i, c in enumerate(block)])
        aggs = []
        for i, c in enumerate(block):
            v = F.col(f"_v{i}")
            finite = F.when(F.abs(v) < F.lit(float("inf")), v)
            aggs.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi")))
        wide = flat.groupBy(*[col(k) for k in by]).agg(F.array(*aggs).alias("_all"))
        parts.append(wide.select(*[col(k) for k in by], F.inline("_all")))
    return checkpointed(reduce(DataFrame.unionByName, parts))


def large_group_quantiles(
    long: DataFrame, keys: Sequence[str], probs: Sequence[float], one_task: int, facts: DataFrame
) -> DataFrame:
    """``keys..., pi, q`` for groups of any size; ``long`` has a double column ``value``, ``facts`` its ``keys..., n, lo, hi``."""
    keys = list(keys)
    every = F.inline(F.array(*[F.struct(F.lit(i).alias("pi"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    wanted = facts.select(*[col(k) for k in keys], "n", "lo", "hi", every).withColumn("pos", (F.col("n") - 1) * F.col("p"))
    open_targets = wanted.select(*[col(k) for k in keys], "pi", "pos", "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside"))
    done: list[DataFrame] = []
    for turn in range(ROUNDS):
        # At first all targets of a group share their bins.
        ranges = facts.select(*[col(k) for k in keys], "lo", "hi") if turn == 0 else open_targets
        by = [*keys] if turn == 0 else [*keys, "pi"]
        bins = (
            _attach(long, ranges, keys, turn > 0)
            .groupBy(*[col(k) for k in by], _bin().alias("bin"))
            .agg(F.count(F.lit(1)).alias("c"), F.min("value").alias("least"), F.max("value").alias("most"))
        )
        narrowed = _small(_narrowed(checkpointed(bins), open_targets, keys, by))
        done.append(narrowed.where("a is not null").select(*[col(k) for k in keys], "pi", "pos", "a", "b"))
        open_targets = narrowed.where("a is null").drop("a", "b")
        most = open_targets.agg(F.max("inside")).first()[0] or 0
        if most <= one_task:
            break
    if most:
        group = [*keys, "pi", "pos", "below"]
        candidates = _attach(long, open_targets, keys, True)
        ranked = rank_values(count_values(candidates, group), group, int(most), one_task=one_task)
        first = F.col("below") + F.col("before")
        low, high = F.floor("pos"), F.ceil("pos")
        holds = lambda k: (first <= k) & (k < first + F.col("w"))
        done.append(
            ranked.where(holds(low) | holds(high))
            .groupBy(*[col(k) for k in keys], "pi", "pos")
            .agg(F.max(F.when(holds(low), F.col("value"))).alias("a"), F.max(F.when(holds(high), F.col("value"))).alias("b"))
        )
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    part = F.col("pos") - F.floor("pos")
    return found.select(*[col(k) for k in keys], "pi", F.when(part == 0, F.col("a")).otherwise(F.col("a") * (1 - part) + F.col("b") * part).alias("q"))


def _bin() -> Column:
    """The place of ``value`` among ``BINS`` equal parts of lo to hi; halves keep a wide range from overflowing."""
    half = F.col("hi") / 2 - F.col("lo") / 2
    part = F.when(half > 0, (F.col("value") / 2 - F.col("lo") / 2) / half * BINS).otherwise(F.lit(0.0))
    value = F.col("value")
    return (
        F.when(value == F.lit(float("-inf")), F.lit(-1))
        .when(value == F.lit(float("inf")), F.lit(BINS + 1))
        .otherwise(F.floor(part).cast("int"))
    )


def _narrowed(bins: DataFrame, targets: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Each target narrowed to the bin of its position; ``a`` and ``b``, the neighbouring values, where that settles it."""
    order = Window.partitionBy(*[col(k) for k in by]).orderBy("bin")
    upto = bins.withColumn("upto", F.sum("c").over(order))
    renamed = upto.select(*[col(k).alias(f"_b_{k}") for k in by], "c", "least", "most", "upto")
    same = [targets[k].eqNullSafe(renamed[f"_b_{k}"]) for k in by]
    start, stop = F.col("below") + F.col("upto") - F.col("c"), F.col("below") + F.col("upto")
    low, high = F.floor("pos"), F.ceil("pos")
    held = targets.join(renamed, same).where(((start <= low) & (low < stop)) | ((start <= high) & (high < stop)))
    both = held.groupBy(*[col(k) for k in keys], "pi", "pos").agg(
        F.count(F.lit(1)).alias("bins"),
        F.min("least").alias("least"),
        F.min("most").alias("low_most"),
        F.max("least").alias("high_least"),
        F.max("most").alias("most"),
        F.min(start).alias("below"),
        F.sum("c").alias("inside"),
    )
    apart, single = F.col("bins") == 2, F.col("least") == F.col("most")
    return both.select(
        *[col(k) for k in keys],
        "pi",
        "pos",
        F.col("least").alias("lo"),
        F.col("most").alias("hi"),
        "below",
        "inside",
        F.when(apart, F.col("low_most")).when(single, F.col("least")).alias("a"),
        F.when(apart, F.col("high_least")).when(single, F.col("least")).alias("b"),
    )


def _small(df: DataFrame) -> DataFrame:
    """A literal table when its size allows, a checkpoint otherwise; either way worked out once."""
    copy = local_copy(df, limits.BROADCAST_ROWS)
    return checkpointed(df) if copy is None else copy


def _attach(long: DataFrame, targets: DataFrame, keys: Sequence[str], inside: bool) -> DataFrame:
    """Each value next to every target of its group, or with ``inside`` those whose range holds it.

    Targets within ``limits.BROADCAST_ROWS`` are broadcast. More of them meet
    the values by a shuffle; each is repeated for some salts then, since its
    group is a large one by construction.
    """
    renamed = targets.select(*[col(k).alias(f"_t_{k}") for k in keys], *[col(c) for c in targets.columns if c not in keys])
    extra = (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")) if inside else F.lit(True)
    copy = local_copy(renamed, limits.BROADCAST_ROWS)
    if copy is not None:
        near = F.broadcast(copy)
        same = [long[k].eqNullSafe(near[f"_t_{k}"]) for k in keys]
        joined = long.join(near, [*same, extra] if inside else same)
    else:
        salted = long.withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)))
        near = renamed.withColumn("_t__salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        same = [salted[k].eqNullSafe(near[f"_t_{k}"]) for k in [*keys, "_salt"]]
        joined = salted.join(near, [*same, extra] if inside else same).drop("_salt", "_t__salt")
    return joined.drop(*[f"_t_{k}" for k in keys])

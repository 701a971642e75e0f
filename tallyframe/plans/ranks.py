"""Value counts with the number of rows that sort before each value.

This is the shared base of exact quantiles inside a bracket, average ranks
(Spearman) and order counts (Kendall). Equal values are folded into one row
with a weight before anything is sorted, so a value that fills a third of the
table costs one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tallyframe import limits

from .storage import checkpointed


def count_values(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return long.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("w"))


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    """Equality of key columns in which missing equals missing."""
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names], F.lit(True))


def rank_values(
    counts: DataFrame,
    keys: Sequence[str],
    largest_group: int,
    value: str = "value",
    one_task: int | None = None,
    also: Sequence[str] = (),
) -> DataFrame:
    """Add ``before``: rows of the same key with a smaller value. ``also`` names more weights than ``w``; each gets its ``before_...``.

    ``largest_group`` bounds the distinct values of one key. Under the
    one-task bound a plain window does; beyond it the values are range
    partitioned, summed per partition, and offset by the partitions before.
    """
    one_task = limits.ONE_TASK_ROWS if one_task is None else one_task
    keys = list(keys)
    weights = {"before": "w"} | {f"before_{c}": c for c in also}

    def running(column: str, window: WindowSpec) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    if largest_group <= one_task:
        walk = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(value)
        return counts.select("*", *[running(c, walk).cast("long").alias(b) for b, c in weights.items()])

    parts = max(2, -(-largest_group // max(1, one_task // 2)))
    shuffle_parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = counts.repartitionByRange(max(parts, shuffle_parts), *keys, value)
    placed = checkpointed(spread.withColumn("_part", F.spark_partition_id()))

    # A range partition holds a contiguous run of (key, value), so there are
    # at most (keys + partitions) sums.
    sums = placed.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_sum_{c}") for c in weights.values()])
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part")
    offsets = sums.select(*keys, "_part", *[running(f"_sum_{c}", earlier).alias(f"_offset_{b}") for b, c in weights.items()])
    inside = Window.partitionBy(*keys, "_part").orderBy(value)
    local = placed.select("*", *[running(c, inside).alias(f"_inside_{b}") for b, c in weights.items()])
    joined = local.join(offsets, _same(local, offsets, [*keys, "_part"]))
    return joined.select(
        *[local[c] for c in counts.columns],
        *[(F.col(f"_inside_{b}") + F.col(f"_offset_{b}")).cast("long").alias(b) for b in weights],
    )


# A value is hot from a thousandth of all rows on: at most a thousand per ranking.
HOT_SHARE = 1_000
HOT_SPREAD = 256


def join_by_value(
    rows: DataFrame,
    ranks: DataFrame,
    on: Sequence[tuple[str, str]],
    take: dict[str, str],
    rows_total: int,
    ranks_total: int,
) -> DataFrame:
    """Attach columns of a rank table (unique per key) to rows, whatever the skew.

    A small rank table is broadcast. Otherwise only hot values are, and the
    rest meet through a shuffle; there the rows of hot values, which need
    nothing more, carry no key but a running number, and so spread evenly.
    """
    right = ranks.select(
        *[F.col(r).alias(f"_r{n}") for n, (_, r) in enumerate(on)], "w", *[F.col(s).alias(d) for d, s in take.items() if d != "w"]
    )
    names = [d for d in take if d != "w"]
    keys = range(len(on))
    if ranks_total <= limits.BROADCAST_ROWS:
        small = F.broadcast(right.drop("w"))
        same = reduce(lambda x, y: x & y, [F.col(left) == F.col(f"_r{n}") for n, (left, _) in enumerate(on)])
        return rows.join(small, same).drop(*[f"_r{n}" for n in keys])
    hot_from = max(1, rows_total // HOT_SHARE)
    hot = right.where(F.col("w") > hot_from).select(
        *[F.col(f"_r{n}").alias(f"_h{n}") for n in keys], *[F.col(d).alias(f"_h_{d}") for d in names]
    )
    cold = right.where(F.col("w") <= hot_from).drop("w")
    is_hot = reduce(lambda x, y: x & y, [F.col(left) == F.col(f"_h{n}") for n, (left, _) in enumerate(on)])
    marked = rows.join(F.broadcast(hot), is_hot, "left")
    settled = F.col("_h0").isNotNull()
    marked = marked.withColumns(
        {f"_k{n}": F.when(~settled, F.col(left)) for n, (left, _) in enumerate(on)}
        | {"_salt": F.when(settled, F.monotonically_increasing_id() % HOT_SPREAD).otherwise(F.lit(0).cast("bigint"))}
    )
    cold = cold.withColumn("_cold_salt", F.lit(0).cast("bigint"))
    same = reduce(lambda x, y: x & y, [F.col(f"_k{n}") == F.col(f"_r{n}") for n in keys])
    met = marked.join(cold, same & (F.col("_salt") == F.col("_cold_salt")), "left")
    kept = [F.col(c) for c in rows.columns]
    return met.select(*kept, *[F.coalesce(F.col(f"_h_{d}"), F.col(d)).alias(d) for d in names])

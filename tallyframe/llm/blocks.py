"""Windows of a sequence gathered into blocks by their minimizers.

Every window of ``window`` units takes the smallest hash of the ``gram``-unit
runs inside it, its minimizer. Equal windows have equal minimizers, so whatever
is to be found out about equal windows is found out among the blocks of one
minimizer. A block is a run of consecutive windows whose minimizer stands at
the same place, so that no two windows of a block are equal; there are about ``(window - gram) / 2`` times fewer blocks than windows.

Some runs may be very frequent: a phrase that millions of texts share in
different surroundings. Those are counted beforehand and come last in the order
by which minimizers are chosen, so that they are one only of windows that hold
nothing else, which repeat as a whole. Of equal blocks in one chunk of texts
only the first is passed on, so that no key gathers more than its distinct
blocks, once per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import _stored
from .texts import Rolling, inner_windows, signed, sliding_min


@dataclass
class Blocks:
    """Blocks of a chunk, in the order of its units."""

    key: np.ndarray
    content: np.ndarray
    row: np.ndarray
    start: np.ndarray  # first window's first unit, counted in the chunk
    n: np.ndarray  # windows
    windows: np.ndarray  # starts of all windows, block after block
    first_window: np.ndarray  # one more than blocks


def _demoted(grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Hashes with the frequent ones behind all others, each still told apart from the others."""
    ranked = grams >> np.uint64(1)
    if len(hot):
        low = np.uint64((1 << 20) - 1)
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[hot & low] = True
        at = np.flatnonzero(maybe[ranked & low])
        place = np.minimum(np.searchsorted(hot, ranked[at]), len(hot) - 1)
        ranked[at[hot[place] == ranked[at]]] |= np.uint64(1 << 63)
    return ranked


def minimizer_blocks(rolling: Rolling, first: np.ndarray, window: int, gram: int, hot: np.ndarray | None = None) -> Blocks | None:
    """Blocks of all windows that lie within one row. ``first``: each row's first unit. ``hot``: sorted frequent minimizers."""
    starts = inner_windows(first, window)
    if not len(starts):
        return None
    grams = _demoted(rolling.grams(gram), hot if hot is not None else np.zeros(0, dtype=np.uint64))
    least = sliding_min(grams, window - gram + 1)[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
    # Where a window begins with its minimizer, the next one has another, or the same value at another place.
    new[1:] |= grams[starts[:-1]] == least[:-1]
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(starts)))
    start = starts[begin]
    return Blocks(
        least[begin],
        rolling.ranges(start, start + n + (window - 1), seed=9),
        np.searchsorted(first, start, side="right") - 1,
        start,
        n,
        starts,
        np.append(begin, len(starts)),
    )


def repeats_in_chunk(blocks: Blocks, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per block the first equal block of the chunk by (rank of its row, start), and how many blocks are equal to it."""
    order = np.lexsort((blocks.start, rank[blocks.row], blocks.content, blocks.key))
    key, content = blocks.key[order], blocks.content[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    group = np.cumsum(new) - 1
    first, size = order[np.flatnonzero(new)], np.bincount(group)
    of, count = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
    of[order], count[order] = first[group], size[group]
    return of, count


#: A minimizer is frequent from this share of all blocks on, so that there are at most twice its inverse of them.
HOT_SHARE = 1e-4
_HOT_FLOOR = 8


def hot_report(blocks: Blocks | None, of: np.ndarray | None) -> pa.RecordBatch:
    """``key, n`` of the chunk's frequent minimizers among its distinct blocks, and their total under a null key."""
    keys, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = 0
    if blocks is not None:
        distinct = of == np.arange(len(of))
        keys, counts = np.unique(blocks.key[distinct], return_counts=True)
        total = int(counts.sum())
        often = counts >= max(_HOT_FLOOR, HOT_SHARE * total)
        keys, counts = keys[often] & np.uint64((1 << 63) - 1), counts[often]
    return pa.RecordBatch.from_arrays(
        [pa.array([*signed(keys).tolist(), None], pa.int64()), pa.array([*counts.tolist(), total], pa.int64())], names=["key", "n"]
    )


def hot_keys(reports: DataFrame) -> np.ndarray:
    """The frequent minimizers, sorted; fewer than ``2 / HOT_SHARE`` of them come to the driver."""
    counts = _stored(reports.groupBy("key").agg(F.sum("n").alias("n")), "frequent-keys")
    total = counts.filter("key is null").agg(F.sum("n")).first()[0] or 0
    keys = counts.filter(F.col("key").isNotNull() & (F.col("n") >= max(64, HOT_SHARE / 2 * total))).select("key")
    return np.sort(np.array([r[0] for r in keys.collect()], dtype=np.int64).view(np.uint64))


def row_order(batch: pa.RecordBatch) -> np.ndarray:
    """Each row's rank by (doc_id, twin), null ids last; rows equal in both share a rank."""
    ids = batch.column(batch.schema.get_field_index("doc_id"))
    unnamed = np.asarray(ids.is_null())
    number = np.asarray(ids.fill_null(0))
    twin = np.asarray(batch.column(batch.schema.get_field_index("twin")))
    order = np.lexsort((twin, number, unnamed))
    new = np.ones(len(order), dtype=np.int64)
    if len(order):
        new[0] = 0
        new[1:] = (number[order][1:] != number[order][:-1]) | (twin[order][1:] != twin[order][:-1]) | (unnamed[order][1:] != unnamed[order][:-1])
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return rank


PLACE = ("unnamed", "doc_id", "twin", "start")


def place() -> Column:
    """Where a block or window stands, in the order of documents (null ids last) and of units."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "twin", "start")


def compared(blocks: DataFrame, content: str = "content") -> DataFrame:
    """``blocks`` with ``several`` (the key has different contents), and the first and last place of the same content.

    One sort by key, content and place serves all three; a partition that does not fit in memory spills.
    """
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    by_key = Window.partitionBy("key").orderBy(content, *PLACE).rowsBetween(*whole)
    equal = Window.partitionBy("key", content).orderBy(*PLACE).rowsBetween(*whole)
    return (
        blocks.withColumn("unnamed", F.col("doc_id").isNull())
        .withColumn("several", F.first(content).over(by_key) != F.last(content).over(by_key))
        .withColumn("top", F.first(place()).over(equal))
        .withColumn("end", F.last(place()).over(equal))
    )


def window_pieces(size: int) -> Column:
    """``windows`` cut into the hash of each window."""
    return F.transform(
        F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("windows"), i * size + 1, F.lit(size))
    )


def with_twin(documents: DataFrame) -> DataFrame:
    """``doc_id, twin, text``: ``twin`` tells rows of one id with different texts apart."""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.shiftright(F.xxhash64("text"), 32).cast("int").alias("twin"), F.col("text")
    )


def slices(total: int, size: int = 1 << 17) -> Iterator[slice]:
    for a in range(0, total, size):
        yield slice(a, min(total, a + size))

"""Benchmark decontamination by spaced seeds.

A mask is a fixed pattern over consecutive words that looks at some of them and
ignores the others, so that a substituted word does not break the seeds whose
masks ignore it. The seeds of all masks at every word of every training text
are joined to those of the benchmark items. Hits vote for a diagonal of text
and item; around it the words of both are compared, and an overlap counts if
enough words agree, with few substitutions between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import _stored
from .shipping import ship
from .texts import LETTERED, Rolling, chunks, inner_windows, keyed, mix, packed, signed, unpacked, words

# The masks. Seven of eleven words count.
MASKS = ("11010011011", "11101001011", "10110110011")

# The masks of short items by their length. Whatever DEFAULT_OVERLAP counts in such an item has a seed of them.
SHORT_MASKS = {
    5: ("1111",), 6: ("11111",), 7: ("11101",), 8: ("111011",), 9: ("111011",), 10: ("111011",), 11: ("111011", "111101"), 12: ("110010101",),
}


@dataclass(frozen=True)
class Overlap:
    """When an overlap counts.

    matched: words that must agree, or the share ``item_share`` of an item's words where those are fewer.
    mismatch: how many agreeing words a substitution costs, which bounds their share within an overlap.
    min_item: items with fewer words are too short to tell and are found as whole texts only.
    broadcast_rows: seeds of a benchmark that may be broadcast; more are joined by a shuffle.
    """

    matched: int = 13
    item_share: float = 0.7
    mismatch: float = 2.0
    min_item: int = 5
    broadcast_rows: int = 2_000_000


DEFAULT_OVERLAP = Overlap()


def _seeds(codes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The hash of the words a mask looks at, by its first place."""
    n = len(codes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for at, bit in enumerate(mask):
        if bit == "1":
            factor = mix(np.array([at + 1], dtype=np.uint64), 31)[0] | np.uint64(1)
            total += codes[at : at + n] * factor
    return mix(total, 40 + number)


@dataclass(frozen=True)
class Mask:
    """``lengths``: the items that use it, or all from 13 words on. ``whole``: only texts that have no other words are looked at."""

    bits: str
    number: int
    lengths: tuple[int, ...] = ()
    whole: bool = False

    def of_item(self, n: int) -> bool:
        return n in self.lengths if self.lengths else n > max(SHORT_MASKS)


def _row_seeds(chunk, masks: tuple[Mask, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per mask: rows, places in words, and seeds."""
    found = words(chunk, LETTERED, lower=True)
    row_of = found.row_of()
    sizes = np.diff(found.first)
    for mask in masks:
        starts = inner_windows(found.first, len(mask.bits))
        rows = row_of[starts]
        if mask.whole:
            own = sizes[rows] == len(mask.bits)
            starts, rows = starts[own], rows[own]
        yield rows, (starts - found.first[rows]).astype(np.int32), signed(_seeds(found.codes, mask.bits, mask.number)[starts])


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """``item_key, item_id, codes``: hashes of each item's words. Texts without words are left out; equal rows count once."""
    ship(benchmark.sparkSession)
    rows = benchmark.select(F.xxhash64("item_id", "text").alias("item_key"), F.col("item_id").cast("long").alias("item_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            found = words(chunk, LETTERED, lower=True)
            codes = [signed(found.codes[a:b]) for a, b in zip(found.first, found.first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [chunk.rows.column(0), chunk.rows.column(1), pa.array(codes, pa.list_(pa.int64()))], names=["item_key", "item_id", "codes"]
            )

    items = rows.mapInArrow(run, "item_key long, item_id long, codes array<long>")
    return items.filter(F.size("codes") > 0).dropDuplicates(["item_key"])


def _masks_for(items: DataFrame, overlap: Overlap) -> tuple[Mask, ...]:
    """The fixed masks, those of the short lengths that occur, and one of all words per length under ``min_item`` (few lengths, one row each)."""
    longest = max(*SHORT_MASKS, overlap.min_item - 1)
    sizes = sorted(r["n"] for r in items.filter(F.size("codes") <= longest).select(F.size("codes").alias("n")).distinct().collect())
    short: dict[str, list[int]] = {}
    for n in sizes:
        if n >= overlap.min_item:
            for bits in SHORT_MASKS.get(n, ("1" * n,)):
                short.setdefault(bits, []).append(n)
    wholes = [n for n in sizes if n < overlap.min_item]
    masks = [(bits, (), False) for bits in MASKS] + [(bits, tuple(n), False) for bits, n in short.items()] + [("1" * n, (n,), True) for n in wholes]
    return tuple(Mask(bits, number, lengths, whole) for number, (bits, lengths, whole) in enumerate(masks))


def item_seeds(items: DataFrame, masks: tuple[Mask, ...]) -> DataFrame:
    """``seed, item_key, place``; a mask made for some lengths is used by items of those only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, keys, places = [], [], []
            for key, codes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.asarray(codes.values).view(np.uint64)
                for mask in masks:
                    if mask.of_item(len(own)):
                        found = signed(_seeds(own, mask.bits, mask.number))
                        seeds += found.tolist()
                        keys += [key] * len(found)
                        places += range(len(found))
            yield pa.RecordBatch.from_arrays([pa.array(seeds, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.int32())], names=["seed", "item_key", "place"])

    return items.select("item_key", "codes").mapInArrow(run, "seed long, item_key long, place int")


def text_seeds(documents: DataFrame, masks: tuple[Mask, ...]) -> DataFrame:
    """``row_key, seed, pos`` of every mask at every word of every whole text."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            keys = chunk.rows.column(0).to_numpy()
            for rows, places, seeds in _row_seeds(chunk, masks):
                for a in range(0, len(rows), 1 << 18):
                    part = slice(a, a + (1 << 18))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[rows[part]]), pa.array(seeds[part]), pa.array(places[part])], names=["row_key", "seed", "pos"]
                    )

    return keyed(documents).select("row_key", "text").mapInArrow(run, "row_key long, seed long, pos int")


def best_overlap(text: np.ndarray, item: np.ndarray, diagonal: int, mismatch: float) -> tuple[int, int, int]:
    """On one diagonal the stretch of the item with the most agreeing words after substitutions are paid for: (words, first, end)."""
    low, high = max(0, -diagonal), min(len(item), len(text) - diagonal)
    if low >= high:
        return 0, 0, 0
    same = text[low + diagonal : high + diagonal] == item[low:high]
    gain = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -mismatch))])
    rise = gain - np.minimum.accumulate(gain)
    end = int(rise.argmax())
    first = int(np.flatnonzero(gain[: end + 1] == gain[: end + 1].min())[-1])
    return int(same[first:end].sum()), low + first, low + end


def overlaps(documents: DataFrame, benchmark: DataFrame, overlap: Overlap = DEFAULT_OVERLAP) -> DataFrame:
    """``row_key, doc_id, item_id, n_matched, n_item_words, first_word, end_word``: the best overlap of each text and item that counts.

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower
    case. Null texts overlap nothing; rows that repeat id and text are one
    document and give one row per item. Empty tables give an empty result.
    """
    items = _stored(benchmark_items(benchmark), "benchmark-items")
    masks = _masks_for(items, overlap)
    seeds = _stored(item_seeds(items, masks), "benchmark-seeds")
    bounded = seeds.count() <= overlap.broadcast_rows
    hits = (
        text_seeds(documents, masks)
        .join(F.broadcast(seeds) if bounded else seeds, "seed")
        .groupBy("row_key", "item_key", (F.col("pos") - F.col("place")).alias("diagonal"))
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    per_item = hits.groupBy("row_key", "item_key").agg(F.collect_list("diagonal").alias("diagonals"))
    wanted = (
        per_item.join(F.broadcast(items) if bounded else items, "item_key")
        .groupBy("row_key")
        .agg(F.collect_list(F.struct("item_id", "codes", "diagonals")).alias("wanted"))
    )
    limits = overlap
    names = ["row_key", "doc_id", "item_id", "n_matched", "n_item_words", "first_word", "end_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(unpacked(batches, 256)):
            found = words(chunk, LETTERED, lower=True)
            out: list[tuple] = []
            keys, ids = chunk.rows.column(0).to_pylist(), chunk.rows.column(1).to_pylist()
            for row, own in enumerate(chunk.rows.column(chunk.rows.schema.get_field_index("wanted"))):
                text = found.codes[found.first[row] : found.first[row + 1]]
                for w in own.as_py():
                    item = np.array(w["codes"], dtype=np.int64).view(np.uint64)
                    best = max((*best_overlap(text, item, d, limits.mismatch), d) for d in w["diagonals"])
                    n, first, end, diagonal = best
                    if len(item) < limits.min_item and not (len(text) == len(item) == n):
                        continue
                    if n >= min(limits.matched, limits.item_share * len(item)):
                        out.append((keys[row], ids[row], w["item_id"], n, len(item), first + diagonal, end + diagonal))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return packed(documents).dropDuplicates(["row_key"]).join(wanted, "row_key").select("row_key", "doc_id", "packed", "wanted").mapInArrow(
        run, ", ".join(f"{n} long" for n in names)
    )


def contamination_report(documents: DataFrame, benchmark: DataFrame, overlap: Overlap = DEFAULT_OVERLAP) -> DataFrame:
    """One row per contaminated document and benchmark item: how many of the item's words, and where in the text."""
    return overlaps(documents, benchmark, overlap).drop("row_key")


def clean_documents(documents: DataFrame, benchmark: DataFrame, overlap: Overlap = DEFAULT_OVERLAP) -> DataFrame:
    """The documents that overlap no benchmark item, with their own columns."""
    found = overlaps(documents.select("doc_id", "text"), benchmark, overlap).select(F.col("row_key").alias("__row_key")).distinct()
    return documents.join(found, F.xxhash64("doc_id", "text") == F.col("__row_key"), "left_anti")

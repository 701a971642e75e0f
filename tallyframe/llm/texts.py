"""Texts as byte buffers inside a task: Arrow batches in, numpy arrays of words and hashes out.

A column of texts is one contiguous buffer in Arrow, so words, their hashes and
the hashes of word or byte windows come from a handful of array operations per
buffer, without a Python object per word. Memory is a fixed multiple of
``CHUNK_BYTES`` (or of one text, where that is longer).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shipping import ship

CHUNK_BYTES = 1 << 20

#: For operators that look for repetitions within a chunk before rows are passed on.
WIDE_CHUNK_BYTES = 1 << 21

# Odd 64-bit multipliers of the published splitmix and murmur finalisers.
_SPLIT = 0x9E3779B97F4A7C15
_MIX_A = 0xBF58476D1CE4E5B9
_MIX_B = 0x94D049BB133111EB

BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values under which nearby inputs look unrelated."""
    x = x + np.uint64((_SPLIT * (seed + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX_B)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(256, dtype=np.uint64), 7)


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        table = np.cumprod(steps)
        if n <= WIDE_CHUNK_BYTES + 1:  # a longer one is for one long text only
            _powers[base] = table
    return table


class Rolling:
    """Hashes of any ranges of one sequence of 64-bit codes, each in constant time."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes * _power_table(BASE, n)[:n], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """The hash of each ``[start, end)``; equal contents have equal hashes wherever they stand."""
        back = _power_table(_INVERSE, len(self.sums))
        raw = (self.sums[ends] - self.sums[starts]) * back[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(_MIX_A), seed)

    def grams(self, k: int, seed: int = 0) -> np.ndarray:
        """The hash of each run of ``k`` codes, by its first place."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, dtype=np.uint64)
        back = _power_table(_INVERSE, n)
        raw = (self.sums[k:] - self.sums[:-k]) * back[: n - k + 1]
        return mix(raw + np.uint64((k * _MIX_A) % (1 << 64)), seed)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        rest = width - span
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out


def _byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: Bytes of words that white space separates, and of words of letters, digits and non-ASCII characters.
SPACED = ~_byte_class((0x20, 0x20), (0x09, 0x0D))
LETTERED = _byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Chunk:
    """Some consecutive rows of a batch and the bytes of their texts; a null text is empty."""

    rows: pa.RecordBatch
    bytes: np.ndarray
    offsets: np.ndarray  # one more than rows

    def text(self, row: int) -> bytes:
        return self.bytes[self.offsets[row] : self.offsets[row + 1]].tobytes()


@cache
def _heap_trim():
    """The C library's call that hands free memory back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def hand_back() -> None:
    """Give memory that is free again back to the machine: a worker outlives its task, and other stages run beside it."""
    pa.default_memory_pool().release_unused()
    trim = _heap_trim()
    if trim is not None:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Rows in their order, cut so that a chunk has at most ``limit`` bytes of text, or one row."""
    try:
        yield from _chunks(batches, column, limit)
    finally:
        hand_back()


def _chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[Chunk]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if not (pa.types.is_string(texts.type) or pa.types.is_binary(texts.type)):
            texts = texts.cast(pa.binary() if pa.types.is_large_binary(texts.type) else pa.string())
        if texts.null_count:
            texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
        if not len(texts):
            continue
        _, places, data = texts.buffers()
        offsets = np.frombuffer(places, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        first = 0
        while first < len(texts):
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), len(texts))
            here = offsets[first : last + 1]
            yield Chunk(batch.slice(first, last - first), data[here[0] : here[-1]], here - here[0])
            first = last


@dataclass
class Words:
    """The words of a chunk: byte ranges, hashes, and where each row's words begin."""

    start: np.ndarray
    end: np.ndarray
    codes: np.ndarray
    first: np.ndarray  # one more than rows

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(chunk: Chunk, members: np.ndarray = SPACED, lower: bool = False) -> Words:
    """Maximal runs of member bytes, never across rows. ``lower`` folds A-Z first."""
    data = LOWER[chunk.bytes] if lower else chunk.bytes
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none.astype(np.uint64), np.zeros(len(chunk.offsets), dtype=np.int64))
    inside = members[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[chunk.offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    codes = Rolling(BYTE_CODES[data]).ranges(start, end)
    return Words(start, end, codes, np.searchsorted(start, chunk.offsets))


def inner_windows(first: np.ndarray, length: int) -> np.ndarray:
    """Starts of all windows of ``length`` units that lie within one row, given each row's first unit."""
    total = int(first[-1])
    keep = np.zeros(total + 1, dtype=np.int64)
    fits = np.diff(first) >= length
    np.add.at(keep, first[:-1][fits], 1)
    np.add.at(keep, first[1:][fits] - length + 1, -1)
    return np.flatnonzero(np.cumsum(keep[:-1]) > 0)


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.view(np.int64)


#: Fast and light enough that packed texts pass through a shuffle at about the size of their files.
PACK_LEVEL = 3


def keyed(documents: DataFrame) -> DataFrame:
    """``row_key, doc_id, text``: the key is a hash of both, so that rows with one id and different texts stay apart.

    Rows that repeat an id with the same text share a key; what is found out
    by key is the same for all of them.
    """
    return documents.select(F.xxhash64("doc_id", "text").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def packed(documents: DataFrame) -> DataFrame:
    """``keyed`` with compressed texts in ``packed``, for joins that have to move them."""
    return pack_texts(keyed(documents))


def pack_texts(df: DataFrame) -> DataFrame:
    """``df`` with ``text`` replaced by ``packed`` (binary), the compressed text."""
    ship(df.sparkSession)
    types = ", ".join("packed binary" if f.name == "text" else f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(_pack, types)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=PACK_LEVEL).compress
    try:
        yield from _packed_batches(batches, pack)
    finally:
        hand_back()


def _packed_batches(batches: Iterator[pa.RecordBatch], pack) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        names = ["packed" if i == at else n for i, n in enumerate(batch.schema.names)]
        for first in range(0, batch.num_rows, 2048):
            part = batch.slice(first, 2048)
            texts = part.column(at).cast(pa.binary())
            out = pa.array([pack(t.as_buffer()) if t.is_valid else None for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([out if i == at else c for i, c in enumerate(part.columns)], names=names)


def unpacked(batches: Iterator[pa.RecordBatch], rows: int = 1024, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches with ``packed`` replaced by ``text`` (bytes): at most so many rows, and of more than one row at most ``limit`` bytes of text."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        at = batch.schema.get_field_index("packed")
        names = ["text" if i == at else n for i, n in enumerate(batch.schema.names)]
        column = batch.column(at)
        sizes = [zstandard.frame_content_size(p.as_buffer()) if p.is_valid else 0 for p in column]
        first = 0
        while first < batch.num_rows:
            last, held = first + 1, sizes[first]
            while last < batch.num_rows and last - first < rows and held + sizes[last] <= limit:
                held += sizes[last]
                last += 1
            part = batch.slice(first, last - first)
            texts = pa.array([unpack(p.as_buffer()) if p.is_valid else None for p in part.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(part.columns)], names=names)
            first = last
"""Byte-level BPE: encoding texts to token ids by a file of ranked merges, and decoding them.

Each worker encodes a distinct word once and keeps the answer, so the merges
fold over distinct words, while frequent words cost a dictionary lookup. The
ranks are a literal table of bounded size (the vocabulary), shipped once to
every executor; no executor opens a file.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shipping import ship
from .texts import hand_back

#: Distinct words whose ids a worker keeps; beyond it the table starts anew. A matter of memory, never of results.
KEPT_WORDS = 100_000
_HEAP_FROM = 96
_NEVER = 1 << 62

Ranks = dict[bytes, int]


def load_ranks(path: str) -> Ranks:
    """Token bytes to rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def splitter(pattern: str) -> regex.Pattern:
    """The pre-tokenising pattern with white space as Unicode's White_Space, which leaves out U+001C to U+001F."""
    return regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


def merge_word(word: bytes, ranks: Ranks) -> list[int]:
    """Ids of one word: the leftmost pair of lowest rank merges, again and again."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    cuts = _merge_long(word, ranks) if len(word) >= _HEAP_FROM else _merge_short(word, ranks)
    return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]


def _merge_short(word: bytes, ranks: Ranks) -> list[int]:
    rank = ranks.get
    cuts = list(range(len(word) + 1))
    pairs = [rank(word[i : i + 2], _NEVER) for i in range(len(word) - 1)]
    while pairs:
        best = min(pairs)
        if best == _NEVER:
            break
        i = pairs.index(best)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = rank(word[cuts[i] : cuts[i + 2]], _NEVER)
        if i:
            pairs[i - 1] = rank(word[cuts[i - 1] : cuts[i + 1]], _NEVER)
    return cuts


def _merge_long(word: bytes, ranks: Ranks) -> list[int]:
    """The same merges over a linked list and a heap, so that a very long word takes n log n steps."""
    n = len(word)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    alive = [True] * n

    def pair(i: int) -> int:
        j = after[i]
        return ranks.get(word[i : after[j]], _NEVER) if j < n else _NEVER

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := pair(i)) != _NEVER]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or after[after[i]] != end:
            continue
        j = after[i]
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
        for at in (i, before[i]):
            if at >= 0 and (r := pair(at)) != _NEVER:
                heapq.heappush(heap, (r, at, after[after[at]]))
    return [i for i in range(n) if alive[i]] + [n]


class _WordIds(dict):
    """Word to its packed ids, filled as words come."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = np.array(merge_word(word.encode(), self.ranks), dtype="<u4").tobytes()
        if len(ids) <= 256:
            self[word] = ids
        return ids


_worker_tables: dict[int, _WordIds] = {}


def _word_ids(key: int, ranks: Ranks) -> _WordIds:
    table = _worker_tables.get(key)
    if table is None:
        _worker_tables.clear()
        table = _worker_tables[key] = _WordIds(ranks)
    return table


@cache
def _table_key(path: str) -> int:
    with open(path, "rb") as file:
        return zlib.crc32(file.read())


def _replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    at = batch.schema.get_field_index(name)
    arrays = [values if i == at else batch.column(i) for i in range(batch.num_columns)]
    return pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """``df`` with ``ids`` (binary: little-endian unsigned 32-bit token ids) and ``n_tokens`` (long).

    Every match of ``pattern`` is encoded by itself, without special tokens. A
    null or empty text has no ids. Columns of ``df`` named like the two new
    ones are replaced; all others, and repeated rows, stay as they are.
    """
    spark = df.sparkSession
    ship(spark)
    key, ranks = _table_key(ranks_path), spark.sparkContext.broadcast(load_ranks(ranks_path))
    base = df.drop(*[c for c in (ids, n_tokens) if c != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, split = _word_ids(key, ranks.value), splitter(pattern).findall
        try:
            yield from encoded(batches, table, split)
        finally:
            hand_back()

    def encoded(batches: Iterator[pa.RecordBatch], table: _WordIds, split) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                packed = [b"".join([table[word] for word in split(t)]) if t else b"" for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())],
                    names=[*part.schema.names, ids, n_tokens],
                )

    schema = T.StructType([*base.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType())])
    return base.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``ids`` replaced by ``out`` (binary): the tokens' bytes put together. Null or no ids give no bytes."""
    spark = df.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))
    base = df.drop(out) if out != ids else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = np.empty(max(ranks.value.values(), default=-1) + 1, dtype=object)
        for piece, rank in ranks.value.items():
            pieces[rank] = piece
        for batch in batches:
            packed = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = [b"".join(pieces[np.frombuffer(p, dtype="<u4")].tolist()) if p else b"" for p in packed]
            yield _replaced(batch, ids, pa.array(texts, pa.binary())).rename_columns(
                [out if c == ids else c for c in batch.schema.names]
            )
        hand_back()

    fields = [T.StructField(out, T.BinaryType()) if f.name == ids else f for f in base.schema.fields]
    return base.mapInArrow(run, T.StructType(fields))


def token_digests(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document its token count and the SHA-256 of its ids and of the bytes they decode to.

    Null and empty texts count as empty; repeated rows each give a row.
    """
    encoded = encode(documents.select("doc_id", "text"), ranks_path, pattern).drop("text")
    hashed = encoded.withColumn("ids_sha256", F.sha2("ids", 256))
    return decode(hashed, ranks_path).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )

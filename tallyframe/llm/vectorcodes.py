"""Codes for vectors: each is cut into parts, and a part becomes the index of its nearest codebook entry.

The nearest entry is found by equal-average search. For d components, the
squared difference of two vectors' sums is at most d times their squared
distance. So the entries are kept in the order of their sums, a part starts at
its own sum's place among them and walks outward on both sides, and a side is
done once its squared sum gap over d strictly exceeds the best distance so far;
equal bounds are still looked at, so ties are exact. All arithmetic is on
integers.

A codebook has a bounded size (parts x entries x components) and is the only
thing that passes through the driver, once per round. Tasks send one sum per
entry they used, however often a vector is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe import limits

from ..plans.storage import scratch_path
from .shipping import ship

#: Parts that are searched side by side.
BLOCK_ROWS = 4_096

#: Scaled components stay below this, so that 2,048 squared differences fit a long.
LARGEST = 1 << 25

#: Gaps between sums count as at most this, whose square fits a long; a smaller gap only keeps a side open.
WIDEST_GAP = 3_037_000_000


@dataclass(frozen=True)
class Coding:
    """``parts`` codebooks of up to ``entries`` (256 at most) entries; components are floor(scale * x)."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024

    def __post_init__(self):
        if not (self.parts > 0 and 0 < self.entries <= 256 and self.rounds >= 0 and self.scale > 0):
            raise ValueError("a coding needs parts, 1 to 256 entries, a scale, and no negative rounds")


DEFAULT_CODING = Coding()


def integer_vectors(df: DataFrame, vector: str = "embedding", coding: Coding = DEFAULT_CODING, extra: Sequence[str] = ()) -> DataFrame:
    """``vec_id``, the ``extra`` columns and ``v``, the integer components, of the vectors that are kept.

    Not kept are null vectors, those with a null or non-finite component, and
    those without components. A kept component of ``LARGEST`` or more after scaling is
    an error: squared distances would not fit a long.
    """
    x = F.col(vector)
    # A NaN is greater than any number.
    good = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))

    def whole(c: Column) -> Column:
        scaled = F.floor(c.cast("double") * coding.scale)
        too_large = F.raise_error(F.lit(f"a scaled component of {LARGEST} or more")).cast("int")
        return F.when(F.abs(scaled) < LARGEST, scaled.cast("int")).otherwise(too_large)

    return df.where((F.size(x) > 0) & good).select("vec_id", *extra, F.transform(x, whole).alias("v"))


def first_codebooks(vectors: DataFrame, coding: Coding = DEFAULT_CODING) -> np.ndarray:
    """parts x entries x components: the parts of the smallest vec_ids, ascending (null ids last; equal ids by their components)."""
    rows = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(coding.entries).select("v").collect()
    if not rows:
        return np.zeros((coding.parts, 0, 0), dtype=np.int64)
    length = len(rows[0]["v"])
    if length % coding.parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {coding.parts} equal parts")
    if any(len(r["v"]) != length for r in rows):
        raise ValueError("vectors have different numbers of components")
    book = np.array([r["v"] for r in rows], dtype=np.int64)
    return np.ascontiguousarray(book.reshape(len(rows), coding.parts, -1).transpose(1, 0, 2))


class EqualAverage:
    """One part's codebook, sorted by component sum."""

    def __init__(self, book: np.ndarray):
        sums = book.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.sums, self.entries, self.d = sums[self.order], book[self.order], book.shape[1]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry (the lowest of equally near ones) and the squared distance, per row."""
        index, distance = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.int64)
        for first in range(0, len(x), BLOCK_ROWS):
            block = slice(first, first + BLOCK_ROWS)
            index[block], distance[block] = self._search(x[block])
        return index, distance

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = x.sum(axis=1)
        place = np.searchsorted(self.sums, sums)
        best = np.full(len(x), np.iinfo(np.int64).max)
        index = np.full(len(x), len(self.sums))
        # The next entry above and below, for the rows whose side is still open.
        up, down = (np.arange(len(x)), place), (np.arange(len(x)), place - 1)
        while len(up[0]) or len(down[0]):
            up = self._step(x, sums, best, index, *up, 1)
            down = self._step(x, sums, best, index, *down, -1)
        return index, best

    def _step(self, x, sums, best, index, rows, at, direction):
        """Look at one entry per open row; what stays open moves on by one."""
        inside = (at >= 0) & (at < len(self.sums))
        rows, at = rows[inside], at[inside]
        gap = np.minimum(np.abs(sums[rows] - self.sums[at]), WIDEST_GAP)
        # gap * gap > d * best, without a product that could overflow while best is still unset.
        within = (gap * gap + self.d - 1) // self.d <= best[rows]
        rows, at = rows[within], at[within]
        apart = x[rows] - self.entries[at]
        distance = np.einsum("ij,ij->i", apart, apart)
        entry = self.order[at]
        nearer = (distance < best[rows]) | ((distance == best[rows]) & (entry < index[rows]))
        hit = rows[nearer]
        best[hit], index[hit] = distance[nearer], entry[nearer]
        return rows, at + direction


def _matrix(vectors: pa.Array, length: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(vectors) * length:
        raise ValueError("vectors have different numbers of components")
    return flat.astype(np.int64).reshape(len(vectors), length)


def improved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part goes to its nearest entry, and an entry becomes floor(sum / count) of its parts."""
    parts, entries, d = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [EqualAverage(b) for b in books]
        total, count = np.zeros((parts * entries, d), dtype=np.int64), np.zeros(parts * entries, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), parts * d)
            for p, search in enumerate(searches):
                part = x[:, p * d : (p + 1) * d]
                index, _ = search.nearest(part)
                np.add.at(total, index + p * entries, part)
                count += np.bincount(index + p * entries, minlength=len(count))
        used = np.flatnonzero(count)
        lists = pa.ListArray.from_arrays(np.arange(0, len(used) * d + 1, d, dtype=np.int32), pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), lists], names=["slot", "n", "sums"])

    partial = vectors.select("v").mapInArrow(sums, "slot long, n long, sums array<long>")
    rows = partial.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(d)]).alias("sums")).collect()
    books = books.copy()
    flat = books.reshape(parts * entries, d)
    for r in rows:
        flat[r["slot"]] = np.array(r["sums"], dtype=np.int64) // r["n"]
    return books


def fit_codebooks(vectors: DataFrame, coding: Coding = DEFAULT_CODING) -> np.ndarray:
    """Codebooks after ``coding.rounds`` rounds over all vectors; unused entries stay as they are."""
    ship(vectors.sparkSession)
    books = first_codebooks(vectors, coding)
    for _ in range(coding.rounds if books.size else 0):
        books = improved(vectors, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``vectors`` with ``v`` replaced by ``codes`` (binary, one byte per part) and ``error``, the summed squared distances."""
    ship(vectors.sparkSession)
    parts, entries, d = books.shape
    at = vectors.columns.index("v")
    kept = [f for i, f in enumerate(vectors.schema.fields) if i != at]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "codes binary", "error long"])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [EqualAverage(b) for b in books]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column(at), parts * d)
            code, error = np.empty((n, parts), dtype=np.uint8), np.zeros(n, dtype=np.int64)
            for p, search in enumerate(searches):
                code[:, p], distance = search.nearest(x[:, p * d : (p + 1) * d])
                error += distance
            packed = pa.Array.from_buffers(
                pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * parts + 1, parts, dtype=np.int32)), pa.py_buffer(code)]
            )
            others = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*others, packed, pa.array(error)], names=[*[f.name for f in kept], "codes", "error"])

    return vectors.mapInArrow(codes, schema)


def decode(encoded: DataFrame, books: np.ndarray, coding: Coding = DEFAULT_CODING) -> DataFrame:
    """``encoded`` with ``codes`` replaced by ``decoded`` (array of doubles): the middles of the entries' cells."""
    ship(encoded.sparkSession)
    parts, entries, d = books.shape
    at = encoded.columns.index("codes")
    names = ["decoded" if i == at else c for i, c in enumerate(encoded.columns)]
    schema = ", ".join(f"`{n}` {'array<double>' if i == at else f.dataType.simpleString()}" for i, (n, f) in enumerate(zip(names, encoded.schema.fields, strict=True)))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            code = np.frombuffer(b"".join(batch.column(at).to_pylist()), dtype=np.uint8).reshape(n, parts)
            x = np.concatenate([books[p][code[:, p]] for p in range(parts)], axis=1)
            edges = np.arange(0, n * parts * d + 1, parts * d, dtype=np.int32)
            lists = pa.ListArray.from_arrays(edges, pa.array(((x + 0.5) / coding.scale).ravel()))
            yield pa.RecordBatch.from_arrays([lists if i == at else c for i, c in enumerate(batch.columns)], names=names)

    return encoded.mapInArrow(vectors, schema)


def codebooks_sha256(books: np.ndarray) -> str:
    """Of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the error summed over equal labels (nulls are equal).

    The totals are counted: up to ``limits.BROADCAST_ROWS`` of them are broadcast. More
    are joined by label, whose rows are few each then; adaptive execution splits a hot one.
    """
    spark = coded.sparkSession
    totals_path = scratch_path(spark, "label-errors")
    coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("_label"), "label_error").write.parquet(totals_path)
    totals = spark.read.parquet(totals_path)
    if totals.count() <= limits.BROADCAST_ROWS:
        totals = F.broadcast(totals)
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def vector_code_report(embeddings: DataFrame, coding: Coding = DEFAULT_CODING) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of the vectors that are kept.

    Rows are told apart by nothing but themselves: repeated rows and repeated
    or null ids each get their row. Vectors must have one length, divisible by
    ``coding.parts``; others raise ValueError. With fewer kept vectors than entries the
    codebooks are as small; an empty table gives an empty one. Other columns are left out.
    """
    spark = embeddings.sparkSession
    vectors = integer_vectors(embeddings.select("vec_id", "label", "embedding"), coding=coding, extra=["label"])
    books = fit_codebooks(vectors, coding)
    # Both the totals and the join need the codes: they are worked out once.
    path = scratch_path(spark, "vector-codes")
    encode(vectors, books).write.parquet(path)
    return _label_errors(spark.read.parquet(path)).select(
        "vec_id",
        F.lower(F.hex("codes")).alias("code"),
        "error",
        "label_error",
        F.lit(codebooks_sha256(books)).alias("codebooks_sha256"),
    )

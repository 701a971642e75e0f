"""Dedup of byte strings with a logarithmic family of sorted indexes.

The suffixes that matter are those at minimizers: every string of ``length``
bytes has one inside it, at the same place wherever the string stands. Of each
batch of documents these suffixes are sorted by the hash of the minimizer and
then by the hash of the text around it, and stored bucketed and sorted. This is
no lexicographic suffix array: neighbours are equal in their hashes or not, and
no length of a match is read off them. A new table is scanned together with the
table of every level: equal surroundings are long matches; equal minimizers with
other surroundings are candidates for matches that end inside. Tables of equal
size then merge to one of the next level, so that n batches leave about log n
tables and a suffix is rewritten about log n times. The family lives for one call.

Candidates are settled exactly, by a second pass over their texts: their strings
are compared in groups of sixteen offsets around the suffix first, and one by
one only where a group differs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import (
    _demoted, compared, hot_keys, hot_report, minimizer_blocks, place, repeats_in_chunk, row_order, slices, window_pieces, with_twin,
)
from .graphs import _stored
from .shipping import ship
from .texts import BYTE_CODES, WIDE_CHUNK_BYTES, Rolling, chunks, mix, pack_texts, signed, unpacked

GRAM_SHARE = 0.25
GROUP = 16  # offsets compared together
_BYTES = 6
BATCHES = 3


def _gram(length: int) -> int:
    return max(1, int(length * GRAM_SHARE))


def _blocks(chunk, length: int, hot: np.ndarray | None):
    return minimizer_blocks(Rolling(BYTE_CODES[chunk.bytes]), chunk.offsets, length, _gram(length), hot)


def _frequent(documents: DataFrame, length: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, limit=WIDE_CHUNK_BYTES):
            blocks = _blocks(chunk, length, None)
            yield hot_report(blocks, repeats_in_chunk(blocks, row_order(chunk.rows))[0] if blocks is not None else None)

    return hot_keys(with_twin(documents).mapInArrow(run, "key long, n long"))


SUFFIX = "key long, content long, doc_id long, twin int, start int, n int, state int"
POSTED, MATCHED, MATCHED_ONLY = 0, 1, 2


def suffixes(documents: DataFrame, length: int, hot) -> DataFrame:
    """The suffixes of all texts: ``n`` strings from ``start`` on have the minimizer ``key``; ``content`` is all their text.

    state: POSTED for the index; MATCHED as well within its own chunk of texts;
    MATCHED_ONLY if an equal one of the chunk stands in the index for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, limit=WIDE_CHUNK_BYTES):
            blocks = _blocks(chunk, length, hot.value)
            if blocks is None:
                continue
            rank = row_order(chunk.rows)
            of, _ = repeats_in_chunk(blocks, rank)
            at = blocks.start - chunk.offsets[blocks.row]
            elsewhere = (rank[blocks.row] != rank[blocks.row[of]]) | (at != at[of])
            matched = np.zeros(len(of), dtype=bool)
            matched[of[elsewhere]] = True
            matched = matched[of]
            leads = of == np.arange(len(of))
            state = np.where(leads, np.where(matched, MATCHED, POSTED), MATCHED_ONLY)
            spread = mix(blocks.content + blocks.start.astype(np.uint64), 1)
            ids = chunk.rows.column(chunk.rows.schema.get_field_index("doc_id"))
            twins = chunk.rows.column(chunk.rows.schema.get_field_index("twin"))
            rows = pa.array(blocks.row)
            whole = pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(np.where(leads, blocks.key, spread))),
                    pa.array(signed(blocks.content)),
                    ids.take(rows),
                    twins.take(rows),
                    pa.array(at.astype(np.int32)),
                    pa.array(blocks.n.astype(np.int32)),
                    pa.array(state.astype(np.int32)),
                ],
                names=["key", "content", "doc_id", "twin", "start", "n", "state"],
            ).filter(pa.array(leads | matched))
            for part in slices(whole.num_rows):
                yield whole.slice(part.start, part.stop - part.start)

    return with_twin(documents).mapInArrow(run, SUFFIX)


class IndexFamily:
    """Sorted suffix tables, one per level; level i holds 2**i batches. Tables that merged are dropped."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: dict[int, str] = {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.found: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """Sort the batch, scan it against every level, and let equal sizes merge."""
        array = self._sorted(batch.repartition(self.buckets, "key"))
        if not self.levels:
            self._scan(self.spark.table(array))
        for level in self.levels.values():
            self._scan(self.spark.table(array).unionByName(self.spark.table(level)))
        size = 0
        while size in self.levels:
            other = self.levels.pop(size)
            merged = self._sorted(self.spark.table(array).unionByName(self.spark.table(other)).repartition(self.buckets, "key"))
            self._drop(array)
            self._drop(other)
            array, size = merged, size + 1
        self.levels[size] = array

    def close(self) -> None:
        for table in self.levels.values():
            self._drop(table)
        self.levels = {}

    def _sorted(self, rows: DataFrame) -> str:
        name = f"suffixes_{uuid.uuid4().hex[:16]}"
        rows.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key", "content").saveAsTable(name)
        return name

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table} PURGE")

    def _scan(self, rows: DataFrame) -> None:
        """Matches of the common order: whole (equal surroundings elsewhere), or one of several that begin alike."""
        ranked = compared(rows)
        whole = (F.col("top") != F.col("end")) | (F.col("state") != POSTED)
        partial = F.col("several") & (place() == F.col("top"))
        flagged = ranked.select("key", "doc_id", "twin", "start", "n", whole.alias("whole"), partial.alias("partial"))
        self.found.append(_stored(flagged.filter("whole or partial"), "suffix-matches"))


def long_matches(documents: DataFrame, length: int, hot, batches: int = BATCHES) -> DataFrame:
    """``key, doc_id, twin, start, n, whole, partial`` of all suffixes with a match, over all batches."""
    family = IndexFamily(documents.sparkSession)
    part = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(batches))
    for number in range(batches):
        family.add(suffixes(documents.filter(part == number), length, hot))
    family.close()
    found = family.found[0]
    for more in family.found[1:]:
        found = found.unionByName(more)
    return found


def _groups(documents: DataFrame, partial: DataFrame, length: int, hot) -> DataFrame:
    """The strings of partial matches in groups of offsets: ``key, doc_id, twin, start, n, windows``."""
    wanted = (
        partial.groupBy("doc_id", "twin")
        .agg(F.collect_set(F.struct("start", "n", "key")).alias("wanted"))
        .select(F.col("doc_id").alias("w_id"), F.col("twin").alias("w_twin"), "wanted")
    )
    texts = pack_texts(with_twin(documents))
    joined = texts.join(wanted, (F.col("twin") == F.col("w_twin")) & F.col("doc_id").eqNullSafe(F.col("w_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(unpacked(batches, 64)):
            rolling = Rolling(BYTE_CODES[chunk.bytes])
            ranked = _demoted(rolling.grams(_gram(length)), hot.value)
            lists = chunk.rows.column(chunk.rows.schema.get_field_index("wanted"))
            sizes = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten()
            row = np.repeat(np.arange(len(sizes)), sizes)
            begin = np.asarray(flat.field("start")).astype(np.int64) + chunk.offsets[row]
            n, key = np.asarray(flat.field("n")).astype(np.int64), np.asarray(flat.field("key")).view(np.uint64)
            anchor = np.array([b + int(np.argmax(ranked[b : b + length] == k)) for b, k in zip(begin.tolist(), key, strict=True)], dtype=np.int64)
            which = np.repeat(np.arange(len(n)), n)
            window = begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            group = (anchor[which] - window) // GROUP
            new = np.ones(len(which), dtype=bool)
            new[1:] = (which[1:] != which[:-1]) | (group[1:] != group[:-1])
            first = np.flatnonzero(new)
            edges = np.append(first, len(which))
            hashes = rolling.ranges(window, window + length)
            hashes = np.ascontiguousarray(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES])
            of = which[first]
            rows = pa.array(row[of])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(mix(key[of] ^ group[first].astype(np.uint64), 23))),
                    chunk.rows.column(0).take(rows),
                    chunk.rows.column(1).take(rows),
                    pa.array((window[first] - chunk.offsets[row[of]]).astype(np.int32)),
                    pa.array(np.diff(edges).astype(np.int32)),
                    pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((edges * _BYTES).astype(np.int32)), pa.py_buffer(hashes)]),
                ],
                names=["key", "doc_id", "twin", "start", "n", "windows"],
            )

    return joined.select("doc_id", "twin", "packed", "wanted").mapInArrow(
        run, "key long, doc_id long, twin int, start int, n int, windows binary"
    )


def repeated_strings(documents: DataFrame, length: int, batches: int = BATCHES) -> DataFrame:
    """``doc_id, twin, start, n``: runs of ``n`` strings of ``length`` bytes that each also start anywhere else."""
    spark = documents.sparkSession
    ship(spark)
    hot = spark.sparkContext.broadcast(_frequent(documents, length))
    found = long_matches(documents, length, hot, batches)
    groups = compared(
        _groups(documents, found.filter("partial"), length, hot).repartition("key").withColumn("content", F.xxhash64("windows"))
    )
    kept = groups.filter("several or top <> end").withColumn("lead", F.col("several") & (place() == F.col("top")))
    equal = kept.filter("top <> end").select("doc_id", "twin", "start", "n")
    singles = (
        kept.filter("lead")
        .select("key", "doc_id", "twin", F.col("start").alias("block"), F.posexplode(window_pieces(_BYTES)).alias("at", "piece"))
        .withColumn("start", F.col("block") + F.col("at"))
    )
    single = compared(singles, "piece").filter("top <> end").select("doc_id", "twin", "start", F.lit(1).alias("n"))
    whole = found.filter("whole").select("doc_id", "twin", "start", "n")
    return whole.unionByName(equal).unionByName(single)


def deduplicated(documents: DataFrame, length: int = 400, batches: int = BATCHES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept (binary)`` for every row.

    A byte goes if a string of ``length`` bytes over it also starts anywhere
    else, the same document included. Null and empty texts have no bytes. Rows
    that repeat id and text are one document and get the same result.
    """
    runs = (
        repeated_strings(documents, length, batches)
        .groupBy("doc_id", "twin")
        .agg(F.collect_list(F.struct("start", "n")).alias("runs"))
        .select(F.col("doc_id").alias("run_id"), F.col("twin").alias("run_twin"), "runs")
    )
    texts = pack_texts(with_twin(documents))
    joined = texts.join(runs, (F.col("twin") == F.col("run_twin")) & F.col("doc_id").eqNullSafe(F.col("run_id")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            sizes, removed, spans, kept = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_py() if text.is_valid else b""
                sizes.append(len(data))
                if not found.is_valid:
                    removed.append(0)
                    spans.append(0)
                    kept.append(data)
                    continue
                start = np.asarray(found.values.field("start")).astype(np.int64)
                end = start + np.asarray(found.values.field("n")) - 1 + length
                edge = np.bincount(start, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(np.frombuffer(data, dtype=np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in (sizes, removed, spans)], pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return joined.select("doc_id", "packed", "runs").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def suffix_report(documents: DataFrame, length: int = 400) -> DataFrame:
    """Per document its bytes, those removed, their maximal runs, and the SHA-256 of the rest."""
    return deduplicated(documents, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

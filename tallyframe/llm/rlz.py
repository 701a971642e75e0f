"""Substring dedup by windows of words, strung together to factors of earlier text.

Every block of every document (a run of windows of ``window`` words that share
a minimizer) is grouped with the other blocks of its minimizer, and every
window gets its earliest place there. Each document is then read from left to
right: a factor starts where a window has an earlier place, and runs on while
the following windows have the place that continues it. No factor is extended
against the text it refers to: it ends where the earliest place of the next
window is another one, and the next factor may start before its end. Factors
have at least ``window`` words; their words are the document's duplicate spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import compared, hot_keys, hot_report, minimizer_blocks, place, repeats_in_chunk, row_order, slices, window_pieces, with_twin
from .shipping import ship
from .texts import SPACED, WIDE_CHUNK_BYTES, Chunk, Rolling, chunks, mix, pack_texts, signed, unpacked, words

GRAM_SHARE = 0.4
_BYTES = 6  # of a window's hash, besides the 64 bits of its minimizer


def _gram(window: int) -> int:
    return max(1, int(window * GRAM_SHARE))


Units = Callable[[Chunk], tuple[np.ndarray, np.ndarray]]


def spaced_words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the chunk's words, and where each row's words begin."""
    found = words(chunk, SPACED)
    return found.codes, found.first


def _frequent(documents: DataFrame, window: int, units: Units, gram: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, limit=WIDE_CHUNK_BYTES):
            codes, first = units(chunk)
            blocks = minimizer_blocks(Rolling(codes), first, window, gram)
            of = repeats_in_chunk(blocks, row_order(chunk.rows))[0] if blocks is not None else None
            yield hot_report(blocks, of)

    return hot_keys(with_twin(documents).mapInArrow(run, "key long, n long"))


BLOCK = "key long, doc_id long, twin int, start int, n int, windows binary, ref_id long, ref_start int"


def reference_blocks(documents: DataFrame, window: int, units: Units = spaced_words, gram: int | None = None) -> DataFrame:
    """Every block of every whole text, with the hashes of its windows of ``window`` units.

    A block that equals an earlier one of the same chunk has no hashes but its
    earlier place, and a key of its own that spreads.
    """
    ship(documents.sparkSession)
    gram = gram or _gram(window)
    hot = documents.sparkSession.sparkContext.broadcast(_frequent(documents, window, units, gram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, limit=WIDE_CHUNK_BYTES):
            codes, first_unit = units(chunk)
            rolling = Rolling(codes)
            blocks = minimizer_blocks(rolling, first_unit, window, gram, hot.value)
            if blocks is None:
                continue
            rank = row_order(chunk.rows)
            of, _ = repeats_in_chunk(blocks, rank)
            at = blocks.start - first_unit[blocks.row]
            later = (rank[blocks.row] != rank[blocks.row[of]]) | (at != at[of])
            hashes = np.ascontiguousarray(rolling.grams(window)[blocks.windows].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES])
            edges = (blocks.first_window * _BYTES).astype(np.int32)
            windows = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(edges), pa.py_buffer(hashes)])
            ids = chunk.rows.column(chunk.rows.schema.get_field_index("doc_id"))
            twins = chunk.rows.column(chunk.rows.schema.get_field_index("twin"))
            spread = mix(blocks.content + blocks.start.astype(np.uint64), 1)
            arrays = [
                pa.array(signed(np.where(later, spread, blocks.key))),
                ids.take(pa.array(blocks.row)),
                twins.take(pa.array(blocks.row)),
                pa.array(at.astype(np.int32)),
                pa.array(blocks.n.astype(np.int32)),
                windows,
                ids.take(pa.array(blocks.row[of])),
                pa.array(at[of].astype(np.int32)),
            ]
            names = ["key", "doc_id", "twin", "start", "n", "windows", "ref_id", "ref_start"]
            whole = pa.RecordBatch.from_arrays(arrays, names=names)
            first = whole.filter(pa.array(~later))
            nothing = pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.int32())
            yield from _in_parts(pa.RecordBatch.from_arrays([*first.columns[:6], *nothing], names=names))
            repeat = whole.filter(pa.array(later))
            yield from _in_parts(pa.RecordBatch.from_arrays([*repeat.columns[:5], pa.nulls(len(repeat), pa.binary()), *repeat.columns[6:]], names=names))

    return with_twin(documents).mapInArrow(run, BLOCK)


def _in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in slices(batch.num_rows, 1 << 15):
        yield batch.slice(part.start, part.stop - part.start)


def earlier_places(blocks: DataFrame) -> DataFrame:
    """``doc_id, twin, start, n, ref_id, ref_start``: runs of ``n`` windows that stand at an earlier place too.

    All blocks of a minimizer are in one partition. Of equal blocks all but the
    first are repeats as a whole. The windows of a first block are compared one
    by one only if its minimizer has other blocks as well.
    """
    known = blocks.filter("windows is null").select("doc_id", "twin", "start", "n", "ref_id", "ref_start")
    posted = blocks.filter("windows is not null").drop("ref_id", "ref_start").repartition("key")
    ranked = compared(posted.withColumn("content", F.xxhash64("windows"))).withColumn("repeated", F.col("top") != place())
    parts = ranked.filter("repeated or several").withColumn("pieces", F.when(~F.col("repeated"), window_pieces(_BYTES)))
    whole = parts.filter("repeated").select(
        "doc_id", "twin", "start", "n", F.col("top.doc_id").alias("ref_id"), F.col("top.start").alias("ref_start")
    )
    singles = (
        parts.filter("not repeated")
        .select("key", "doc_id", "twin", F.col("start").alias("block"), F.posexplode("pieces").alias("at", "piece"))
        .withColumn("start", F.col("block") + F.col("at"))
    )
    single = (
        compared(singles, "piece")
        .filter(F.col("top") != place())
        .select("doc_id", "twin", "start", F.lit(1).alias("n"), F.col("top.doc_id").alias("ref_id"), F.col("top.start").alias("ref_start"))
    )
    return known.unionByName(whole).unionByName(single)


def greedy_factors(runs: list[tuple[int, int, int | None, int]], window: int) -> list[tuple[int, int, int | None, int]]:
    """Factors (start, end, ref_id, ref_start) in words from runs (start, windows, ref_id, ref_start) of windows."""
    factors: list[tuple[int, int, int | None, int]] = []
    last_window = -1
    for start, n, ref_id, ref_start in sorted(set(runs), key=lambda r: r[:2]):
        if factors:
            f_start, f_end, f_id, f_ref = factors[-1]
            if f_id == ref_id and ref_start - start == f_ref - f_start and start <= last_window + 1:
                last_window = max(last_window, start + n - 1)
                factors[-1] = (f_start, last_window + window, f_id, f_ref)
                continue
            if start + n - 1 <= last_window:
                continue
        last_window = max(last_window, start + n - 1)
        factors.append((start, start + n - 1 + window, ref_id, ref_start))
    return factors


FACTOR = "struct<first_word: int, end_word: int, ref_id: long, ref_word: int>"


def parsed(documents: DataFrame, window: int = 20) -> DataFrame:
    """``doc_id, n_words, n_removed, kept (binary), factors`` for every row.

    ``kept``: the words outside factors, joined by one space. Null and empty
    texts have no words. "Earlier" is a smaller id, or an earlier word of the
    same document; null ids come last. Rows that repeat id and text are one
    document: each gets that document's result.
    """
    runs = (
        earlier_places(reference_blocks(documents, window))
        .groupBy("doc_id", "twin")
        .agg(F.collect_list(F.struct("start", "n", "ref_id", "ref_start")).alias("runs"))
        .select(F.col("doc_id").alias("run_id"), F.col("twin").alias("run_twin"), "runs")
    )
    texts = pack_texts(with_twin(documents))
    joined = texts.join(runs, (F.col("twin") == F.col("run_twin")) & F.col("doc_id").eqNullSafe(F.col("run_id")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("ref_id", pa.int64()), ("ref_word", pa.int32())]))
        for batch in unpacked(batches):
            n_words, n_removed, kept, factors = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                units = text.as_py().split() if text.is_valid else []
                n_words.append(len(units))
                own: list = []
                if found.is_valid:
                    own = greedy_factors([tuple(r.values()) for r in found.as_py()], window)
                    gone = np.zeros(len(units) + 1, dtype=np.int64)
                    for a, b, _, _ in own:
                        gone[a] += 1
                        gone[b] -= 1
                    stay = np.cumsum(gone)[:-1] == 0
                    units = [u for u, keep in zip(units, stay.tolist(), strict=True) if keep]
                n_removed.append(n_words[-1] - len(units))
                kept.append(b" ".join(units))
                factors.append([dict(zip(("first_word", "end_word", "ref_id", "ref_word"), f, strict=True)) for f in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(factors, kind)],
                names=["doc_id", "n_words", "n_removed", "kept", "factors"],
            )

    schema = f"doc_id long, n_words long, n_removed long, kept binary, factors array<{FACTOR}>"
    return joined.select("doc_id", "packed", "runs").mapInArrow(run, schema)


def substring_report(documents: DataFrame, window: int = 20) -> DataFrame:
    """Per document its words, those removed, and the SHA-256 of the rest."""
    return parsed(documents, window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("factors").cast("long").alias("n_factors"))

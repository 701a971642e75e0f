"""Line dedup by winnowing over line hashes.

A text is the sequence of its lines that hold a word. Of every ``run``
consecutive line hashes the smallest is a fingerprint, so that every repeated
run of that many lines has one at the same place. Runs of ``run`` lines are
grouped by their fingerprint and compared there; no match is extended beyond
them. The lines of every run that also stands earlier are deleted, so that
longer matches go run by run.

With ``min_words``, shorter runs of so many words together count as well. They
are fingerprints of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import PLACE, Blocks, place, repeats_in_chunk, row_order, with_twin
from .rlz import earlier_places, reference_blocks
from .shipping import ship
from .texts import BYTE_CODES, SPACED, WIDE_CHUNK_BYTES, Chunk, Rolling, chunks, inner_windows, mix, pack_texts, signed, unpacked

NEWLINE = 0x0A
MIN_RUN = 3
MIN_WORDS = 20  # of a shorter run, where words count as well


def line_ranges(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of what each line with a word holds between its outer white space, and each row's first such line."""
    data = chunk.bytes
    inside = np.flatnonzero(SPACED[data])
    if not len(inside):
        return inside, inside, np.zeros(len(chunk.offsets), dtype=np.int64)
    breaks = np.cumsum(data == NEWLINE)
    row = np.searchsorted(chunk.offsets, inside, side="right")
    line = breaks[inside] + row  # grows at a line feed and at a row's begin
    new = np.ones(len(inside), dtype=bool)
    new[1:] = line[1:] != line[:-1]
    first = np.flatnonzero(new)
    start, end = inside[first], inside[np.append(first[1:], len(inside)) - 1] + 1
    return start, end, np.searchsorted(start, chunk.offsets)


def line_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines with a word, and where each row's lines begin."""
    start, end, first = line_ranges(chunk)
    return Rolling(BYTE_CODES[chunk.bytes]).ranges(start, end), first


def _word_counts(chunk: Chunk, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The words of each line that :func:`line_ranges` gives."""
    inside = SPACED[chunk.bytes]
    begins = np.zeros(len(inside) + 1, dtype=np.int64)
    np.cumsum(inside[1:] & ~inside[:-1], out=begins[2:])
    return begins[end] - begins[start + 1] + 1


def _wordy_runs(chunk: Chunk, run: int, min_words: int) -> Blocks:
    """All runs of fewer than ``run`` lines that have ``min_words`` words together, each a block; ``n`` is its lines."""
    start, end, first = line_ranges(chunk)
    data = BYTE_CODES[chunk.bytes]
    codes, others = (Rolling(c).ranges(start, end) for c in (data, mix(data, 5)))
    summed = np.concatenate([[0], np.cumsum(_word_counts(chunk, start, end))])
    keys, contents, starts, sizes = [], [], [], []
    for n in range(1, run):
        at = inner_windows(first, n)
        at = at[summed[at + n] - summed[at] >= min_words]
        keys.append(Rolling(codes).grams(n)[at])
        contents.append(Rolling(others).grams(n)[at])
        starts.append(at)
        sizes.append(np.full(len(at), n))
    at = np.concatenate(starts)
    nothing = np.zeros(0, dtype=np.int64)
    return Blocks(
        np.concatenate(keys), np.concatenate(contents), np.searchsorted(first, at, side="right") - 1, at, np.concatenate(sizes), nothing, nothing
    )


def wordy_repeats(documents: DataFrame, run: int, min_words: int) -> DataFrame:
    """``doc_id, twin, start, end``: runs of fewer than ``run`` lines and at least ``min_words`` words that stand earlier too.

    Of equal runs in one chunk of texts only the first is compared with those of
    other chunks; the others are known and have keys that spread.
    """
    ship(documents.sparkSession)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, limit=WIDE_CHUNK_BYTES):
            found = _wordy_runs(chunk, run, min_words)
            if not len(found.start):
                continue
            first = line_ranges(chunk)[2]
            rank = row_order(chunk.rows)
            of, _ = repeats_in_chunk(found, rank)
            at = found.start - first[found.row]
            later = (rank[found.row] != rank[found.row[of]]) | (at != at[of])
            key = np.where(later, mix(found.content + found.start.astype(np.uint64), 1), found.key)
            ids = chunk.rows.column(chunk.rows.schema.get_field_index("doc_id"))
            twins = chunk.rows.column(chunk.rows.schema.get_field_index("twin"))
            arrays = [
                pa.array(signed(key)),
                pa.array(signed(found.content)),
                pa.array(later),
                ids.take(pa.array(found.row)),
                twins.take(pa.array(found.row)),
                pa.array(at.astype(np.int32)),
                pa.array((at + found.n).astype(np.int32)),
            ]
            whole = pa.RecordBatch.from_arrays(arrays, names=["key", "content", "later", "doc_id", "twin", "start", "end"])
            # A row that repeats id and text gets what is found out for the first one.
            yield whole.filter(pa.array(later | (of == np.arange(len(of)))))

    schema = "key long, content long, later boolean, doc_id long, twin int, start int, end int"
    posted = with_twin(documents).mapInArrow(post, schema).withColumn("unnamed", F.col("doc_id").isNull())
    equal = Window.partitionBy("key", "content", "later").orderBy(*PLACE)
    ranked = posted.withColumn("top", F.first(place()).over(equal))
    return ranked.filter(F.col("later") | (F.col("top") != place())).select("doc_id", "twin", "start", "end")


def without_lines(text: bytes, gone: np.ndarray) -> bytes:
    """The text without those of its lines with a word that ``gone`` marks, and without blank lines between two of them."""
    keep, at, pending, after_gone = [], 0, [], False
    for line in text.split(b"\n"):
        if not line.strip(b" \t\n\r\x0b\x0c"):
            pending.append(line)
            continue
        here = bool(gone[at])
        at += 1
        if not (here and after_gone):
            keep += pending
        pending = []
        if not here:
            keep.append(line)
        after_gone = here
    return b"\n".join(keep + pending)


def deduplicated(documents: DataFrame, run: int = MIN_RUN, min_words: int | None = None) -> DataFrame:
    """``row_id, twin, n_lines, n_removed, text`` for every row, ``row_id`` being its doc_id.

    n_lines: lines with a word; lines are equal if they are without their outer
    white space. Earlier is a smaller id (null ids come last) or an earlier
    line of the same document. A null text stays null and has no lines. Rows
    that repeat id and text are one document and get the same result.
    min_words: a run of fewer lines goes as well if it has so many words; none by default.
    """
    places = earlier_places(reference_blocks(documents, run, line_hashes, 1))
    places = places.select("doc_id", "twin", "start", (F.col("start") + F.col("n") + (run - 1)).alias("end"))
    if min_words is not None:
        places = places.unionByName(wordy_repeats(documents, run, min_words))
    runs = (
        places.groupBy("doc_id", "twin")
        .agg(F.collect_list(F.struct("start", "end")).alias("runs"))
        .select(F.col("doc_id").alias("run_id"), F.col("twin").alias("run_twin"), "runs")
    )
    texts = pack_texts(with_twin(documents))
    joined = texts.join(runs, (F.col("twin") == F.col("run_twin")) & F.col("doc_id").eqNullSafe(F.col("run_id")), "left")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(unpacked(batches)):
            _, _, first = line_ranges(chunk)
            found = chunk.rows.column(chunk.rows.schema.get_field_index("runs"))
            texts = chunk.rows.column(chunk.rows.schema.get_field_index("text"))
            counts = np.diff(first)
            removed, kept = np.zeros(len(counts), dtype=np.int64), []
            for row in range(len(counts)):
                if not texts[row].is_valid:
                    kept.append(None)
                elif not found[row].is_valid:
                    kept.append(chunk.text(row))
                else:
                    start = np.asarray(found[row].values.field("start")).astype(np.int64)
                    end = np.asarray(found[row].values.field("end")).astype(np.int64)
                    size = counts[row] + 1
                    gone = np.cumsum(np.bincount(start, minlength=size) - np.bincount(end, minlength=size))[:-1] > 0
                    removed[row] = gone.sum()
                    kept.append(without_lines(chunk.text(row), gone))
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.rows.column(0),
                    chunk.rows.column(1),
                    pa.array(counts),
                    pa.array(removed),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["row_id", "twin", "n_lines", "n_removed", "text"],
            )

    return joined.select("doc_id", "twin", "packed", "runs").mapInArrow(
        rebuild, "row_id long, twin int, n_lines long, n_removed long, text string"
    )


def line_report(documents: DataFrame, run: int = MIN_RUN, min_words: int | None = None) -> DataFrame:
    """Per document its lines with a word, how many of them went, and the text that is left."""
    return deduplicated(documents, run, min_words).select(F.col("row_id").alias("doc_id"), "n_lines", "n_removed", "text")


def kept_documents(documents: DataFrame, run: int = MIN_RUN, min_words: int | None = None) -> DataFrame:
    """The documents with their own columns and the text that is left (``n_chars`` follows it); those that lost every line go."""
    all_gone = F.col("n_removed") == F.col("n_lines")
    changed_rows = (
        deduplicated(documents.select("doc_id", "text"), run, min_words)
        .filter("n_removed > 0")
        .dropDuplicates(["row_id", "twin"])
        .select(F.col("row_id").alias("__id"), F.col("twin").alias("__twin"), F.col("text").alias("__left"), all_gone.alias("__gone"))
    )
    twin = F.shiftright(F.xxhash64("text"), 32).cast("int")
    joined = documents.join(changed_rows, (twin == F.col("__twin")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left")
    changed = {"text": F.coalesce("__left", "text")}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(F.col("__left").isNull(), F.col("n_chars")).otherwise(F.length("__left"))
    columns = [changed[c].cast(documents.schema[c].dataType).alias(c) if c in changed else F.col(f"`{c}`") for c in documents.columns]
    return joined.filter("__gone is null or not __gone").select(columns)

"""License scans by diagonal voting.

Every run of k consecutive words of every text is hashed and joined to the same
runs of a table of license templates. A hit at word p of a text and word q of a
template votes for the diagonal p - q. Votes are counted per text, template and
diagonal; neighbouring diagonals, which words put in or left out make, are
merged into one span; spans are verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shipping import ship
from .texts import LETTERED, PACK_LEVEL, Chunk, Rolling, chunks, inner_windows, keyed, signed, unpacked, words


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False  # a phrase that must stand whole; other templates match in part


# The phrases of the contract, then wording of public licenses.
TEMPLATES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("mit", "released under the mit license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
    ),
    Template(
        "apache",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed "
        "on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    Template(
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation",
    ),
)

LONG_GRAM = 4
MAX_SHIFT = 3  # diagonals at most so far apart are one span
MIN_COVERAGE = 0.6
MAX_BROADCAST_ROWS = 200_000
_EMIT = 1 << 18


def _gram_length(template: Template) -> int:
    n = len(template.text.split())
    return n if n < 3 else 2 if template.base else min(LONG_GRAM, n)


def _hashes(text: str, k: int) -> np.ndarray:
    """Hashes of a template's runs of k words, as those of texts."""
    chunk = next(chunks(iter([pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])])), None)
    return Rolling(words(chunk, LETTERED, lower=True).codes).grams(k, seed=k) if chunk else np.zeros(0, np.uint64)


def template_places(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """``gram, template, place``: where each run of words stands in the templates."""
    rows = [
        (int(h), number, place)
        for number, t in enumerate(templates)
        for place, h in enumerate(signed(_hashes(t.text, _gram_length(t))))
    ]
    return spark.createDataFrame(rows, "gram long, template int, place int")


def word_grams(documents: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """``row_key, gram, pos``: the hash of every run of each length at every word of every whole text."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            found = words(chunk, LETTERED, lower=True)
            rolling, row_of = Rolling(found.codes), found.row_of()
            keys = chunk.rows.column(chunk.rows.schema.get_field_index("row_key")).to_numpy()
            for k in lengths:
                starts = inner_windows(found.first, k)
                grams = signed(rolling.grams(k, seed=k)[starts])
                rows = row_of[starts]
                pos = (starts - found.first[rows]).astype(np.int32)
                for a in range(0, len(starts), _EMIT):
                    part = slice(a, a + _EMIT)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[rows[part]]), pa.array(grams[part]), pa.array(pos[part])], names=["row_key", "gram", "pos"]
                    )

    return keyed(documents).select("row_key", "text").mapInArrow(run, "row_key long, gram long, pos int")


def diagonal_votes(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``row_key, template, diagonal, votes``, one row per diagonal with a hit.

    The template table is broadcast while it has no more than
    ``MAX_BROADCAST_ROWS`` rows; a larger one is left to a shuffle join.
    """
    places = template_places(documents.sparkSession, templates)
    if sum(max(0, len(t.text.split()) - _gram_length(t) + 1) for t in templates) <= MAX_BROADCAST_ROWS:
        places = F.broadcast(places)
    grams = word_grams(documents, tuple(sorted({_gram_length(t) for t in templates})))
    return (
        grams.join(places, "gram")
        .groupBy("row_key", "template", (F.col("pos") - F.col("place")).alias("diagonal"))
        .agg(F.count(F.lit(1)).alias("votes"))
    )


def candidate_texts(documents: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """``row_key, doc_id, n_words, packed``: every row with its words counted, its text only where some run of words is a template's.

    A text without such a run has no votes, and needs not move.
    """
    ship(documents.sparkSession)
    known = {k: np.unique(np.concatenate([signed(_hashes(t.text, k)) for t in templates if _gram_length(t) == k])) for k in {_gram_length(t) for t in templates}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=PACK_LEVEL).compress
        for chunk in chunks(batches):
            found = words(chunk, LETTERED, lower=True)
            rolling, row_of = Rolling(found.codes), found.row_of()
            hit = np.zeros(chunk.rows.num_rows, dtype=bool)
            for k, grams in known.items():
                starts = inner_windows(found.first, k)
                hashes = signed(rolling.grams(k, seed=k)[starts])
                place = np.minimum(np.searchsorted(grams, hashes), len(grams) - 1)
                hit[row_of[starts[grams[place] == hashes]]] = True
            texts = [pack(chunk.text(i)) if h else None for i, h in enumerate(hit.tolist())]
            yield pa.RecordBatch.from_arrays(
                [chunk.rows.column(0), chunk.rows.column(1), pa.array(np.diff(found.first)), pa.array(texts, pa.binary())],
                names=["row_key", "doc_id", "n_words", "packed"],
            )

    return keyed(documents).select("row_key", "doc_id", "text").mapInArrow(run, "row_key long, doc_id long, n_words long, packed binary")


def _merged(diagonals: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Neighbouring diagonals as (first, last)."""
    first = last = None
    for diagonal, _ in sorted(diagonals):
        if first is not None and diagonal - last <= MAX_SHIFT:
            last = diagonal
            continue
        if first is not None:
            yield first, last
        first = last = diagonal
    if first is not None:
        yield first, last


def _aligned(text: list[bytes], template: list[bytes]) -> tuple[int, int, int]:
    """Words of the template found in their order in the text (longest common subsequence), and the first and last place."""
    n, m = len(text), len(template)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if text[i] == template[j] else max(below[j], row[j + 1])
    i = j = 0
    matched = []
    while i < n and j < m and best[i][j]:
        if text[i] == template[j]:
            matched.append(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return len(matched), (matched[0] if matched else -1), (matched[-1] if matched else -1)


def _spans(text: list[bytes], votes: list[dict], templates: list[tuple[str, list[bytes], bool]]) -> list[tuple]:
    """Verified spans of one text: (label, first word, end, coverage, base)."""
    by_template: dict[int, list[tuple[int, int]]] = {}
    for v in votes:
        by_template.setdefault(v["template"], []).append((v["diagonal"], v["votes"]))
    spans = []
    for number, diagonals in sorted(by_template.items()):
        label, phrase, base = templates[number]
        if base:
            for diagonal in sorted({d for d, _ in diagonals}):
                if diagonal >= 0 and text[diagonal : diagonal + len(phrase)] == phrase:
                    spans.append((label, diagonal, diagonal + len(phrase), 1.0, True))
            continue
        for low, high in _merged(diagonals):
            begin = max(0, low - MAX_SHIFT)
            # A merged run of diagonals longer than the template is many places side by side: cut into windows.
            step = len(phrase) + 2 * MAX_SHIFT
            for at in range(begin, high + MAX_SHIFT + 1, step):
                part = text[at : at + 2 * len(phrase) + 2 * MAX_SHIFT]
                n, first, last = _aligned(part, phrase)
                if n >= MIN_COVERAGE * len(phrase) and last - first < 2 * len(phrase):
                    spans.append((label, at + first, at + last + 1, n / len(phrase), False))
    return [s for s in spans if s[4] or not any(_outdone(s, other) for other in spans)]


def _outdone(span: tuple, other: tuple) -> bool:
    """Another template fits the same words better."""
    return not other[4] and other[3] > span[3] and other[1] < span[2] and span[1] < other[2]


SPAN = "struct<label: string, first_word: int, end_word: int, coverage: double, base: boolean>"


def license_spans(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``doc_id, n_words, spans``: one row per row of ``documents``, its words counted and its license spans verified.

    Texts that can have votes move once, compressed, to meet them. A null text has no
    words; repeated rows each get a row; a text without a span has an empty
    list.
    """
    votes = (
        diagonal_votes(documents, templates)
        .groupBy("row_key")
        .agg(F.collect_list(F.struct("template", "diagonal", "votes")).alias("votes"))
    )
    tables = [(t.label, [w.encode() for w in t.text.split()], t.base) for t in templates]
    names = ["doc_id", "n_words", "spans"]
    kind = pa.list_(
        pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("coverage", pa.float64()), ("base", pa.bool_())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(unpacked(batches)):
            found = words(chunk, LETTERED, lower=True)
            all_votes = chunk.rows.column(chunk.rows.schema.get_field_index("votes"))
            spans = [_row_spans(chunk, found, row, v.as_py()) if v.is_valid else [] for row, v in enumerate(all_votes)]
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.rows.column(chunk.rows.schema.get_field_index("doc_id")),
                    chunk.rows.column(chunk.rows.schema.get_field_index("n_words")),
                    pa.array([[dict(zip(("label", "first_word", "end_word", "coverage", "base"), s, strict=True)) for s in x] for x in spans], kind),
                ],
                names=names,
            )

    def _row_spans(chunk: Chunk, found, row: int, votes: list[dict]) -> list[tuple]:
        a, b, shift = found.first[row], found.first[row + 1], chunk.offsets[row]
        data = chunk.text(row).lower()
        text = [data[s - shift : e - shift] for s, e in zip(found.start[a:b].tolist(), found.end[a:b].tolist(), strict=True)]
        return _spans(text, votes, tables)

    joined = candidate_texts(documents, templates).join(votes, "row_key", "left").select("doc_id", "n_words", "packed", "votes")
    return joined.mapInArrow(run, f"doc_id long, n_words long, spans array<{SPAN}>")


def license_report(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per document its base places and labels, all labels, and the best coverage of a template as the score."""
    base = F.filter("spans", lambda s: s["base"])

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return license_spans(documents, templates).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first_word"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first_word"])).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )

"""Language identification: known words first, then character n-grams, longest first.

A word the model knows scores the log of its frequency in each language. A word
it does not know scores by the longest character n-grams of it that the model
knows: four characters, else three, two, one. A text's score is the mean over
its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import scratch_path
from .shipping import ship

UNKNOWN = "und"
ORDERS = (4, 3, 2, 1)
EDGE = "_"
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Bounds:
    """How large the training sample and the model may get.

    rows_per_language: labelled rows to learn from, about, chosen by a hash of id and text.
    words_per_language, grams_per_language: entries kept, the most frequent ones.
    cells: entries times languages of each table; with many languages it lowers the two above.
    """

    rows_per_language: int = 20_000
    words_per_language: int = 30_000
    grams_per_language: int = 30_000
    cells: int = 8_000_000


DEFAULT_BOUNDS = Bounds()


@dataclass(frozen=True)
class Model:
    """Log frequencies: ``words`` and ``grams`` give a row of a table that has one column per language."""

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(labelled: DataFrame, rows_per_language: int) -> DataFrame:
    """``lang, text`` of about that many rows of each language: all, or a share of them by a hash of id and text.

    The share follows from the languages' row counts, one row each on the driver.
    """
    key = [c for c in ("doc_id", "text") if c in labelled.columns]
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", *key)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    large = {lang: rows_per_language / n for lang, n in counts.items() if n > rows_per_language}
    if not large:
        return rows
    shares = F.create_map(*[x for lang, share in sorted(large.items()) for x in (F.lit(lang), F.lit(int(share * (1 << 30))))])
    place = F.shiftrightunsigned(F.xxhash64(*key), 34)
    return rows.filter(place < F.coalesce(shares[F.col("lang")], F.lit(1 << 30)))


def _frequent(counts: DataFrame, most: int, *kind: str) -> DataFrame:
    """Rows of at least the count that leaves ``most`` or fewer per language (and kind); equal counts stay or go together.

    The count is read off a histogram, so that no language is sorted in one task.
    """
    bucket = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2(F.col("n")) * 16).cast("long") - 32)
    sizes = counts.groupBy("lang", *kind, bucket.alias("bucket")).count().collect()
    floors: dict[tuple, int] = {}
    for group in {tuple(r[k] for k in ("lang", *kind)) for r in sizes}:
        own = sorted(((r["bucket"], r["count"]) for r in sizes if tuple(r[k] for k in ("lang", *kind)) == group), reverse=True)
        total, floor = 0, own[0][0] + 1
        for b, size in own:
            total += size
            if total > most:
                break
            floor = b
        floors[group] = floor
    spark = counts.sparkSession
    rows = [(*group, floor) for group, floor in sorted(floors.items())]
    types = ["lang string", *[f"{k} int" for k in kind], "floor long"]
    table = spark.createDataFrame(rows, ", ".join(types))
    return counts.join(F.broadcast(table), ["lang", *kind]).filter(bucket >= F.col("floor")).drop("floor")


def _table(rows: list, key: str, languages: list[str], totals: dict[tuple, float]) -> tuple[dict[str, int], np.ndarray]:
    """Log relative frequencies with half a count for what a language has not; each n-gram order has its own total."""
    keys = {k: i for i, k in enumerate(sorted({r[key] for r in rows}))}
    counts = np.full((len(keys), len(languages)), 0.5)
    column = {lang: i for i, lang in enumerate(languages)}
    for r in rows:
        counts[keys[r[key]], column[r["lang"]]] += r["n"]
    order = np.array([len(k) if key == "gram" else 0 for k in keys], dtype=int)
    size = np.ones_like(counts)
    for (lang, o), total in totals.items():
        size[order == o, column[lang]] = total + 0.5 * len(keys)
    return keys, np.log(counts / size)


def train(labelled: DataFrame, bounds: Bounds = DEFAULT_BOUNDS) -> Model:
    """The model of ``lang, text`` rows. Rows without either teach nothing; without any row the model has no language.

    Words are counted once, per language; n-grams are summed over the distinct words.
    """
    spark = labelled.sparkSession
    sample = training_sample(labelled, bounds.rows_per_language)
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")
    path = scratch_path(spark, "language-words")
    sample.select("lang", word).filter(F.col("word") != "").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    counts = spark.read.schema("lang string, word string, n long").parquet(path)
    totals = {(r["lang"], 0): float(r["n"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(lang for lang, _ in totals)
    if not languages:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    most = max(1, bounds.cells // len(languages) ** 2)
    words = _frequent(counts, min(bounds.words_per_language, most)).collect()

    edged = F.concat(F.lit(EDGE), F.col("word"), F.lit(EDGE))
    pieces = F.flatten(
        F.array(
            *[
                F.when(
                    F.length("edged") >= k,
                    F.transform(F.sequence(F.lit(1), F.length("edged") - (k - 1)), lambda i, k=k: F.substring(F.col("edged"), i, F.lit(k))),
                ).otherwise(F.array().cast("array<string>"))
                for k in ORDERS
            ]
        )
    )
    grams = (
        counts.withColumn("edged", edged)
        .select("lang", "n", F.explode(pieces).alias("gram"))
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("size", F.length("gram"))
    )
    grams_path = scratch_path(spark, "language-grams")
    grams.write.parquet(grams_path)
    grams = spark.read.schema("lang string, gram string, n long, size int").parquet(grams_path)
    gram_totals = {
        (r["lang"], r["size"]): float(r["n"]) for r in grams.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()
    }
    kept = _frequent(grams, max(1, min(bounds.grams_per_language, most) // len(ORDERS)), "size").collect()
    return Model(languages, *_table(words, "word", languages, totals), *_table(kept, "gram", languages, gram_totals))


class _Scorer:
    """Rows of scores of words, the unknown ones worked out once and kept for a while."""

    KEPT = 200_000

    def __init__(self, model: Model):
        self.model = model
        width = len(model.languages)
        self.most = max(1000, min(self.KEPT, 4_000_000 // max(1, width)))
        self.scores = np.vstack([model.word_scores.reshape(-1, width), np.zeros((self.most, width))])
        self.rest = float(self.scores[: len(model.words)].min(initial=-20.0))
        self._forget()

    def _forget(self) -> None:
        self.places = dict(self.model.words)
        self.used = len(self.places)

    def _backoff(self, word: str) -> np.ndarray:
        edged, grams = f"{EDGE}{word}{EDGE}", self.model.grams
        for k in ORDERS:
            rows = [row for i in range(len(edged) - k + 1) if (row := grams.get(edged[i : i + k])) is not None]
            if rows:
                return self.model.gram_scores[rows].mean(axis=0)
        return np.full(len(self.model.languages), self.rest)

    def text(self, words: list[str]) -> np.ndarray:
        """The mean score per language."""
        total, places = np.zeros(len(self.model.languages)), []
        for word in words:
            place = self.places.get(word)
            if place is None:
                if self.used == len(self.scores):
                    total += self.scores[places].sum(axis=0)
                    places = []
                    self._forget()
                place = self.used
                self.scores[place] = self._backoff(word)
                self.places[word] = place
                self.used += 1
            places.append(place)
        return (total + self.scores[places].sum(axis=0)) / len(words)


#: Words that count as independent evidence at most, so that scores of long texts still differ.
EVIDENCE = 12


def predict(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score``, from the whole text alone.

    A null text, and one without a letter, is ``und`` with score 0, as is every
    text if the model has no language. Equal scores go to the language that
    sorts first. Columns named like the two new ones are replaced.
    """
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    base = documents.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = _Scorer(model) if model.languages else None
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                found = [_judge(scorer, model, t) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    names=[*part.schema.names, "lang_pred", "score"],
                )

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{types}, lang_pred string, score double")


def _judge(scorer: _Scorer | None, model: Model, text: str | None) -> tuple[str, float]:
    words = _WORD.findall(text.lower()) if text else []
    if scorer is None or not any(any(c.isalpha() for c in w) for w in words):
        return UNKNOWN, 0.0
    scores = scorer.text(words) * min(len(words), EVIDENCE)
    best = int(scores.argmax())
    return model.languages[best], float(1 / np.exp(scores - scores[best]).sum())


def language_report(documents: DataFrame, bounds: Bounds = DEFAULT_BOUNDS) -> DataFrame:
    """Per document the predicted language; learned from the documents that are not held out."""
    rows = documents.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = train(rows.filter(~F.col("held_out")), bounds)
    return predict(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")

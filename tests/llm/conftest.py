from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, n_tokens int, row_key string, packed double, twin string, score int"


def _sentences(rng, words, n):
    return "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(4, 14))).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="session")
def corpus_rows():
    """Texts with copies, near copies, shared passages, periodic junk, gaps and repeated rows; ids are known."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [_sentences(rng, words, rng.randint(3, 25)) for _ in range(30)]
    texts = list(base)
    for t in base[:10]:
        texts.append(t)  # exact copies
        parts = t.split(" ")
        for _ in range(3):  # near copies
            copy = list(parts)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    passage = _sentences(rng, words, 8)
    texts += [f"{_sentences(rng, words, 4)}\n{passage}\n{_sentences(rng, words, 3)}" for _ in range(6)]
    texts += [None, "", " \t\n ", "one", "two words", "la " * 500, "ab cd ef " * 60, "x" * 3000, "Ünï çødé 中文 \U0001f600 " * 30, "all rights reserved"]
    texts += ["A line.\n\nA line.\nB line.\n \nC line.\nA line.\nB line.\nC line.\nEnd."] * 2
    texts += ["Licensed under CC BY. " + base[1], "the GNU General Public License, the general public license"]
    texts += [_sentences(rng, words, 900)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


def _table(spark, rows):
    full = [
        (i, t, ("en", "de", None)[k % 3], ("a", "b", None)[k % 3], len(t or ""), "x", 7, "y", 0.5, "z", 1) for k, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def corpus(spark, corpus_rows):
    """With columns named like those the operators make, and some rows twice."""
    return _table(spark, [*corpus_rows, *corpus_rows[:5]]).persist()


@pytest.fixture(scope="session")
def messy_rows(corpus_rows):
    return [*corpus_rows, *[(None, t) for _, t in corpus_rows[:4]], (None, None), (3, "another text under a known id")]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """Null ids and an id with two texts as well."""
    return _table(spark, messy_rows).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

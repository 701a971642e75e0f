from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from tallyframe.llm import vectorcodes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, codes int, error string, v int, _label string"


def nearest(x, book):
    d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
    return d.index(min(d)), min(d)


def brute(rows, coding):
    kept = [(i, [math.floor(coding.scale * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // coding.parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[: coding.entries]] for p in range(coding.parts)]
    for _ in range(coding.rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(cut(v, p), book)[0], []).append(cut(v, p))
            for k, g in groups.items():
                book[k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    out = []
    for i, v, lab in kept:
        found = [nearest(cut(v, p), book) for p, book in enumerate(books)]
        out.append((i, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found), lab))
    totals = {}
    for _, _, e, lab in out:
        totals[lab] = totals.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted([(i, c, e, totals[lab], digest) for i, c, e, lab in out], key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    grid = lambda: [float(np.float32(rng.choice([-0.25, 0.0, 0.125, rng.gauss(0, 0.2)]))) for _ in range(8)]
    out = [(i, grid(), rng.choice([1, 2, None])) for i in range(400)]
    out += [(400 + i, out[5][1], 1) for i in range(200)]  # a hot vector
    out += [(7, grid(), 3), (None, grid(), 2), *out[:3]]  # repeated ids and rows, a null id
    out += [(900, None, 1), (901, [0.5, None] * 4, 1), (902, [float("nan")] * 8, 1), (903, [float("inf"), *[0.0] * 7], 2), (904, [], 2)]
    rng.shuffle(out)
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("coding", [vc.DEFAULT_CODING, vc.Coding(entries=12), vc.Coding(parts=2, entries=3, rounds=2), vc.Coding(entries=5, rounds=0)])
def test_report_against_brute_force(spark, rows, coding):
    got = sorted([tuple(r) for r in vc.vector_code_report(table(spark, rows), coding).collect()], key=str)
    assert got == brute(rows, coding)


def test_search_is_exact_at_any_size():
    rng = np.random.default_rng(4)
    for spread in (1, 3, 1 << 24):
        book, x = rng.integers(-spread, spread + 1, (40, 6)), rng.integers(-spread, spread + 1, (500, 6))
        book[7] = book[3]  # equal entries
        index, distance = vc.EqualAverage(book).nearest(x)
        all_pairs = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (index == all_pairs.argmin(axis=1)).all() and (distance == all_pairs.min(axis=1)).all()


def test_search_looks_at_few_entries(monkeypatch):
    rng = np.random.default_rng(4)
    book = np.repeat(np.arange(256)[:, None], 4, axis=1) * 100
    x = book[rng.integers(0, 256, 300)] + rng.integers(-3, 4, (300, 4))
    looked = []
    step = vc.EqualAverage._step
    monkeypatch.setattr(vc.EqualAverage, "_step", lambda self, *a: (looked.append(len(a[4])), step(self, *a))[1])
    vc.EqualAverage(book).nearest(x)
    assert sum(looked) < 300 * 6


def test_decode(spark, rows):
    vectors = vc.integer_vectors(table(spark, rows))
    coding = vc.Coding(entries=200)
    books = vc.fit_codebooks(vectors, coding)
    encoded = vc.encode(vectors, books)
    errors = vectors.groupBy().count().first()[0]
    decoded = vc.decode(encoded, books, coding).collect()
    assert len(decoded) == errors and all(len(r["decoded"]) == 8 for r in decoded)
    far = [r for r in decoded if r["error"] == 0 and r["vec_id"] is not None]
    original = {(i, tuple(v)) for i, v, _ in rows if v and None not in v}
    by_id = {}
    for i, v in original:
        by_id.setdefault(i, []).append(v)
    assert far
    for r in far:
        assert any(max(abs(a - b) for a, b in zip(r["decoded"], v, strict=True)) <= 0.5 / 1024 + 1e-9 for v in by_id[r["vec_id"]])


def test_empty_and_unusable_tables(spark):
    assert vc.vector_code_report(table(spark, [(1, None, 1)]).where("vec_id > 1")).collect() == []
    assert vc.vector_code_report(table(spark, [(1, None, 1), (2, [None], 1)])).collect() == []


def test_uneven_vectors_are_an_error(spark):
    for bad in ([(1, [0.5] * 6, 1)], [(1, [0.5] * 8, 1), (2, [0.5] * 4, 1)]):
        with pytest.raises(ValueError):
            vc.vector_code_report(table(spark, bad)).collect()

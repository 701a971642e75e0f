"""Groups of texts around the limit lose no link."""

from __future__ import annotations

import random

import pytest
from tallyframe.llm import minhash


def _group(n, changed, seed=3):
    """``n`` texts of 400 words, each with ``changed`` words of one text replaced."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = []
    for i in range(n):
        text = list(base)
        for at in rng.sample(range(400), changed if isinstance(changed, int) else rng.choice(changed)):
            text[at] = f"v{rng.randrange(5000)}"
        rows.append((i, " ".join(text)))
    return rows


def _table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("changed", [(3, 4, 5, 6, 7), (5, 11), (9,)])
def test_links_at_the_limit(spark, changed):
    rows = _group(60, changed) + [(100 + i, t) for i, t in _group(40, changed, seed=4)]
    sets = {i: brute_shingles(t) for i, t in rows}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicate_report(_table(spark, rows), minhash.Likeness(3, 85)).collect()}
    assert got == _components(sets, 85)


def test_blocks_of_long_lists_lose_no_link(spark, monkeypatch):
    for name, value in (("SHORT_LIST", 3), ("BLOCK", 8), ("NEAREST", 1), ("FURTHER", 2)):
        monkeypatch.setattr(minhash, name, value)
    rows = _group(60, (3, 8)) + [(100 + i, t) for i, t in _group(40, (5, 11), seed=4)]
    sets = {i: brute_shingles(t) for i, t in rows}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicate_report(_table(spark, rows), minhash.Likeness(3, 85)).collect()}
    assert got == _components(sets, 85)


def test_pairs_grow_with_a_group_and_not_with_its_square(spark, monkeypatch):
    links, made = minhash._links, []

    def counted(pairs, *rest):
        made[-1] += pairs.count()
        return links(pairs, *rest)

    monkeypatch.setattr(minhash, "_links", counted)
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 0)  # all are left undecided
    for n in (100, 200):
        made.append(0)
        minhash.near_duplicate_report(_table(spark, _group(n, (3, 8))), minhash.Likeness(3, 85)).collect()
    assert made[1] < 3 * made[0], made


def brute_shingles(text):
    words = text.lower().split(" ")
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2))


def _joined(sets, links):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in sets}


def _components(sets, percent):
    ids = sorted(sets)
    return _joined(sets, [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])])

"""Benchmark items of few words."""

from __future__ import annotations

import itertools

from tallyframe.llm import decontaminate


def counts(same):
    """Whether a stretch with these agreeing words counts: the one with the most of them after substitutions are paid for."""
    n = len(same)
    stretches = [same[a:b] for a in range(n) for b in range(a + 1, n + 1)]
    best = max(sum(s) - 2 * (len(s) - sum(s)) for s in stretches)
    return any(sum(s) >= min(13, 0.7 * n) for s in stretches if sum(s) - 2 * (len(s) - sum(s)) == best and s[0] and s[-1])


def test_short_items_with_substitutions(spark):
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(5, 13)}
    rows, expected, ties = [], set(), set()
    for n, item in items.items():
        for gone in range(4):
            for places in itertools.combinations(range(n), gone):
                doc_id = len(rows)
                text = [f"d{doc_id}x{k}" if k in places else w for k, w in enumerate(item)]
                rows.append((doc_id, " ".join([f"d{doc_id}a", *text, f"d{doc_id}b"])))
                if counts([k not in places for k in range(n)]):
                    (ties if _tied(n, places) else expected).add((doc_id, n))
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination_report(documents, benchmark).collect()}
    assert expected <= got <= expected | ties
    assert len(expected) > 100


def _tied(n, places):
    """Whether several stretches are best, so that their order decides."""
    same = [k not in places for k in range(n)]
    values = [sum(s) - 2 * (len(s) - sum(s)) for s in (same[a:b] for a in range(n) for b in range(a + 1, n + 1))]
    return values.count(max(values)) > 1


def test_tiny_items_are_whole_texts(spark):
    texts = ["Forty two", "forty, two!", "forty two more", "it is forty two", "yes", "yes yes", "a b c d", "a b c d e", None, ""]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "forty two"), (2, "Yes."), (3, "a b c d"), (4, None), (5, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_matched) for r in decontaminate.contamination_report(documents, benchmark).collect()}
    assert got == {(0, 1, 2), (1, 1, 2), (4, 2, 1), (6, 3, 4)}
    assert sorted(r.doc_id for r in decontaminate.clean_documents(documents, benchmark).collect()) == [2, 3, 5, 7, 8, 9]

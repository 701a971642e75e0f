"""Dedup operators against their brute-force versions."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import graphs, lines, minhash, rlz, suffixes

from . import brute


def texts_of(table):
    return [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]


def same_rows(got, want):
    assert Counter(got) == Counter(want)


@pytest.mark.parametrize("name", ["corpus", "messy"])
def test_substrings(name, request):
    table = request.getfixturevalue(name)
    rows = texts_of(table)
    want = brute.first_occurrences(rows, 20)
    same_rows([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rlz.substring_report(table).collect()], [(r[0], *want[r]) for r in rows])


def test_factors_name_their_source(corpus):
    out = {r.doc_id: r for r in rlz.parsed(corpus).collect()}
    texts = {i: brute.SPACED.findall(t or "") for i, t in texts_of(corpus)}
    seen = 0
    for doc_id, row in out.items():
        for f in row.factors:
            size = f.end_word - f.first_word
            assert size >= 20
            assert texts[doc_id][f.first_word : f.end_word] == texts[f.ref_id][f.ref_word : f.ref_word + size]
            assert (f.ref_id, f.ref_word) < (doc_id, f.first_word)
            seen += 1
    assert seen > 10


@pytest.mark.parametrize("name", ["corpus", "messy"])
def test_suffixes(name, request):
    table = request.getfixturevalue(name)
    rows = texts_of(table)
    want = brute.repeated_bytes(rows, 120)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.suffix_report(table, 120).collect()]
    same_rows(got, [(r[0], *want[r]) for r in rows])


def test_index_family_keeps_log_many_levels(spark, corpus):
    hot = spark.sparkContext.broadcast(np.zeros(0, dtype=np.uint64))
    family = suffixes.IndexFamily(spark)
    for number in range(5):
        family.add(suffixes.suffixes(corpus.filter(F.col("doc_id") % 5 == number), 120, hot))
    assert sorted(family.levels) == [0, 2]
    family.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("suffixes_")]


@pytest.mark.parametrize("name", ["corpus", "messy"])
def test_lines(name, request):
    table = request.getfixturevalue(name)
    rows = texts_of(table)
    want = brute.line_runs(rows, 3)
    same_rows([(r.doc_id, r.n_lines, r.n_removed, r.text) for r in lines.line_report(table).collect()], [(r[0], *want[r]) for r in rows])


def test_lines_keep_columns_and_drop_emptied_documents(corpus):
    kept = lines.kept_documents(corpus)
    assert kept.columns == corpus.columns and kept.dtypes == corpus.dtypes
    want = brute.line_runs(texts_of(corpus), 3)
    expected = [(i, left) for (i, _), (n, gone, left) in ((r, want[r]) for r in texts_of(corpus)) if not (gone and gone == n)]
    same_rows([(r.doc_id, r.text) for r in kept.collect()], expected)
    assert all(r.n_chars == len(r.text or "") for r in kept.collect())


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80), (2, 50)])
def test_near_duplicates(corpus, shingle, percent):
    rows = texts_of(corpus)
    want = brute.near_components(rows, shingle, percent)
    got = minhash.near_duplicate_report(corpus, minhash.Likeness(shingle, percent)).collect()
    same_rows([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], [(r[0], *want[r], want[r][1] == r[0]) for r in rows])
    assert len({r.component_id for r in got}) < len(rows)


def test_near_duplicates_with_null_ids(messy):
    rows = texts_of(messy)
    got = minhash.near_duplicates(messy, minhash.Likeness(3, 85)).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in got:
        groups.setdefault(r.component_id, []).append(r)
    for component, members in groups.items():
        if component is not None:
            assert component == min(m.doc_id for m in members if m.doc_id is not None)


def test_one_of_each_group_stays(corpus):
    like = minhash.Likeness(3, 85)
    kept = minhash.kept_documents(corpus, like)
    want = brute.near_components(texts_of(corpus), 3, 85)
    assert kept.columns == corpus.columns
    same_rows([r.doc_id for r in kept.collect()], {d[0] for d, (_, root) in want.items() if root == d[0]})


def test_large_group_needs_no_pairs(spark):
    """Near copies that all differ: stars decide, and the exact rest is small."""
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(300):
        words = list(base)
        words[i] = "other"
        rows.append((i, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(table, minhash.Likeness(3, 85)).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_pairs_too_far_apart_are_not_made(spark):
    """Copies that lie just under the limit share rare shingles: their parity maps keep the join from making all pairs."""
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64) << np.uint64(16))
    texts = []
    for _ in range(40):
        keep = rng.permutation(len(base))[:350]
        texts.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**47, 50).astype(np.uint64) << np.uint64(16)])))
    texts.append(np.unique(np.concatenate([texts[0][:-10], base[:3]])))
    alike = {
        (i, j) for i in range(41) for j in range(i + 1, 41)
        if 100 * len(np.intersect1d(texts[i], texts[j])) >= 85 * len(np.union1d(texts[i], texts[j]))
    }
    sets = spark.createDataFrame([(i, bytearray(minhash.pack_hashes(t))) for i, t in enumerate(texts)], "node long, hashes binary")
    found = {(r.u, r.v) for r in minhash._undecided_pairs(sets.selectExpr("node", "node AS root"), sets, 85).distinct().collect()}
    assert alike <= found and (0, 40) in alike and len(found) <= 80
    for i, j in ((0, 1), (0, 40), (3, 9)):
        differing = bin(int.from_bytes((minhash.parity_map(texts[i]) ^ minhash.parity_map(texts[j])).tobytes(), "little")).count("1")
        assert differing <= len(np.setxor1d(texts[i], texts[j]))


def test_chain_is_one_component(spark):
    """Each text is near the next one only."""
    words = [f"w{i}" for i in range(1000)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 200])) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(table, minhash.Likeness(3, 85)).collect()
    assert {(r.component_id) for r in got} == {0}


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}


def test_empty_tables(nothing):
    for report in (rlz.substring_report, suffixes.suffix_report, lines.line_report, lambda d: minhash.near_duplicate_report(d, minhash.Likeness(3, 85))):
        assert report(nothing).collect() == []
    assert lines.kept_documents(nothing).collect() == [] and minhash.kept_documents(nothing).collect() == []

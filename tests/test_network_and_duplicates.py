"""Spanning forests against Kruskal's method, duplicates against pandas."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.plans import duplicates, network


def kruskal(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    forest = set()
    for w, a, b in sorted(((w, min(a, b), max(a, b)) for a, b, w in edges), reverse=True):
        if root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
            forest.add((a, b))
    return forest, {x: min(y for y in parent if root(y) == root(x)) for x in parent}


@pytest.mark.parametrize("nodes, links", [(12, 30), (40, 45), (30, 200)])
def test_forest(spark, nodes, links):
    rng = random.Random(nodes)
    pairs = {tuple(sorted(rng.sample(range(nodes), 2))) for _ in range(links)}
    edges = [(f"n{a:02d}", f"n{b:02d}", rng.choice([0.5, 0.7, 0.9, rng.random()])) for a, b in sorted(pairs)]
    turned = [(b, a, w) if rng.random() < 0.5 else (a, b, w) for a, b, w in edges]
    df = spark.createDataFrame([*turned, ("x", "x", 1.0), ("n00", "n01", None)], "a string, b string, weight double")
    forest, component = kruskal(edges)
    got = network.spanning_forest(df).collect()
    assert {(r["a"], r["b"]) for r in got} == {(a, b) for a, b, _ in edges}
    assert {(r["a"], r["b"]) for r in got if r["in_forest"]} == forest
    assert all(r["component"] == component[r["a"]] for r in got)


def test_a_long_chain_and_no_links(spark):
    """A chain of rising weights is one component after the first round, through many pointers."""
    df = spark.createDataFrame([(i, i + 1, float(i)) for i in range(64)], "a long, b long, weight double")
    got = network.spanning_forest(df).collect()
    assert len(got) == 64 and all(r["in_forest"] and r["component"] == 0 for r in got)
    assert network.spanning_forest(df.limit(0)).collect() == []


@pytest.fixture(scope="module")
def repeated(spark):
    rng = np.random.default_rng(1)
    n = 3_000
    pdf = pd.DataFrame({"id": rng.permutation(n), "x": rng.choice([0.0, -0.0, 1.5, np.nan, 2.5], n), "t": rng.choice(["a", 'a"', "", None], n), "k": rng.integers(0, 300, n)})
    pdf.loc[:1000, ["x", "t", "k"]] = [7.0, "hot", 1]
    return pdf, spark.createDataFrame(pdf).withColumn("x", F.when(F.col("k") % 2 == 0, F.expr("nullif(x, double('NaN'))")).otherwise(F.col("x"))).repartition(6).cache()


@pytest.mark.parametrize("broadcast", [100_000, 1])
def test_duplicates(repeated, monkeypatch, broadcast):
    monkeypatch.setattr("tallyframe.limits.BROADCAST_ROWS", broadcast)
    pdf, df = repeated
    for columns in (["x", "t", "k"], ["k", "x"]):
        groups = pdf.assign(x=pdf["x"] + 0.0).groupby(columns, dropna=False)["id"]
        want = pd.DataFrame({"id": pdf["id"], "rep": groups.transform("min"), "n": groups.transform("size")})
        want = {(i, r, n) for i, r, n in want[want["n"] > 1].itertuples(index=False)}
        assert {tuple(r) for r in duplicates.duplicate_rows(df, "id", columns).collect()} == want
        assert duplicates.without_duplicates(df, columns).count() == groups.ngroups


def test_no_duplicates(spark, repeated):
    _, df = repeated
    assert duplicates.duplicate_rows(df.limit(0), "id").collect() == []
    assert duplicates.duplicate_rows(spark.range(50).selectExpr("id", "id AS v"), "id").collect() == []
    nothing = spark.createDataFrame([(None, None), (None, None), (5, None)], "id long, v string")
    assert sorted((r["id"] or 0, r["representative"], r["copies"]) for r in duplicates.duplicate_rows(nothing, "id").collect()) == [(0, 5, 3), (0, 5, 3), (5, 5, 3)]

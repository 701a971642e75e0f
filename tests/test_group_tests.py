"""Tail probabilities and group tests against closed forms and plain loops."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import distributions as d
from tallyframe.plans import group_tests as g


def simpson(f, a, b, n=20_000):
    h = (b - a) / n
    return h / 3 * sum(f(a + i * h) * (1 if i in (0, n) else 4 if i % 2 else 2) for i in range(n + 1))


def test_tails(spark):
    """Chi-square with even degrees, F with two, t with one and two have closed forms; others are integrated."""
    rows = []
    for x in (0.0, 1e-6, 0.3, 2.0, 7.5, 40.0, 300.0, 900.0):
        for k in (2, 4, 10, 60, 400):
            rows.append(("chi", x, k, 0, math.exp(-x / 2) * math.fsum(math.exp(i * math.log(x / 2) - math.lgamma(i + 1)) if x else float(i == 0) for i in range(k // 2))))
        for k in (1, 3, 50, 60_000, 10_000_000):
            rows.append(("f", x, 2, k, math.exp(-k / 2 * math.log1p(2 * x / k))))
        rows.append(("t", x, 1, 0, 1 - 2 * math.atan(x) / math.pi))
        rows.append(("t", x, 2, 0, 1 - x / math.sqrt(2 + x * x)))
    for x in (0.5, 2.0):
        odd = lambda t: t ** 2.5 * math.exp(-t / 2) / (2**3.5 * math.gamma(3.5))
        rows.append(("chi", x, 7, 0, 1 - simpson(odd, 0, x)))
    df = spark.createDataFrame([(n, x, float(a), float(b), w) for n, x, a, b, w in rows], "name string, x double, a double, b double, want double")
    x, a, b = F.col("x"), F.col("a"), F.col("b")
    got = df.withColumn("got", F.when(F.col("name") == "chi", d.chi_square_tail(x, a)).when(F.col("name") == "f", d.f_tail(x, a, b)).otherwise(d.t_tail_both(x, a)))
    for r in got.collect():
        assert r["got"] == pytest.approx(r["want"], rel=1e-9, abs=1e-12), r


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 10.5, 1234.5, 1e7]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", d.log_gamma(F.col("x")).alias("y")).collect()
    assert all(r["y"] == pytest.approx(math.lgamma(r["x"]), rel=1e-12, abs=1e-13) for r in got)


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(6)
    n = 900
    k = rng.choice(["a", "b", "c", None], n, p=[0.5, 0.2, 0.2, 0.1])
    pdf = pd.DataFrame({
        "k": k, "x": rng.normal(1e6, 1, n) + (k == "b"), "y": rng.integers(0, 4, n).astype(float), "flat": 2.0, "z": rng.normal(size=n) * np.where(k == "a", 1, 9),
    })
    pdf.loc[::7, "x"] = np.nan
    return pdf, spark.createDataFrame(pdf).repartition(4).cache()


@pytest.mark.parametrize("small", [False, True])
def test_group_tests(groups, monkeypatch, small):
    pdf, df = groups
    if small:
        monkeypatch.setattr("tallyframe.limits.BROADCAST_ROWS", 5)
        monkeypatch.setattr("tallyframe.limits.ONE_TASK_ROWS", 100)
    got = {(r["column"], r["test"]): r for r in g.group_tests(df, "k").collect()}
    assert len(got) == 12
    for c in ("x", "y", "z"):
        clean = pdf[["k", c]].dropna()
        parts = [p.to_numpy() for _, p in clean.groupby("k")[c]]
        n, k = len(clean), len(parts)
        between = sum(len(p) * (p.mean() - clean[c].mean()) ** 2 for p in parts)
        within = sum(((p - p.mean()) ** 2).sum() for p in parts)
        assert got[c, "anova"]["statistic"] == pytest.approx(between / (k - 1) / (within / (n - k)), rel=1e-8)
        assert (got[c, "anova"]["groups"], got[c, "anova"]["n"], got[c, "anova"]["df1"], got[c, "anova"]["df2"]) == (k, n, k - 1, n - k)
        w = np.array([len(p) / p.var(ddof=1) for p in parts])
        m = np.array([p.mean() for p in parts])
        center = (w * m).sum() / w.sum()
        lack = sum((1 - wi / w.sum()) ** 2 / (len(p) - 1) for wi, p in zip(w, parts, strict=True))
        f = (w * (m - center) ** 2).sum() / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * lack)
        assert got[c, "welch"]["statistic"] == pytest.approx(f, rel=1e-7)
        assert got[c, "welch"]["df2"] == pytest.approx((k * k - 1) / (3 * lack), rel=1e-8)
        rank = clean[c].rank()
        h = 12 / (n * (n + 1)) * sum(rank[clean["k"] == name].sum() ** 2 / (clean["k"] == name).sum() for name in "abc") - 3 * (n + 1)
        h /= 1 - sum(t**3 - t for t in clean[c].value_counts().astype(float)) / (n**3 - n)
        assert got[c, "kruskal"]["statistic"] == pytest.approx(h, rel=1e-9)
        assert got[c, "kruskal"]["p_value"] == pytest.approx(math.exp(-h / 2), rel=1e-9)  # two degrees of freedom
    assert [got["flat", t]["statistic"] for t in ("anova", "welch", "kruskal")] == [None] * 3
    assert [got["flat", t]["p_value"] for t in ("anova", "welch", "kruskal")] == [None] * 3


@pytest.mark.parametrize("one_task", [1_000_000, 100])
def test_few_groups_are_counted_beside_their_values(groups, monkeypatch, one_task):
    """Ranks are made once per value and not joined back; with more groups than that the result is the same."""
    _, df = groups
    monkeypatch.setattr("tallyframe.limits.ONE_TASK_ROWS", one_task)
    joins, real = [], g.join_by_value
    monkeypatch.setattr(g, "join_by_value", lambda *a: (joins.append(1), real(*a))[1])
    few = g.group_tests(df, "k").collect()
    assert not joins
    monkeypatch.setattr(g, "FEW_GROUPS", 2)
    many = g.group_tests(df, "k").collect()
    assert joins
    for a, b in zip(few, many, strict=True):
        assert (a["column"], a["test"], a["groups"], a["n"]) == (b["column"], b["test"], b["groups"], b["n"])
        assert a["statistic"] == (None if b["statistic"] is None else pytest.approx(b["statistic"], rel=1e-12))


def test_welch_of_two_groups_is_the_square_of_t(groups):
    pdf, df = groups
    r = next(r for r in g.group_tests(df.where("k in ('a', 'b')"), "k", ["z"]).collect() if r["test"] == "welch")
    a, b = (pdf.loc[pdf["k"] == k, "z"].to_numpy() for k in "ab")
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    assert r["statistic"] == pytest.approx((a.mean() - b.mean()) ** 2 / (va + vb), rel=1e-9)
    assert r["df2"] == pytest.approx((va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1)), rel=1e-9)


def test_crosstab_and_chi_square(groups):
    pdf, df = groups
    table = pd.crosstab(pdf["k"], pdf["y"])
    cells = g.crosstab(df, "k", "y", zeros=True).collect()
    assert {(r["k"], r["y"]): r["n"] for r in cells} == {(k, y): table.loc[k, y] for k in table.index for y in table.columns}
    expected = np.outer(table.sum(axis=1), table.sum(axis=0)) / table.to_numpy().sum()
    x = ((table.to_numpy() - expected) ** 2 / expected).sum()
    r = g.chi_square(df, "k", "y").first()
    assert r["statistic"] == pytest.approx(x, rel=1e-9) and r["df"] == 6 and r["n"] == table.to_numpy().sum()
    assert r["p_value"] == pytest.approx(math.exp(-x / 2) * (1 + x / 2 + x * x / 8), rel=1e-9)
    assert r["cramers_v"] == pytest.approx(math.sqrt(x / r["n"] / 2), rel=1e-9)
    sparse = df.select(F.lit("p").alias("k"), F.lit(1).alias("y")).limit(3).union(df.select(F.lit("q"), F.lit(2)).limit(2))
    assert sorted((r["k"], r["y"], r["n"]) for r in g.crosstab(sparse, "k", "y", zeros=True).collect()) == [("p", 1, 3), ("p", 2, 0), ("q", 1, 0), ("q", 2, 2)]
    assert sorted((r["k"], r["n"]) for r in g.crosstab(sparse, "k", "y").collect()) == [("p", 3), ("q", 2)]
    assert g.chi_square(sparse, "k", "y").first()["statistic"] == pytest.approx(5.0)
    assert g.chi_square(sparse, "k", "k").first()["cramers_v"] == pytest.approx(1.0)
    none = df.where("k = 'no'")
    assert g.crosstab(none, "k", "y").collect() == [] and g.chi_square(none, "k", "y").first()["statistic"] is None

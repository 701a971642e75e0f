"""Missing patterns against all subsets."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from tallyframe.plans import missing_patterns as m


@pytest.fixture(scope="module")
def gaps(spark):
    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame(rng.normal(size=(n, 7)), columns=list("abcdefg"))
    pdf.loc[rng.random(n) < 0.3, ["a", "b"]] = np.nan
    pdf.loc[rng.random(n) < 0.2, ["b", "d", "e"]] = np.nan
    pdf.loc[rng.random(n) < 0.5, "e"] = np.nan
    pdf.loc[:400, "g"] = np.nan
    pdf.loc[3, "c"] = np.nan
    return pdf, spark.createDataFrame(pdf).repartition(4).cache()


def test_patterns_of_rows(gaps):
    pdf, df = gaps
    want = pdf.isna().apply(lambda r: tuple(c for c in pdf if r[c]), axis=1).value_counts()
    got = {tuple(r["columns"]): r for r in m.missing_patterns(df).collect()}
    assert {k: r["rows"] for k, r in got.items()} == want.to_dict()
    assert all(r["missing_columns"] == len(k) and r["pct"] == pytest.approx(100 * want[k] / len(pdf), abs=0.006) for k, r in got.items())


@pytest.mark.parametrize("share, per_pass, cells", [(0.0001, 2_000, 20_000_000), (0.15, 2, 500)])
def test_closed_sets(gaps, monkeypatch, share, per_pass, cells):
    monkeypatch.setattr(m, "SETS_PER_PASS", per_pass)
    monkeypatch.setattr(m, "MATCH_CELLS", cells)
    pdf, df = gaps
    gone = pdf.isna().to_numpy()
    count = {s: int(gone[:, list(s)].all(axis=1).sum()) for k in range(1, 8) for s in combinations(range(7), k)}
    closed = {s: n for s, n in count.items() if n >= share * len(pdf) and n and not any(count[t] == n for t in count if set(s) < set(t))}
    got = [(tuple(r["columns"]), r["rows"]) for r in m.missing_together(df, min_share=share).collect()]
    assert sorted(got) == sorted((tuple("abcdefg"[i] for i in s), n) for s, n in closed.items())


def test_missing_everywhere_and_nowhere(spark):
    df = spark.createDataFrame([(None, 1, "x"), (None, None, "y")], "a int, b int, c string")
    got = sorted((tuple(r["columns"]), r["rows"], r["pct"]) for r in m.missing_together(df).collect())
    assert got == [(("a",), 2, 100.0), (("a", "b"), 1, 50.0)]
    assert m.missing_together(df, ["c"]).collect() == []
    assert [(r["columns"], r["rows"]) for r in m.missing_patterns(df, ["c"]).collect()] == [([], 2)]
    assert m.missing_patterns(df.limit(0)).collect() == [] and m.missing_together(df.limit(0)).collect() == []


def test_many_columns_that_are_missing_together(spark):
    """Forty columns missing in the same rows are one closed set, not 2^40 subsets."""
    df = spark.range(200).selectExpr(*[f"if(id % 3 = 0, null, id) AS c{i}" for i in range(40)])
    got = m.missing_together(df).collect()
    assert [(r["missing_columns"], r["rows"]) for r in got] == [(40, 67)]

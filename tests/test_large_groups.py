"""The plans for groups too large for one task, forced by tiny bounds, against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import aggregate
from tallyframe.plans import bins, correlation, quantiles, rank_correlation, ranks

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows, one value a third of the values."""
    rng = np.random.default_rng(5)
    n = 30_000
    keys = np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 40, n).astype(str))
    values = np.where(rng.random(n) < 0.34, 7.0, rng.normal(0, 100, n))
    values[::97] = np.nan
    pdf = pd.DataFrame({"k": keys, "v": values, "u": rng.permutation(n).astype(float)})
    return pdf, spark.createDataFrame(pdf).repartition(7).cache()


def test_table_quantiles(skewed):
    pdf, df = skewed
    got = quantiles.table_quantiles(df, ["v", "u"], PROBS, one_task=100)
    for c in ("v", "u"):
        want = pdf[c].quantile(PROBS)
        assert [got[c][p] for p in PROBS] == pytest.approx(want.tolist()), c
    plain = quantiles.table_quantiles(df, ["v", "u"], PROBS)
    assert all(got[c] == pytest.approx(plain[c]) for c in got)


def test_grouped_quantiles(skewed):
    pdf, df = skewed
    rows = quantiles.grouped_quantiles(df, ["k"], ["v", "u"], PROBS, one_task=700).collect()
    got = {(r["k"], r["column"]): r["q"] for r in rows}
    assert len(got) == 82
    for c in ("v", "u"):
        for k, want in pdf.groupby("k")[c]:
            assert got[k, c] == pytest.approx(want.quantile(PROBS).tolist()), (k, c)


def test_ranges_of_groups_come_from_rows_as_they_are(skewed, monkeypatch):
    """Rows are made one per column only to look for quantiles: at most once a round, and not for groups that are not there."""
    pdf, df = skewed
    pdf, df = pdf[pdf["k"] == "hot"], df.where("k = 'hot'")
    seen, kind, real = [], type(df), type(df).groupBy
    monkeypatch.setattr(kind, "groupBy", lambda self, *k: (seen.append(self), real(self, *k))[1])
    made = quantiles.grouped_quantiles(df, ["k"], ["v", "u"], PROBS, one_task=700)
    monkeypatch.setattr(kind, "groupBy", real)
    long = [d for d in seen if {"column", "value"} <= set(d.columns) and not {"w", "bin"} & set(d.columns)]
    assert len(long) <= 2 and all("lo" in d.columns for d in long)
    assert "percentile(" not in made._jdf.queryExecution().toString()
    for r in made.collect():
        assert r["q"] == pytest.approx(pdf[r["column"]].quantile(PROBS).tolist()), r["column"]


def test_few_bins_take_more_rounds(skewed, monkeypatch):
    """With two bins a round hardly narrows; whatever is left after the last one is ranked, and exact."""
    pdf, df = skewed
    monkeypatch.setattr(quantiles, "BINS", 2)
    monkeypatch.setattr(quantiles, "ROUNDS", 3)
    rows = quantiles.grouped_quantiles(df, ["k"], ["u", "v"], PROBS, one_task=700).collect()
    got = {r["column"]: r["q"] for r in rows if r["k"] == "hot"}
    for c in ("u", "v"):
        assert got[c] == pytest.approx(pdf.loc[pdf["k"] == "hot", c].quantile(PROBS).tolist())


def test_few_rounds_leave_more_to_rank(skewed, monkeypatch):
    pdf, df = skewed
    for rounds in (0, 1, 2):
        monkeypatch.setattr(bins, "ROUNDS", rounds)
        got = quantiles.table_quantiles(df, ["u", "v"], PROBS, one_task=2_000)
        for c in ("u", "v"):
            assert [got[c][p] for p in PROBS] == pytest.approx(pdf[c].quantile(PROBS).tolist()), rounds


def test_bins_move_one_vector_per_task_and_column(skewed):
    """Every value of both columns is counted once, and the plan holds no row per value."""
    pdf, df = skewed
    counted = bins.bin_counts(df, {"v": df["v"], "u": df["u"]}, {"u": [(0.0, 100.0), (200.0, 29_999.0)], "v": [(-1e3, 1e3)]})
    u = pdf["u"].to_numpy()
    assert counted["u"].counts.sum() == len(u) - ((u > 100) & (u < 200)).sum()
    assert counted["u"].counts[0] == counted["u"].counts[-1] == 0
    assert counted["v"].counts.sum() == pdf["v"].notna().sum()
    first = counted["u"].counts[1 : 1 + bins.BINS]
    assert first.sum() == 101 and first.max() == 1
    filled = counted["v"].counts > 0
    assert (counted["v"].least[filled] <= counted["v"].most[filled]).all()


def test_cuts_leave_few_values_between(skewed):
    pdf, df = skewed
    for size in (50, 1_000):
        cuts = bins.balanced_cuts(df, {"v": df["v"], "u": df["u"]}, {"u": (0.0, 29_999.0), "v": (pdf["v"].min(), pdf["v"].max())}, size)
        for c in ("u", "v"):
            values = pdf[c].dropna().to_numpy()
            assert np.isin(cuts[c], values).all()
            apart = values[~np.isin(values, cuts[c])]
            assert np.bincount(np.searchsorted(cuts[c], apart)).max() <= size
            assert len(cuts[c]) <= 4 * len(values) / size + 4


def test_wide_ranges_and_infinities(spark):
    values = [float("-inf"), -1.7e308, 0.0, 1e-300, 1.0, 2.0, 1.7e308, float("inf")] * 20
    df = spark.createDataFrame([(v,) for v in values], "a double")
    got = quantiles.table_quantiles(df, ["a"], [0.0, 0.5, 1.0], one_task=10)["a"]
    values.sort()
    assert (got[0.0], got[1.0]) == (values[0], values[-1]) and got[0.5] == (values[79] + values[80]) / 2


def test_no_sketch_meets_in_one_task(skewed):
    """The first round of the large plan counts bins in every task before anything moves."""
    _, df = skewed
    long = quantiles.unpivot(df, {"v": df["v"]})
    ranges = df.sparkSession.createDataFrame([("v", 0.0, 1.0)], "column string, lo double, hi double")
    bins = quantiles._attach(long, ranges, ["column"], False).groupBy("column", quantiles._bin().alias("bin")).count()
    plan = bins._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "percentile_approx" not in plan


def test_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None)] * 50, "a double, b double")
    got = quantiles.table_quantiles(df, ["a", "b"], [0.5], one_task=10)
    assert got == {"a": {0.5: 1.0}, "b": {0.5: None}}


def test_ranks_across_partitions(skewed):
    pdf, df = skewed
    counts = ranks.count_values(df.select("k", F.col("v").alias("value")).where("value is not null"), ["k"])
    split = ranks.rank_values(counts, ["k"], 30_000, one_task=500)
    assert sorted(split.collect()) == sorted(ranks.rank_values(counts, ["k"], 100).collect())
    clean = pdf.dropna()
    for k in ("hot", "3"):
        values = clean.loc[clean["k"] == k, "v"].to_numpy()
        for r in split.where(F.col("k") == k).limit(50).collect():
            assert r["before"] == (values < r["value"]).sum() and r["w"] == (values == r["value"]).sum()


def test_group_median_takes_the_split_plan(skewed, monkeypatch):
    pdf, df = skewed
    monkeypatch.setattr("tallyframe.limits.ONE_TASK_ROWS", 500)
    got = aggregate.group_and_aggregate(df, "k", {"u": ["median", "count"]}).toPandas().set_index("k")
    want = pdf.groupby("k")["u"].agg(["median", "count"])
    np.testing.assert_allclose(got["u_median"].sort_index(), want["median"].sort_index())


@pytest.fixture(scope="module")
def triple(spark):
    rng = np.random.default_rng(9)
    n = 900
    a = np.where(rng.random(n) < 0.35, 2.0, rng.normal(size=n))
    b = a + rng.normal(size=n)
    c = rng.integers(0, 5, n).astype(float)
    b[rng.random(n) < 0.1] = np.nan
    pdf = pd.DataFrame({"a": a, "b": b, "c": c})
    return pdf, spark.createDataFrame(pdf).repartition(4).cache()


@pytest.mark.parametrize("method", ["spearman", "kendall"])
@pytest.mark.parametrize("gaps", [True, False])
def test_rank_correlations(triple, method, gaps, monkeypatch):
    from tests.test_analysis import tau_b

    pdf, df = triple
    if not gaps:
        pdf, df = pdf.dropna(), df.where("b is not null")
    # Everything the large way: split ranks, hot-value joins, cut walks.
    monkeypatch.setattr("tallyframe.limits.BROADCAST_ROWS", 10)
    got = correlation.correlation_matrix(df, method, one_task=60).toPandas().set_index(["col_a", "col_b"])["r"]
    for x in "abc":
        for y in "abc":
            if method == "spearman":
                want = pdf.corr(method="spearman").loc[x, y]
            else:
                want = 1.0 if x == y else tau_b(pdf[x].to_numpy(), pdf[y].to_numpy())
            assert got[x, y] == pytest.approx(want, abs=1e-12), (x, y)


@pytest.fixture(scope="module")
def gappy(spark):
    """Seven columns: two missing together, own gaps, none, infinities, one constant, one empty; a hot value in several."""
    rng = np.random.default_rng(12)
    n = 700
    base = rng.normal(size=n).round(1)
    cols = {
        "a": np.where(rng.random(n) < 0.4, 1.0, base),
        "b": base * 2 + rng.normal(size=n),
        "c": rng.integers(0, 4, n).astype(float),
        "d": -base + rng.normal(size=n) * 0.3,
        "e": np.where(rng.random(n) < 0.05, np.inf, np.where(rng.random(n) < 0.05, -np.inf, rng.normal(size=n))),
        "f": np.full(n, 3.0),
        "g": np.full(n, np.nan),
    }
    together, own = rng.random(n) < 0.2, rng.random(n) < 0.3
    for c, gone in (("a", together), ("b", together), ("d", own)):
        cols[c] = np.where(gone, np.nan, cols[c])
    pdf = pd.DataFrame(cols)
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


@pytest.mark.parametrize("method", ["spearman", "kendall"])
@pytest.mark.parametrize("one_task, broadcast", [(1_000_000, 100_000), (40, 10), (300, 10)])
def test_rank_correlations_with_gaps(gappy, method, one_task, broadcast, monkeypatch):
    from tests.test_analysis import tau_b

    pdf, df = gappy
    monkeypatch.setattr("tallyframe.limits.BROADCAST_ROWS", broadcast)
    got = correlation.correlation_matrix(df, method, one_task=one_task).toPandas().set_index(["col_a", "col_b"])["r"]
    for x in pdf:
        for y in pdf:
            both = pdf[[x, y]].dropna() if x != y else pdf[[x]].dropna()
            if len(both) == 0 or both.nunique().min() < 2:
                assert np.isnan(got[x, y]), (x, y)
            elif x == y:
                assert got[x, y] == 1.0
            elif method == "spearman":
                assert got[x, y] == pytest.approx(both[x].rank().corr(both[y].rank()), abs=1e-12), (x, y)
            else:
                assert got[x, y] == pytest.approx(tau_b(both[x].rank().to_numpy(), both[y].rank().to_numpy()), abs=1e-12), (x, y)


def test_presence_classes(gappy):
    pdf, df = gappy
    values = [F.when(~F.isnan(c), F.col(c)) for c in pdf]
    classes = rank_correlation.presence_classes(df, values, pdf.notna().sum().tolist(), len(pdf))
    assert classes[2] == classes[4] == classes[5] == 0 and classes[0] == classes[1] > 0
    assert len({classes[0], classes[3], classes[6], 0}) == 4


def test_no_sketch_and_no_cube_of_columns(spark, gappy, monkeypatch):
    """Distinct values are counted where they are folded anyway; sums of pairs are products of matrices over rows."""
    pdf, df = gappy
    used, real = [], F.approx_count_distinct
    monkeypatch.setattr(rank_correlation.F, "approx_count_distinct", lambda *a: (used.append(a), real(*a))[1])
    for method in ("spearman", "kendall"):
        correlation.correlation_matrix(df, method, one_task=300)
    assert not used
    values = {i: F.when(~F.isnan(c), F.col(c)) for i, c in enumerate(pdf)}
    monkeypatch.setattr(rank_correlation, "FEW_VALUES", 40)
    few = rank_correlation.few_values(df, values)
    want = {i: sorted(pdf[c].dropna().unique()) for i, c in enumerate(pdf) if 0 < pdf[c].nunique() <= 40}
    assert {i: v.tolist() for i, v in few.items()} == want and 0 < len(want) < len(pdf.columns)
    rng = np.random.default_rng(5)
    classes = [0, 1, 0, 2, 1]
    ranks = rng.integers(1, 900, (5000, 5, 3)) / 2
    for c in (1, 2):
        ranks[np.ix_(rng.random(5000) < 0.2, [i for i, k in enumerate(classes) if k == c])] = np.nan
    sums = rank_correlation._PairSums(classes)
    sums.step = 999
    sums.add(ranks)
    for i in range(5):
        for j in range(5):
            both = ~np.isnan(ranks[:, i, 0] + ranks[:, j, 0])
            x, y = ranks[both, i, classes[j]], ranks[both, j, classes[i]]
            assert (sums.n[i, j], sums.x[i, j], sums.xx[i, j], sums.xy[i, j]) == (both.sum(), x.sum(), (x * x).sum(), (x * y).sum())


def test_inversions():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 9, 120):
        for kinds in (1, 2, 7, 500):
            x = rng.integers(0, kinds, n)
            assert rank_correlation.inversions(x) == sum(int((x[:i] > x[i]).sum()) for i in range(n))


def test_no_row_is_copied_per_pair(spark, gappy, monkeypatch):
    """Twelve columns with gaps in 66 pairs: no stage makes more rows than rows times columns."""
    _, df = gappy
    wide = df.select([F.when(F.col("c") != i % 3, F.col(c) + i).alias(f"{c}{i}") for i in range(3) for c in "abde"])
    monkeypatch.setattr("tallyframe.limits.BROADCAST_ROWS", 10)
    for method in ("spearman", "kendall"):
        seen, kind = [], type(wide)
        real = kind.groupBy
        monkeypatch.setattr(kind, "groupBy", lambda self, *k: (seen.append((self, k)), real(self, *k))[1])
        correlation.correlation_matrix(wide, method, one_task=200)
        monkeypatch.setattr(kind, "groupBy", real)
        large = [frame.count() for frame, keys in seen if keys and keys[0] in ("column", "c")]
        assert large and max(large) <= 12 * 700, method


def test_cells_of_single_values_are_folded_per_task():
    """A task gives out each pair of blocks once, not once per batch."""
    cuts = [np.arange(50.0), np.arange(0.0, 1000.0, 2.0)]
    cells = rank_correlation._PointCells(cuts)
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 50, (4, 30_000)).astype(float), rng.integers(0, 1000, (4, 30_000)).astype(float)
    y[0, 0] = np.nan
    for one, other in zip(x, y, strict=True):
        cells.add([one, other])
    found = {(c, d): (p, q, w) for c, d, p, q, w in cells.take()}
    want = pd.Series(1, index=pd.MultiIndex.from_arrays([rank_correlation.block_of(v.ravel(), k) for v, k in zip((x, y), cuts, strict=True)])).groupby(level=[0, 1]).sum()
    want = want[want.index.get_level_values(1) >= 0]
    p, q, w = found[0, 1]
    assert dict(zip(zip(p.tolist(), q.tolist(), strict=True), w.tolist(), strict=True)) == want.to_dict()
    assert found[1, 0][2].sum() == (y % 2 == 0).sum()


def test_columns_of_few_values_do_not_move(spark, monkeypatch):
    """Each of their values is a cut, so that only columns of many values are dealt to blocks."""
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"a": rng.integers(0, 40, 3000) * 1.0, "b": rng.integers(0, 3000, 3000) * 1.0, "c": rng.integers(0, 3, 3000) * 1.0})
    seen = []
    cut = rank_correlation.balanced_cuts
    monkeypatch.setattr(rank_correlation, "balanced_cuts", lambda df, values, ranges, size: seen.extend(ranges) or cut(df, values, ranges, size))
    got = correlation.correlation_matrix(spark.createDataFrame(frame), "kendall", one_task=500).collect()
    assert seen == ["1"]
    above = {n: np.sign(np.subtract.outer(v, v)) for n, v in zip(frame, frame.to_numpy().T, strict=True)}
    for r in got:
        x, y = above[r["col_a"]], above[r["col_b"]]
        assert abs(r["r"] - (x * y).sum() / np.sqrt((x * x).sum()) / np.sqrt((y * y).sum())) < 1e-12

"""Profiles, charts, time series and texts, against pandas and by hand."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.functions.words import tokens
from tallyframe.operators import text
from tallyframe.operators.timeseries import resample
from tallyframe.plans import charts, correlation, frequencies, profile, report, statistics


@pytest.fixture(scope="module")
def messy():
    rng = np.random.default_rng(11)
    n = 500
    return pd.DataFrame(
        {
            "normal": np.where(rng.random(n) < 0.1, np.nan, rng.normal(50, 12, n)),
            "skewed": rng.exponential(3, n).round(2),
            "ties": rng.integers(0, 6, n).astype(float),
            "flat": np.full(n, 4.0),
            "empty": np.full(n, np.nan),
        }
    )


@pytest.fixture(scope="module")
def messy_df(spark, messy):
    return spark.createDataFrame(messy).repartition(5).cache()


def test_numeric_profile_matches_pandas(messy, messy_df):
    got = statistics.numeric_profile(messy_df).toPandas().set_index("column")
    assert list(got.index) == list(messy.columns)
    for c in messy.columns:
        s = messy[c].dropna()
        assert got.loc[c, "count"] == s.count() and got.loc[c, "missing"] == messy[c].isna().sum()
        assert got.loc[c, "unique_values"] == s.nunique()
        for name, want in {
            "mean": s.mean(), "median": s.median(), "std": s.std(), "var": s.var(), "min": s.min(), "max": s.max(),
            "q10": s.quantile(0.1), "q90": s.quantile(0.9), "skew": s.skew(), "kurtosis": s.kurtosis(),
        }.items():
            assert got.loc[c, name] == pytest.approx(want, rel=1e-9, abs=1e-9, nan_ok=True), (c, name)


@pytest.mark.parametrize("rows", [0, 1, 2, 3])
def test_profile_of_few_rows(spark, rows):
    df = spark.createDataFrame([(float(i),) for i in range(rows)], "x double")
    got = statistics.numeric_profile(df).collect()
    assert len(got) == 1 and got[0]["count"] == rows
    want = pd.Series(np.arange(rows, dtype=float))
    for name, value in {"std": want.std(), "skew": want.skew(), "kurtosis": want.kurtosis()}.items():
        assert got[0][name] == pytest.approx(value, abs=1e-12) if value == value else got[0][name] is None


def test_column_blocks_do_not_change_the_result(messy_df, monkeypatch):
    want = statistics.numeric_profile(messy_df).toPandas()
    monkeypatch.setattr("tallyframe.limits.FUSED_COLUMNS", 2)
    pd.testing.assert_frame_equal(statistics.numeric_profile(messy_df).toPandas(), want)


def test_approximate_profile_is_close(messy, messy_df):
    got = statistics.numeric_profile(messy_df, exact=False).toPandas().set_index("column")
    assert got.loc["skewed", "median"] == pytest.approx(messy["skewed"].median(), abs=0.1)


def test_categorical_profile(answers):
    rows = frequencies.categorical_profile(answers, ["category"]).collect()
    assert [(r["rank"], r["value"], r["value_count"]) for r in rows] == [(1, "N", 3), (2, "S", 3), (3, "W", 2), (4, "E", 1)]
    assert rows[0]["count"] == 9 and rows[0]["missing"] == 1 and rows[0]["unique_values"] == 4
    assert rows[0]["value_pct"] == 33.33


def test_pearson_and_spearman_match_pandas(messy, messy_df):
    for method in ("pearson", "spearman"):
        got = correlation.correlation_matrix(messy_df, method).toPandas()
        want = messy.corr(method=method)
        assert len(got) == 25
        for r in got.itertuples():
            expected = want.loc[r.col_a, r.col_b]
            assert r.r == pytest.approx(expected, abs=1e-9) if expected == expected else r.r != r.r or r.r is None, r


def test_wide_correlation_equals_narrow(messy_df, monkeypatch):
    want = correlation.correlation_matrix(messy_df).toPandas().sort_values(["col_a", "col_b"], ignore_index=True)
    monkeypatch.setattr("tallyframe.limits.PAIRWISE_CORR_COLUMNS", 1)
    got = correlation.correlation_matrix(messy_df).toPandas().sort_values(["col_a", "col_b"], ignore_index=True)
    pd.testing.assert_frame_equal(got, want)


def tau_b(x, y):
    """Brute force over all pairs."""
    keep = ~(np.isnan(x) | np.isnan(y))
    x, y = x[keep], y[keep]
    a, b = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    below = np.sqrt((a != 0).sum()) * np.sqrt((b != 0).sum())
    return (a * b).sum() / below if below else np.nan


def test_kendall_matches_brute_force(messy, messy_df):
    names = ["normal", "skewed", "ties"]
    got = correlation.correlation_matrix(messy_df, "kendall", names).toPandas().set_index(["col_a", "col_b"])["r"]
    for a in names:
        for b in names:
            want = 1.0 if a == b else tau_b(messy[a].to_numpy(), messy[b].to_numpy())
            assert got[a, b] == pytest.approx(want, abs=1e-12)


def test_strong_pairs_leave_the_diagonal_out(spark):
    df = spark.createDataFrame([(i, 2 * i, -i, i % 2) for i in range(20)], "a int, b int, c int, d int")
    rows = correlation.strong_correlations(df, threshold=0.9).collect()
    assert [(r["col_a"], r["col_b"], round(r["r"])) for r in rows] == [("a", "b", 1), ("a", "c", -1), ("b", "c", -1)]
    assert correlation.strong_matrix(df, threshold=0.9).count() == 9


@pytest.mark.parametrize("bins", [1, 7, 20])
def test_histogram_matches_numpy(messy, messy_df, bins):
    for c in ("normal", "skewed", "ties", "flat"):
        rows = charts.histogram(messy_df, c, bins).collect()
        counts, edges = np.histogram(messy[c].dropna(), bins=bins)
        assert [r["count"] for r in rows] == counts.tolist(), c
        assert [r["lo"] for r in rows] + [rows[-1]["hi"]] == pytest.approx(edges.tolist())


def test_density_is_one_in_total(messy, messy_df):
    rows = charts.density(messy_df, "normal").collect()
    x, y = [r["x"] for r in rows], [r["density"] for r in rows]
    assert np.trapezoid(y, x) == pytest.approx(1, abs=0.01)
    s = messy["normal"].dropna().to_numpy()
    width = s.std(ddof=1) * len(s) ** -0.2
    middle = x[100]
    want = np.exp(-(((middle - s) / width) ** 2) / 2).sum() / (len(s) * width * np.sqrt(2 * np.pi))
    assert y[100] == pytest.approx(want, rel=1e-3)


def test_box(answers):
    box = charts.box_stats(answers, "value1").first()
    s = pd.Series([12, 18, 27, 24, 33, 41, 38, 52, 47], dtype=float)
    assert (box["q1"], box["median"], box["q3"]) == tuple(s.quantile([0.25, 0.5, 0.75]))
    assert box["whisker_low"] == 12 and box["whisker_high"] == 52 and box["outliers"] == 0
    grouped = {r["category"]: r for r in charts.box_stats(answers, "value1", "category").collect()}
    assert set(grouped) == {"N", "S", "W", "E"} and grouped["W"]["median"] == 41


def test_durations_count_as_seconds(answers):
    rows = charts.histogram(answers, "duration", 10).collect()
    assert rows[0]["lo"] == 420 and rows[-1]["hi"] == 4200 and sum(r["count"] for r in rows) == 10
    assert charts.scatter_points(answers, "duration", "value1").agg(F.max("duration")).first()[0] == 4200
    assert charts.heatmap(answers.select("value1", "duration")).first()["r"] == pytest.approx(1.0, abs=0.1)


def test_chart_bundle(answers):
    found = {r["chart_id"] for r in charts.chart_bundle(answers).select("chart_id").distinct().collect()}
    assert {"missing", "hist_value1", "hist_duration", "bar_category", "pie_category", "correlation", "scatter_id_value1", "box_id_by_category"} <= found


def test_resampling(answers, spark):
    assert resample(answers, "date", "value1", "D").count() == 10
    month = resample(answers, "date", "value1", "M", "sum").collect()
    assert len(month) == 1 and month[0]["date"] == dt.date(2022, 3, 31) and month[0]["value"] == 292
    sparse = spark.createDataFrame([("2024-01-31", 1.0), ("2024-03-01", 2.0), ("2024-06-30", 4.0), (None, 9.0)], "d string, v double")
    pdf = sparse.toPandas().dropna()
    pdf.index = pd.to_datetime(pdf["d"])
    for freq in ("D", "W", "ME", "QE", "YE"):
        for agg in ("mean", "sum", "count", "min", "max"):
            got = resample(sparse, "d", "v", freq, agg).toPandas()
            want = getattr(pdf["v"].resample(freq), agg)()
            assert got["date"].astype(str).tolist() == want.index.strftime("%Y-%m-%d").tolist(), freq
            np.testing.assert_allclose(got["value"].astype(float), want.to_numpy().astype(float))


def test_tokens_keep_hangul_and_drop_stop_words(spark):
    df = spark.createDataFrame([("이 제품은 정말 좋습니다! 100점, 그리고 a B2B é_x 하는",)], "t string")
    got = df.select(tokens(F.col("t"))).first()[0]
    assert got == ["제품은", "정말", "좋습니다", "그리고", "é_x"]
    assert df.select(tokens(F.col("t"), ())).first()[0][-1] == "하는"


def test_text_summary(answers, spark):
    df = spark.createDataFrame([("aa bb aa",), ("bb cc",), (None,), ("x" * 250,)], "t string")
    assert [(r["word"], r["count"]) for r in text.word_frequency(df, "t", 2).collect()] == [("aa", 2), ("bb", 2)]
    longest = text.longest_texts(df, "t", 2).orderBy("rank").collect()
    assert longest[0]["sample"] == "x" * 200 + "..." and longest[1]["sample"] == "aa bb aa"
    summary = text.text_summary(df, ["t", "nope"]).collect()
    assert len(summary) == 1 and summary[0]["response_count"] == 3 and summary[0]["avg_length"] == pytest.approx((8 + 5 + 250) / 3)
    parts = text.text_analysis(answers, ["text", "category"])
    assert parts["summary"].count() == 2 and parts["keywords"].where("`column` = 'text'").count() == 9


def test_summary_and_full_profile(answers):
    facts = {(r["section"], r["name"]): r["value"] for r in profile.dataset_summary(answers).collect()}
    assert facts["shape", "rows"] == 10 and facts["shape", "columns"] == 7 and facts["total", "missing_cells"] == 3
    assert facts["kind", "numeric"] == 3 and facts["kind", "datetime"] == 2
    parts = profile.full_profile(answers, ["text"])
    assert {"summary", "numeric", "categorical", "correlation", "strong_correlation", "group", "text_word_freq"} <= set(parts)
    assert parts["group"].columns[0] == "text" or parts["group"].columns[0] == "category"
    assert profile.column_analysis(answers).count() == 7


def test_before_after(answers):
    row = {r["column"]: r for r in report.before_after(answers, answers.where("id > 5")).collect()}["value1"]
    assert row["rows_removed"] == 5 and row["missing_before"] == 1 and row["missing_after"] == 0


def test_long_categories_are_counted_by_key(spark):
    from tallyframe.plans import frequencies

    head = "the same beginning of a text that is longer than a key may be, " * 2
    rows = [(head + "a",)] * 3 + [(head + "b",)] * 2 + [("short",)] * 4 + [("",)] + [(None,)]
    df = spark.createDataFrame(rows, "t string")
    got = [(r["value"], r["value_count"], r["unique_values"]) for r in frequencies.categorical_profile(df).collect()]
    assert got == [("short", 4, 4), (head + "a", 3, 4), (head + "b", 2, 4), ("", 1, 4)]
    assert max(len(r["value"]) for r in frequencies.keyed_counts(df, ["t"]).collect()) == 129

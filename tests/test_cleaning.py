"""Missing values, types, outliers, scaling and steps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import missing, outliers, scaling, types
from tallyframe.plans.cleaning import StepFailed, clean_with, default_clean


def column(df, name):
    return [r[0] for r in df.select(name).collect()]


@pytest.fixture(scope="module")
def spiky(spark):
    values = [10.0, 15.0, 12.0, 14.0, 100.0, 13.0, 11.0, 9.0, 150.0, 14.0]
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, value double")


@pytest.fixture(scope="module")
def steps(spark):
    return spark.createDataFrame([(10.0,), (20.0,), (30.0,), (40.0,), (50.0,)], "value double")


def test_drop_rows(staff):
    assert missing.drop_missing_rows(staff, ["age"], 0.1).count() == 8
    assert missing.drop_missing_rows(staff, ["age", "department"], 0.0).count() == 7
    assert missing.drop_missing_rows(staff, threshold=0.5).count() == 10


def test_drop_columns(staff):
    kept = missing.drop_missing_columns(staff, threshold=0.1).columns
    assert kept == ["id", "name", "salary", "experience", "score"]


def test_fill(staff):
    out = missing.fill_missing(staff, {"age": 30.0, "department": "Unknown"}, threshold=0.0)
    assert missing.missing_summary(out).first()["missing_cells"] == 0
    auto = missing.fill_missing(staff, {"name": "?"}, threshold=0.0)
    assert 37.75 in column(auto, "age") and column(auto, "department").count("Lab") == 5
    assert missing.fill_missing(staff, None).count() == 10
    assert missing.missing_summary(missing.handle_missing_values(staff, "fill_values")).first()["missing_cells"] == 4


def test_impute(staff):
    assert missing.impute(staff, "age", "drop").count() == 8
    assert 37.5 in column(missing.impute(staff, "age", "median"), "age")
    assert None not in column(missing.impute(staff, "department", "mode"), "department")
    assert 1.5 in column(missing.impute(staff, "age", "constant", "1.5"), "age")
    with pytest.raises(ValueError):
        missing.impute(staff, "department", "mean")
    with pytest.raises(ValueError):
        missing.impute(staff, "age", "constant", "many")


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert missing.missing_profile(df).first()["missing_count"] == 2
    assert sorted(column(missing.impute(df, "x", "mean"), "x")) == [1.0, 2.0, 2.0, 3.0]
    assert column(missing.drop_missing_rows(df, threshold=0.1), "x") == [1.0, 3.0]


def test_missing_profile(staff):
    rows = [(r["column"], r["missing_count"], r["missing_percent"]) for r in missing.missing_profile(staff).collect()]
    assert rows == [("age", 2, 20.0), ("department", 2, 20.0)]
    summary = missing.missing_summary(staff).first()
    assert summary["columns_with_missing"] == 2 and summary["columns_over_10_percent"] == 2
    assert summary["columns_over_50_percent"] == 0 and summary["missing_percent"] == 5.71


def test_conversion(spark):
    df = spark.createDataFrame(
        [("1", 1.1, "2020-01-01", "true"), ("2", 2.2, "2020-01-02", "no"), ("x", 3.3, "never", "1"), ("3.7", None, None, "?")],
        "i string, s double, d string, b string",
    )
    out = types.convert_data_types(df, {"i": "int", "s": "str", "d": "datetime", "b": "bool", "zz": "int", "i2": "odd"})
    rows = out.collect()
    assert [r["i"] for r in rows] == [1, 2, None, None]
    assert [r["s"] for r in rows] == ["1.1", "2.2", "3.3", None]
    assert rows[0]["d"].year == 2020 and rows[2]["d"] is None
    assert [r["b"] for r in rows] == [True, False, True, None]
    assert types.convert_data_types(df, {"i": "int"}, "ignore").schema["i"].dataType.simpleString() == "string"
    assert types.convert_data_types(df.limit(2), {"i": "int"}, "ignore").schema["i"].dataType.simpleString() == "bigint"
    with pytest.raises(Exception, match="cannot read column i"):
        types.convert_data_types(df, {"i": "int"}, "raise").collect()


def test_long_integers_stay_exact(spark):
    df = spark.createDataFrame([("9007199254740993",)], "i string")
    assert types.convert_data_types(df, {"i": "int"}).first()["i"] == 9007199254740993


def test_coercion_needs_under_30_percent_failing(spark):
    rows = [(str(i) if i < 8 else "x", str(i) if i < 7 else "x", None, "1d") for i in range(10)]
    df = spark.createDataFrame(rows, "most string, edge string, empty string, odd string")
    out = types.coerce_numeric(df)
    assert [f.dataType.simpleString() for f in out.schema] == ["double", "string", "string", "string"]
    assert column(out, "most").count(None) == 2


def test_column_types(answers):
    got = {r["column"]: r for r in types.column_types(answers).collect()}
    assert got["id"]["category"] == "integer" and got["value1"]["category"] == "float"
    assert got["date"]["category"] == "datetime" and got["duration"]["category"] == "timedelta"
    assert got["category"]["category"] == "text"  # four values in ten rows are over one per ten
    assert got["category"]["unique_count"] == 4 and got["category"]["missing_percent"] == 10.0


def test_free_text(spark):
    df = spark.createDataFrame([("a" * 30, "b", "c" * 101), ("a", "b", "d")], "x string, y string, z string")
    got = {r["column"]: r for r in types.detect_free_text(df).collect()}
    assert [got[c]["is_free_text"] for c in "xyz"] == [False, False, True]
    assert got["z"]["sample"] == "c" * 50 + "..."


def test_narrow_integers(spark):
    df = spark.createDataFrame([(1, 300, 70000, -1, None), (127, -5, 5, 2**40, None)], "a long, b long, c long, d long, e long")
    out = types.narrow_integers(df)
    assert [f.dataType.simpleString() for f in out.schema] == ["tinyint", "smallint", "int", "bigint", "bigint"]


def test_iqr(spiky):
    assert outliers.handle_outliers(spiky, ["value"]).count() == 8
    clipped = column(outliers.handle_outliers(spiky, ["value"], strategy="clip"), "value")
    pdf = pd.Series(column(spiky, "value"))
    upper = pdf.quantile(0.75) + 1.5 * (pdf.quantile(0.75) - pdf.quantile(0.25))
    assert len(clipped) == 10 and clipped[4] == clipped[8] == pytest.approx(upper)
    mean = column(outliers.handle_outliers(spiky, ["value"], strategy="replace_mean"), "value")
    assert mean[4] == pytest.approx(np.mean([10, 15, 12, 14, 13, 11, 9, 14]))
    median = column(outliers.handle_outliers(spiky, ["value"], strategy="replace_median"), "value")
    assert median[8] == 12.5


def test_zscore_and_percentile(spiky):
    v = np.array(column(spiky, "value"))
    z = np.abs((v - v.mean()) / v.std())
    assert outliers.handle_outliers(spiky, ["value"], "zscore", 1.5).count() == int((z <= 1.5).sum())
    s = pd.Series(v)
    inside = (s >= s.quantile(0.1)) & (s <= s.quantile(0.9))
    assert outliers.handle_outliers(spiky, ["value"], "percentile", 10).count() == int(inside.sum())
    flat = spiky.select(F.lit(3.0).alias("value"))
    assert outliers.handle_outliers(flat, ["value"], "zscore").count() == 10


def test_missing_rows_survive_outlier_removal(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 1000]] + [(None,), (float("nan"),)], "x double")
    assert outliers.handle_outliers(df).count() == 6
    clipped = outliers.handle_outliers(df, strategy="clip")
    assert clipped.where("x is null").count() == 2


def test_sequential_bounds_follow_the_filtered_rows(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=400), rng.normal(size=400)
    a[:20] += 8
    b[:20] -= 3
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))
    left = pd.DataFrame({"a": a, "b": b})
    for c in ("a", "b"):
        q1, q3 = left[c].quantile([0.25, 0.75])
        left = left[left[c].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))]
    assert outliers.handle_outliers(df, sequential=True).count() == len(left)


def test_rules_can_be_stored(spark, spiky):
    rules = outliers.fit_outliers(spiky, ["value"])
    again = outliers.OutlierRules.from_frame(rules.to_frame(spark))
    assert again == rules and again.apply(spiky).count() == 8
    scaled = scaling.fit_scaling(spiky, ["value"])
    assert scaling.ScalingRules.from_frame(scaled.to_frame(spark)) == scaled


def test_scaling(steps):
    def go(method, **options):
        return column(scaling.normalize_data(steps, method=method, **options), "value")

    assert go("minmax") == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert go("minmax", custom_range=(-1, 1)) == [-1.0, -0.5, 0.0, 0.5, 1.0]
    z = go("zscore")
    assert np.mean(z) == pytest.approx(0) and np.std(z, ddof=1) == pytest.approx(1.1180339887498947)
    assert go("robust") == [-1.0, -0.5, 0.0, 0.5, 1.0]
    assert go("log") == pytest.approx([math.log(x) for x in (10, 20, 30, 40, 50)])


def test_scaling_of_constants_and_negatives(spark):
    df = spark.createDataFrame([(5.0, -2.0), (5.0, 0.0), (None, 3.0)], "flat double, neg double")
    assert column(scaling.normalize_data(df, ["flat"]), "flat") == [0.0, 0.0, None]
    assert column(scaling.normalize_data(df, ["flat"], "zscore"), "flat") == [0.0, 0.0, None]
    assert column(scaling.normalize_data(df, ["flat"], "robust"), "flat") == [0.0, 0.0, None]
    assert column(scaling.normalize_data(df, ["neg"], "log"), "neg") == pytest.approx([0.0, math.log(3), math.log(6)])


def test_steps_run_in_order_and_name_the_failing_one(spiky):
    out = clean_with(
        spiky,
        [("cut", outliers.handle_outliers, {"columns": ["value"]}), ("scale", scaling.normalize_data, {"columns": ["value"]})],
    )
    assert out.count() == 8 and out.agg(F.max("value")).first()[0] == 1.0
    with pytest.raises(StepFailed, match="odd step"):
        clean_with(spiky, [("odd step", outliers.handle_outliers, {"method": "guess"})])


def test_default_clean(spiky):
    assert default_clean(spiky).count() == 8
    assert default_clean(spiky, outliers=False).count() == 10

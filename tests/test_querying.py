"""Filters, projections, sorts, groups and SQL on a ten-row table with gaps."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import aggregate, filters, project, sorting, udf
from tallyframe.operators.sql import execute_sql


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_projection_ignores_unknown_names(answers):
    assert project.select_columns(answers, ["id", "nope", "text"]).columns == ["id", "text"]
    assert project.select_columns(answers, ["nope"]).columns == answers.columns


def test_membership(answers):
    assert filters.filter_by_value(answers, "category", ["N", "S"]).count() == 6
    assert filters.filter_by_value(answers, "category", ["N", "S"], include=False).count() == 4
    assert filters.filter_by_value(answers, "category", [None]).count() == 1
    assert filters.filter_by_value(answers, "category", ["N", None], include=False).count() == 6
    assert filters.filter_by_value(answers, "nope", ["N"]).count() == 10


def test_range(answers):
    assert filters.filter_by_range(answers, "value1", 18, 38).count() == 5
    assert filters.filter_by_range(answers, "value1", 18, 38, "left").count() == 4
    assert filters.filter_by_range(answers, "value1", 18, 38, "right").count() == 4
    assert filters.filter_by_range(answers, "value1", 18, 38, "neither").count() == 3
    assert filters.filter_by_range(answers, "value1", min_value=47).count() == 2
    assert filters.filter_by_range(answers, "value1").count() == 10
    with pytest.raises(ValueError):
        filters.filter_by_range(answers, "value1", 1, 2, "some")


def test_range_leaves_nan_out(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, 9.0)], "id int, x double")
    assert ids(filters.filter_by_range(df, "x", min_value=5)) == [4]
    assert ids(df.where(filters.filter_condition(df, "x", "greater", "5"))) == [4]


def test_predicate_string(answers):
    assert ids(filters.filter_where(answers, "value1 > 20 and category == 'N'")) == [4, 8]


def test_conditions(staff):
    old, rich = (lambda d: F.col("age") > 30), (lambda d: F.col("salary") > 70000)
    assert filters.filter_data(staff, [old, rich]).count() == 4
    assert filters.filter_data(staff, [old, rich], "or").count() == 6
    assert filters.filter_data(staff, []).count() == 10
    assert filters.filter_data(staff, [lambda d: filters.differs(d, "department", "Lab")]).count() == 7


def test_search(answers):
    assert filters.search_text(answers, "text", "^[a-d]").count() == 3
    assert filters.search_text(answers, "text", "oak", regex=False).count() == 1
    assert filters.search_text(answers, "text", "OAK", case=True).count() == 0
    assert filters.search_text(answers, "text", "OAK").count() == 1
    assert filters.search_text(answers, "text", ".", regex=False).count() == 0
    assert filters.search_text(answers, "category", ".").count() == 9
    assert filters.search_text(answers, "id", "1", regex=False).count() == 2


def test_filter_form(answers):
    def found(*args):
        return ids(answers.where(filters.filter_condition(answers, *args)))

    assert found("id", "equals", "3") == [3]
    assert found("category", "equals", "N") == [1, 4, 8]
    assert found("text", "equals", "77") == []
    assert found("text", "contains", "[xz]") == [6]
    assert found("value1", "between", "20", "30") == [4, 5]
    with pytest.raises(ValueError):
        found("value1", "greater", "many")


def test_sorting_puts_missing_last_both_ways(answers):
    up = [r["value1"] for r in sorting.sort_values(answers, "value1").collect()]
    down = [r["value1"] for r in sorting.sort_values(answers, ["value1"], False).collect()]
    assert up[-1] is None and down[-1] is None and up[0] == 12.0 and down[0] == 52.0
    assert sorting.sort_values(answers, ["nope"]).columns == answers.columns


def test_sorting_puts_nan_last(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    assert sorting.sort_values(df, "x", False).first()["x"] == 3.0


def test_group_and_aggregate(answers):
    out = aggregate.group_and_aggregate(answers, "category", {"value1": ["mean", "median", "count"], "nope": "sum"})
    rows = {r["category"]: r for r in out.collect()}
    assert list(rows) == ["E", "N", "S", "W"]
    assert rows["N"]["value1_mean"] == pytest.approx(77 / 3)
    assert rows["N"]["value1_median"] == 27 and rows["N"]["value1_count"] == 3
    with pytest.raises(ValueError):
        aggregate.group_and_aggregate(answers, "category", {"value1": "first"})


def test_group_by_against_pandas(answers):
    pdf = answers.select("id", "category", "value1", "value2").toPandas()
    want = pdf.groupby("category").agg({"value1": ["mean", "median", "std", "min", "max", "count", "sum", "var"]})
    got = aggregate.group_and_aggregate(
        answers, "category", {"value1": ["mean", "median", "std", "min", "max", "count", "sum", "var"]}
    ).toPandas()
    for f in ("mean", "median", "std", "min", "max", "count", "sum", "var"):
        pd.testing.assert_series_equal(
            got[f"value1_{f}"], want[("value1", f)].reset_index(drop=True), check_names=False, check_dtype=False
        )


def test_pivot_against_pandas(answers):
    flagged = answers.withColumn("side", F.when(F.col("id") <= 5, "low").otherwise("high"))
    got = aggregate.pivot_table(flagged, "category", "side", "value2").toPandas().set_index("category")
    want = pd.pivot_table(
        flagged.select("category", "side", "value2").toPandas(), index="category", columns="side", values="value2"
    )
    pd.testing.assert_frame_equal(got, want, check_names=False)
    plain = aggregate.pivot_table(answers, "category", values="value1", aggfunc=["mean", "max"])
    assert plain.columns == ["category", "value1_mean", "value1_max"]
    with pytest.raises(ValueError, match="more than 3"):
        aggregate.pivot_table(answers, "category", "id", "value1", max_values=3)
    assert aggregate.pivot_cells(answers, "category", "id", "value1").count() == 8


def test_pivot_keeps_colliding_labels_apart(spark):
    rows = [("k", "x_y", "z", 10.0), ("k", "x", "y_z", 20.0), ("k", "a", "b", 30.0)]
    df = spark.createDataFrame(rows, "k string, p string, q string, v double")
    got = aggregate.pivot_table(df, "k", ["p", "q"], "v").first().asDict()
    assert got == {"k": "k", "a_b": 30.0, "x\\_y_z": 10.0, "x_y\\_z": 20.0}


def test_form_numbers_stay_exact_and_reach_the_scan(spark, tmp_path):
    big = 2**53
    spark.createDataFrame([(big,), (big + 1,), (7,), (None,)], "id long").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    test = lambda *a: sorted(r[0] for r in df.where(filters.filter_condition(df, "id", *a)).collect())
    assert test("equals", str(big + 1)) == [big + 1] and test("equals", "7.0") == [7] and test("equals", "7.5") == []
    assert test("greater", "6.5") == [7, big, big + 1] and test("less", "7.5") == [7] and test("between", "7", str(big)) == [7, big]
    assert test("less", "1e30") == [7, big, big + 1] and test("greater", "1e30") == []
    plan = df.where(filters.filter_condition(df, "id", "equals", "7"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,7)" in plan


def test_calculated_columns(answers):
    out = project.add_calculated_column(answers, "total", "value1 + value2").orderBy("id").collect()
    assert out[2]["total"] is None and out[5]["total"] is None and out[1]["total"] == 25
    out = project.add_derived_column(answers, "double", lambda d: F.col("value1") * 2)
    assert out.where("id = 2").first()["double"] == 36


def test_sql_sees_the_table_and_leaves_no_view(spark, answers):
    spark.range(3).createOrReplaceTempView("df")
    out = execute_sql(answers, "SELECT category, count(*) AS n FROM df GROUP BY category")
    assert {r["category"]: r["n"] for r in out.collect()}["N"] == 3
    assert spark.table("df").count() == 3
    spark.catalog.dropTempView("df")
    joined = execute_sql(answers, "SELECT df.id FROM df JOIN other ON df.id = other.id", other=spark.range(4))
    assert joined.count() == 3
    assert not [t for t in spark.catalog.listTables() if t.name in ("df", "other")]


def test_counts_and_others(answers):
    top = aggregate.value_counts(answers, "category", 2).collect()
    assert [(r["value"], r["count"]) for r in top] == [("N", 3), ("S", 3)]
    shares = {r["value"]: r["count"] for r in aggregate.top_n_with_others(answers, "category", 1).collect()}
    assert shares == {"N": 3, "Others": 6}
    assert aggregate.top_n_with_others(answers, "category", 9).count() == 4


def test_row_and_column_functions(answers):
    def label(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": frame["id"], "label": frame["category"].fillna("-") + frame["id"].astype(str)})

    out = udf.apply_rows(answers, label, "id long, label string", ["id", "category"])
    assert {r["id"]: r["label"] for r in out.collect()}[5] == "-5"
    assert udf.apply_columns(answers, F.max, ["value1", "value2"]).first().asDict() == {"value1": 52.0, "value2": 9.5}


def test_own_aggregate_merges_states(spark):
    df = spark.range(10_000).repartition(16).selectExpr("id % 3 AS k", "cast(id AS double) AS v")
    out = udf.merge_aggregate(
        df,
        ["k"],
        ["v"],
        lambda rows: {"n": len(rows), "s": float(rows["v"].sum())},
        "n bigint, s double",
        lambda states: {"n": int(states["n"].sum()), "s": float(states["s"].sum())},
        lambda states: pd.DataFrame({"mean": states["s"] / states["n"]}),
        "mean double",
    )
    want = df.groupBy("k").agg(F.avg("v").alias("mean"))
    assert {r["k"]: r["mean"] for r in out.collect()} == pytest.approx({r["k"]: r["mean"] for r in want.collect()})


def test_names_with_dots_and_spaces(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (2, None, "y")], "`a.b` int, `c d` double, `e` string")
    assert filters.filter_by_range(df, "c d", 1, 3).count() == 1
    assert aggregate.group_and_aggregate(df, "a.b", {"c d": ["mean", "median"]}).columns == ["a.b", "c d_mean", "c d_median"]
    assert project.select_columns(df, ["a.b"]).columns == ["a.b"]


def test_small_groups_meet_before_they_are_aggregated(spark, monkeypatch):
    """A group's rows lie in every task; only those of a large one are aggregated where they are."""
    monkeypatch.setattr(udf, "LARGE_GROUP", 1_000)
    rows = spark.range(0, 12_000, 1, 8).select(F.when(F.col("id") % 4 == 0, F.lit(-1)).otherwise(F.col("id") % 300).alias("g"), F.col("id").cast("double").alias("v"))
    out = udf.merge_aggregate(
        rows,
        ["g"],
        ["v"],
        lambda f: {"pieces": 1, "total": float(f["v"].sum())},
        "pieces bigint, total double",
        lambda s: {"pieces": int(s["pieces"].sum()), "total": float(s["total"].sum())},
        lambda s: s[["pieces", "total"]],
        "pieces bigint, total double",
    )
    got = {r["g"]: (r["pieces"], r["total"]) for r in out.collect()}
    want = {r["g"]: r["t"] for r in rows.groupBy("g").agg(F.sum("v").alias("t")).collect()}
    assert {g: t for g, (_, t) in got.items()} == want
    assert got.pop(-1)[0] == 8 and {n for n, _ in got.values()} == {1}

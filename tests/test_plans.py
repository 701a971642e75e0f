"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from catalog import ORACLES, QUERIES
from tallyframe.operators import aggregate, filters, outliers, sorting, text
from tallyframe.plans import charts, frequencies, ranks

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


def read_columns(shown: str) -> set[str]:
    found = set()
    for struct in re.findall(r"ReadSchema: struct<([^>]*)>", shown):
        found |= {c.split(":")[0] for c in struct.split(",") if c}
    return found


def test_filters_reach_the_scan(lineitem, events):
    shown = plan(filters.filter_by_range(lineitem, "l_quantity", 10, 20).select("l_orderkey"))
    assert "GreaterThanOrEqual(l_quantity,10.0)" in shown and "LessThanOrEqual(l_quantity,20.0)" in shown
    assert read_columns(shown) == {"l_orderkey", "l_quantity"}
    assert "In(event_type" in plan(filters.filter_by_value(events, "event_type", ["a", "b"]))
    both = filters.filter_data(lineitem, [lambda d: F.col("l_tax") > 0.01, lambda d: F.col("l_discount") < 0.05])
    assert "GreaterThan(l_tax,0.01)" in plan(both) and "LessThan(l_discount,0.05)" in plan(both)


def test_fitted_rules_apply_without_a_shuffle(events):
    shown = plan(outliers.handle_outliers(events, ["value"]))
    assert "Exchange" not in shown and "Python" not in shown


def test_group_reads_only_its_columns_and_combines_first(lineitem):
    shown = plan(aggregate.group_and_aggregate(lineitem, "l_returnflag", {"l_quantity": ["sum", "max"]}))
    assert read_columns(shown) == {"l_returnflag", "l_quantity"}
    assert "partial_sum" in shown


def test_top_k_per_column_is_cut_before_the_shuffle(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    counts = frequencies.category_counts(part, ["p_brand", "p_type"])
    shown = plan(frequencies.top_categories(counts, 3))
    assert "WindowGroupLimit" in shown and "Partial" in shown


def test_counts_and_words_end_in_a_bounded_top_k(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (text.word_frequency(documents, "text"), text.longest_texts(documents, "text"), aggregate.value_counts(documents, "lang", 3)):
        assert "TakeOrderedAndProject" in plan(df)
    assert read_columns(plan(text.word_frequency(documents, "text"))) == {"text"}


def test_split_ranks_keep_no_unpartitioned_window(spark):
    counts = ranks.count_values(spark.range(5_000).selectExpr("cast(id % 900 AS double) AS value"), [])
    shown = plan(ranks.rank_values(counts, [], 900, one_task=50))
    assert "CartesianProduct" not in shown and "_part" in shown


def test_no_plan_multiplies_rows_by_rows(lineitem, events):
    for df in (
        charts.histogram(lineitem, "l_quantity"),
        charts.scatter_grid(events, "user_id", "value"),
        charts.pair_grid(lineitem.select("l_quantity", "l_tax")),
        sorting.sort_values(events, "value"),
    ):
        assert "CartesianProduct" not in plan(df)


def test_every_statement_has_its_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 120
    assert not [n for n in QUERIES if re.match(r"op\d", n) or n == "pipeline"]


QUICK = [
    "flagship", "filter_not_in", "group_agg", "pivot_multi", "top_n_others", "sql_setop", "convert_types", "column_types",
    "missing_fill_auto", "outlier_iqr_remove", "scale_robust", "numeric_profile_gaps", "categorical_profile_gaps",
    "corr_pearson_gaps", "corr_spearman", "resample_quarter", "tokenize", "word_freq", "histogram", "box_stats",
    "pair_grid", "workbook_rows", "scan_csv_line_breaks", "fitted_on_stream",
]


@pytest.mark.parametrize("name", QUICK)
def test_query_agrees_with_its_statement(spark, name):
    from tests.oracle import check, connect

    assert check(spark, connect(SF), name, SF) == ""


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() == 5
    assert driver.queries().keys() >= driver.oracle_sql().keys()


def test_scratch_is_shared_or_the_master_local(spark):
    from types import SimpleNamespace

    from tallyframe.plans import storage

    def session(master, named):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: named), sparkContext=context)

    assert storage.shared_folder(session("spark://host:7077", "hdfs://x/scratch")) == "hdfs://x/scratch"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_folder(session(master, None))
    assert storage.shared_folder(session("local[4]", None)) and storage.shared_folder(spark)

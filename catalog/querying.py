"""Projections, filters, sorts, grouping, pivots, SQL and user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tallyframe.operators import aggregate, filters, project, sorting, udf
from tallyframe.operators.sql import execute_sql

from .analysis import LINEITEM_NUMBERS
from .registry import EVENTS_WITH_GAPS, events_with_gaps, fix, fix_sql, query, sig, sig_sql, table, union_all


@query("select_columns", "SELECT event_id, value FROM events")
def _(spark, sf):
    return project.select_columns(table(spark, sf, "events"), ["event_id", "value", "no_such_column"])


@query(
    "calc_column",
    f"""SELECT l_orderkey, l_linenumber, {fix_sql('l_extendedprice * (1 - l_discount) * (1 + l_tax)')} AS charge
        FROM lineitem""",
)
def _(spark, sf):
    out = project.add_calculated_column(
        table(spark, sf, "lineitem"), "charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)"
    )
    return out.select("l_orderkey", "l_linenumber", fix("charge").alias("charge"))


@query(
    "calc_column_ratio",
    f"""SELECT event_id, {sig_sql('value / nullif(user_id % 10, 0)')} AS ratio, {sig_sql('ln(value + 1)')} AS log_value
        FROM {EVENTS_WITH_GAPS}""",
)
def _(spark, sf):
    df = events_with_gaps(spark, sf, nan=False)
    df = project.add_calculated_column(df, "ratio", "try_divide(value, user_id % 10)")
    df = project.add_calculated_column(df, "log_value", "ln(value + 1)")
    return df.select("event_id", sig("ratio").alias("ratio"), sig("log_value").alias("log_value"))


@query(
    "derived_column",
    "SELECT event_id, event_type, upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS label FROM events",
)
def _(spark, sf):
    out = project.add_derived_column(
        table(spark, sf, "events"),
        "label",
        lambda df: F.concat(F.upper(F.substring("event_type", 1, 1)), F.substring("event_type", 2, 1000)),
    )
    return out.select("event_id", "event_type", "label")


@query(
    "filter_expr",
    """SELECT * FROM lineitem
       WHERE l_quantity > 30 AND l_returnflag = 'A' AND (l_discount IN (0.05, 0.06) OR l_linestatus = 'F')""",
)
def _(spark, sf):
    return filters.filter_where(
        table(spark, sf, "lineitem"),
        "l_quantity > 30 and l_returnflag == 'A' and (l_discount in (0.05, 0.06) or l_linestatus == 'F')",
    )


@query("filter_in", f"SELECT * FROM {EVENTS_WITH_GAPS} WHERE event_type IN ('click', 'error')")
def _(spark, sf):
    return filters.filter_by_value(events_with_gaps(spark, sf, nan=False), "event_type", ["click", "error"])


@query(
    "filter_not_in",
    f"SELECT * FROM {EVENTS_WITH_GAPS} WHERE event_type IS NULL OR event_type NOT IN ('click', 'error')",
)
def _(spark, sf):
    return filters.filter_by_value(
        events_with_gaps(spark, sf, nan=False), "event_type", ["click", "error"], include=False
    )


@query("filter_range", f"SELECT * FROM {EVENTS_WITH_GAPS} WHERE value BETWEEN 10 AND 60")
def _(spark, sf):
    return filters.filter_by_range(events_with_gaps(spark, sf), "value", 10, 60)


@query(
    "filter_range_open",
    union_all(
        [
            "SELECT 'left' AS kind, event_id FROM events WHERE user_id >= 10 AND user_id < 100",
            "SELECT 'right' AS kind, event_id FROM events WHERE user_id > 10 AND user_id <= 100",
            "SELECT 'neither' AS kind, event_id FROM events WHERE user_id > 10 AND user_id < 100",
            f"SELECT 'lower' AS kind, event_id FROM {EVENTS_WITH_GAPS} WHERE value >= 40",
        ]
    ),
)
def _(spark, sf):
    events = table(spark, sf, "events")
    parts = [
        filters.filter_by_range(events, "user_id", 10, 100, kind).select(F.lit(kind).alias("kind"), "event_id")
        for kind in ("left", "right", "neither")
    ]
    lower = filters.filter_by_range(events_with_gaps(spark, sf), "value", min_value=40)
    return aggregate.union_by_name(*parts, lower.select(F.lit("lower").alias("kind"), "event_id"))


@query(
    "filter_conditions_and",
    f"""SELECT event_id, event_type, value FROM {EVENTS_WITH_GAPS}
        WHERE value > 20 AND (event_type IS NULL OR event_type <> 'view')""",
)
def _(spark, sf):
    out = filters.filter_data(
        events_with_gaps(spark, sf, nan=False),
        [lambda d: F.col("value") > 20, lambda d: filters.differs(d, "event_type", "view")],
    )
    return out.select("event_id", "event_type", "value")


@query(
    "filter_conditions_or",
    f"SELECT event_id, event_type, value FROM {EVENTS_WITH_GAPS} WHERE value > 50 OR event_type = 'error'",
)
def _(spark, sf):
    out = filters.filter_data(
        events_with_gaps(spark, sf, nan=False),
        [lambda d: F.col("value") > 50, lambda d: F.col("event_type") == "error"],
        combine="or",
    )
    return out.select("event_id", "event_type", "value")


@query("search_regex", "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?i)(the|être)[a-zé]*tion')")
def _(spark, sf):
    return filters.search_text(table(spark, sf, "documents"), "text", "(the|être)[a-zé]*tion").select("doc_id", "lang")


@query("search_literal", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'tion.')")
def _(spark, sf):
    return filters.search_text(table(spark, sf, "documents"), "text", "TION.", regex=False).select("doc_id", "lang")


@query(
    "search_numbers",
    "SELECT o_orderkey FROM orders WHERE contains(CAST(o_orderkey AS VARCHAR), '77')",
)
def _(spark, sf):
    return filters.search_text(table(spark, sf, "orders"), "o_orderkey", "77").select("o_orderkey")


@query(
    "filter_builder",
    union_all(
        [
            "SELECT 'equals' AS test, c_custkey FROM customer WHERE c_nationkey = 7",
            "SELECT 'equals_text' AS test, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
            "SELECT 'contains' AS test, c_custkey FROM customer WHERE contains(c_name, '00000000')",
            "SELECT 'greater' AS test, c_custkey FROM customer WHERE c_acctbal > 5000",
            "SELECT 'less' AS test, c_custkey FROM customer WHERE c_acctbal < 100.5",
            "SELECT 'between' AS test, c_custkey FROM customer WHERE c_acctbal BETWEEN 100 AND 200",
        ]
    ),
)
def _(spark, sf):
    df = table(spark, sf, "customer")
    tests = [
        ("equals", "c_nationkey", "equals", "7", None),
        ("equals_text", "c_mktsegment", "equals", "BUILDING", None),
        ("contains", "c_name", "contains", "00000000", None),
        ("greater", "c_acctbal", "greater", "5000", None),
        ("less", "c_acctbal", "less", "100.5", None),
        ("between", "c_acctbal", "between", "100", "200"),
    ]
    return aggregate.union_by_name(
        *[
            df.where(filters.filter_condition(df, c, op, a, b)).select(F.lit(name).alias("test"), "c_custkey")
            for name, c, op, a, b in tests
        ]
    )


@query(
    "sort_values",
    f"""SELECT event_type, value, event_id FROM {EVENTS_WITH_GAPS}
        ORDER BY event_type DESC NULLS LAST, value ASC NULLS LAST, event_id""",
)
def _(spark, sf):
    out = sorting.sort_values(
        events_with_gaps(spark, sf, nan=False), ["event_type", "value", "event_id"], [False, True, True]
    )
    return out.select("event_type", "value", "event_id")


@query("preview", "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5")
def _(spark, sf):
    return sorting.preview(table(spark, sf, "orders"), 5, ["o_totalprice", "o_orderkey"])


@query(
    "line_series",
    f"SELECT ts, value, event_type FROM {EVENTS_WITH_GAPS} WHERE value IS NOT NULL AND event_type IS NOT NULL",
)
def _(spark, sf):
    return sorting.line_series(events_with_gaps(spark, sf), "ts", "value", "event_type")


@query(
    "group_agg",
    f"""SELECT event_type, coalesce(sum(user_id), 0)::BIGINT AS user_id_sum, count(DISTINCT user_id) AS user_id_nunique,
               {sig_sql('avg(value)')} AS value_mean, {sig_sql('quantile_cont(value, 0.5)')} AS value_median,
               min(value) AS value_min, max(value) AS value_max, count(value) AS value_count,
               {sig_sql('stddev_samp(value)')} AS value_std, {sig_sql('var_samp(value)')} AS value_var,
               arg_min(value, event_id) AS value_first, arg_max(value, event_id) AS value_last
        FROM {EVENTS_WITH_GAPS} WHERE event_type IS NOT NULL GROUP BY event_type""",
)
def _(spark, sf):
    out = aggregate.group_and_aggregate(
        events_with_gaps(spark, sf),
        ["event_type", "no_such_column"],
        {
            "user_id": ["sum", "nunique"],
            "value": ["mean", "median", "min", "max", "count", "std", "var", "first", "last"],
            "no_such_column": "sum",
        },
        order_by="event_id",
    )
    inexact = {"value_mean", "value_median", "value_std", "value_var"}
    return out.select([sig(c).alias(c) if c in inexact else F.col(c) for c in out.columns])


_STATS = {
    "count": "count({c})",
    "mean": sig_sql("avg({c})"),
    "median": sig_sql("quantile_cont({c}, 0.5)"),
    "std": sig_sql("stddev_samp({c})"),
    "min": "min({c})",
    "max": "max({c})",
}


def _stats_sql(columns: list[str]) -> str:
    return ", ".join(f"{sql.format(c=c)} AS {c}_{name}" for c in columns for name, sql in _STATS.items())


def _inexact(df):
    return df.select(
        [sig(c).alias(c) if c.endswith(("_mean", "_median", "_std")) else F.col(c) for c in df.columns]
    )


@query(
    "group_analysis",
    f"""SELECT l_returnflag, l_linestatus, {_stats_sql(LINEITEM_NUMBERS)}
        FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    return _inexact(
        aggregate.group_analysis(df, ["l_returnflag", "l_linestatus"], LINEITEM_NUMBERS)
    )


@query(
    "auto_group",
    f"""SELECT o_orderpriority, {_stats_sql(['o_orderkey', 'o_custkey', 'o_totalprice'])}
        FROM orders GROUP BY o_orderpriority""",
)
def _(spark, sf):
    return _inexact(aggregate.auto_group(table(spark, sf, "orders")))


_FLAGS = ["A", "N", "R"]


@query(
    "pivot_mean",
    f"""SELECT l_shipmonth, {', '.join(f"{sig_sql(f"avg(CASE WHEN l_returnflag = '{v}' THEN l_quantity END)")} AS {v}" for v in _FLAGS)}
        FROM (SELECT *, month(l_shipdate)::INTEGER AS l_shipmonth FROM lineitem) GROUP BY l_shipmonth""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("l_shipmonth", F.month("l_shipdate"))
    out = aggregate.pivot_table(df, "l_shipmonth", "l_returnflag", "l_quantity")
    return out.select("l_shipmonth", *[sig(c).alias(c) for c in out.columns if c != "l_shipmonth"])


@query(
    "pivot_multi",
    "SELECT l_linestatus, "
    + ", ".join(
        f"sum(CASE WHEN l_returnflag = '{v}' THEN l_quantity END) AS \"{v}_l_quantity_sum\", "
        f"max(CASE WHEN l_returnflag = '{v}' THEN l_quantity END) AS \"{v}_l_quantity_max\", "
        + sig_sql(f"quantile_cont(CASE WHEN l_returnflag = '{v}' THEN l_discount END, 0.5)")
        + f' AS "{v}_l_discount_median"'
        for v in _FLAGS
    )
    + " FROM lineitem GROUP BY l_linestatus",
)
def _(spark, sf):
    out = aggregate.pivot_table(
        table(spark, sf, "lineitem"),
        "l_linestatus",
        "l_returnflag",
        aggfunc={"l_quantity": ["sum", "max"], "l_discount": "median"},
    )
    return out.select([sig(c).alias(c) if c.endswith("median") else F.col(c) for c in out.columns])


@query(
    "pivot_colliding_labels",
    """SELECT o_orderstatus,
              count(CASE WHEN o_custkey % 2 = 0 THEN 1 END) AS "x\\_y_z", count(CASE WHEN o_custkey % 2 = 1 THEN 1 END) AS "x_y\\_z"
       FROM orders GROUP BY o_orderstatus""",
)
def _(spark, sf):
    """Two pairs of values that read alike once joined."""
    even = F.col("o_custkey") % 2 == 0
    df = table(spark, sf, "orders").select(
        "o_orderstatus", "o_orderkey", F.when(even, "x_y").otherwise("x").alias("p"), F.when(even, "z").otherwise("y_z").alias("q")
    )
    return aggregate.pivot_table(df, "o_orderstatus", ["p", "q"], "o_orderkey", "count")


@query(
    "filter_builder_large_ids",
    """SELECT event_id, event_id + 9007199254740992 AS id FROM events
       WHERE event_id + 9007199254740992 = 9007199254740993 OR event_id + 9007199254740992 > 9007199254741500""",
)
def _(spark, sf):
    """Ids that only differ beyond the digits of a double."""
    df = table(spark, sf, "events").select("event_id", (F.col("event_id") + F.lit(2**53)).alias("id"))
    one = filters.filter_condition(df, "id", "equals", "9007199254740993")
    rest = filters.filter_condition(df, "id", "greater", "9007199254741500")
    return df.where(one | rest)


@query("union_by_name", union_all(["SELECT c_name AS name, c_acctbal AS acctbal FROM customer", "SELECT s_name AS name, s_acctbal AS acctbal FROM supplier"]))
def _(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_acctbal").alias("acctbal"), F.col("c_name").alias("name"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return aggregate.union_by_name(customers, suppliers)


@query(
    "value_counts",
    "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY p_brand ORDER BY count DESC, value LIMIT 12",
)
def _(spark, sf):
    return aggregate.value_counts(table(spark, sf, "part"), "p_brand", 12)


@query(
    "top_n_others",
    """WITH c AS (SELECT p_brand AS value, count(*) AS count FROM part GROUP BY p_brand),
            r AS (SELECT *, row_number() OVER (ORDER BY count DESC, value) AS rk FROM c)
       SELECT CASE WHEN rk <= 5 THEN value ELSE 'Others' END AS value, sum(count)::BIGINT AS count,
              round(sum(count) / (SELECT sum(count) FROM c) * 100, 1) AS percent
       FROM r GROUP BY 1""",
)
def _(spark, sf):
    return aggregate.top_n_with_others(table(spark, sf, "part"), "p_brand", 5)


@query(
    "sql_query",
    f"""SELECT event_type, count(*) AS n, {sig_sql('avg(value)')} AS mean_value FROM events
        WHERE user_id < 100 GROUP BY event_type HAVING count(*) > 10""",
)
def _(spark, sf):
    out = execute_sql(
        table(spark, sf, "events"),
        """SELECT event_type, count(*) AS n, avg(value) AS mean_value FROM df
           WHERE user_id < 100 GROUP BY event_type HAVING count(*) > 10""",
    )
    return out.withColumn("mean_value", sig("mean_value"))


_JOIN = """SELECT n.n_name, c.c_mktsegment, count(*) AS orders, {total} AS total
           FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
           WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)
           GROUP BY n.n_name, c.c_mktsegment"""


@query(
    "sql_join",
    _JOIN.format(total=fix_sql("sum(o.o_totalprice)", 2), orders="orders", customer="customer", nation="nation", lineitem="lineitem"),
)
def _(spark, sf):
    out = execute_sql(
        table(spark, sf, "orders"),
        _JOIN.format(total="sum(o.o_totalprice)", orders="df", customer="customer", nation="nation", lineitem="lineitem"),
        customer=table(spark, sf, "customer"),
        nation=table(spark, sf, "nation"),
        lineitem=table(spark, sf, "lineitem"),
    )
    return out.withColumn("total", fix("total", 2))


_WINDOW = """SELECT user_id, event_id, value,
                    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth,
                    lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before,
                    max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent_max
             FROM {events}"""


@query("sql_window", _WINDOW.format(events="events"))
def _(spark, sf):
    return execute_sql(table(spark, sf, "events"), _WINDOW.format(events="df")).withColumn("nth", F.col("nth").cast("bigint"))


_SETS = """SELECT 'both' AS kind, k FROM (SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'O')
           UNION ALL SELECT 'none' AS kind, k FROM (SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders})"""


@query("sql_setop", _SETS.format(orders="orders", customer="customer"))
def _(spark, sf):
    return execute_sql(
        table(spark, sf, "orders"),
        _SETS.format(orders="df", customer="customer"),
        customer=table(spark, sf, "customer"),
    )


_ROLLUP = """SELECT {flag} AS flag, {status} AS status, count(*) AS n, sum(l_quantity) AS quantity
             FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)"""


@query("sql_rollup", _ROLLUP.format(flag="l_returnflag", status="l_linestatus", lineitem="lineitem"))
def _(spark, sf):
    return execute_sql(
        table(spark, sf, "lineitem"), _ROLLUP.format(flag="l_returnflag", status="l_linestatus", lineitem="df")
    )


@query(
    "apply_rows",
    """SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit_price,
              CASE WHEN l_quantity >= 25 THEN 'bulk' ELSE 'single' END AS size
       FROM lineitem""",
)
def _(spark, sf):
    def unit(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "l_orderkey": frame["l_orderkey"],
                "l_linenumber": frame["l_linenumber"],
                "unit_price": frame["l_extendedprice"] / frame["l_quantity"],
                "size": (frame["l_quantity"] >= 25).map({True: "bulk", False: "single"}),
            }
        )

    return udf.apply_rows(
        table(spark, sf, "lineitem"),
        unit,
        "l_orderkey bigint, l_linenumber int, unit_price double, size string",
        ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"],
    )


@query(
    "apply_columns",
    "SELECT max(l_quantity) AS l_quantity, max(l_discount) AS l_discount, max(l_tax) AS l_tax FROM lineitem",
)
def _(spark, sf):
    return udf.apply_columns(table(spark, sf, "lineitem"), F.max, ["l_quantity", "l_discount", "l_tax"])


@query(
    "apply_columns_rows",
    "SELECT round(l_extendedprice / 100) AS l_extendedprice, round(l_quantity / 100) AS l_quantity FROM lineitem",
)
def _(spark, sf):
    return udf.apply_columns(
        table(spark, sf, "lineitem"), lambda c: F.round(c / 100), ["l_extendedprice", "l_quantity"]
    )


def _rms_and_span(spark, sf, key):
    def partial(rows: pd.DataFrame) -> dict:
        v = rows["value"].dropna()
        return {"n": len(v), "squares": float((v * v).sum()), "lo": v.min(), "hi": v.max()}

    def merge(states: pd.DataFrame) -> dict:
        return {
            "n": int(states["n"].sum()),
            "squares": float(states["squares"].sum()),
            "lo": states["lo"].min(),
            "hi": states["hi"].max(),
        }

    def finish(states: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"rms": (states["squares"] / states["n"]) ** 0.5, "span": states["hi"] - states["lo"]})

    out = udf.merge_aggregate(
        events_with_gaps(spark, sf),
        [key],
        ["value"],
        partial,
        "n bigint, squares double, lo double, hi double",
        merge,
        finish,
        "rms double, span double",
    )
    return out.withColumn("rms", sig("rms"))


def _rms_sql(key: str) -> str:
    return f"""SELECT {key}, {sig_sql('sqrt(avg(value * value))')} AS rms, max(value) - min(value) AS span
               FROM {EVENTS_WITH_GAPS} WHERE {key} IS NOT NULL GROUP BY {key}"""


@query("udaf_group", _rms_sql("event_type"))
def _(spark, sf):
    return _rms_and_span(spark, sf, "event_type")


@query("udaf_user", _rms_sql("user_id"))
def _(spark, sf):
    """Many groups of few rows each."""
    return _rms_and_span(spark, sf, "user_id")

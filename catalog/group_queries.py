"""Group tests, cross tables, missing patterns: what goes beyond describing single columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from pyspark.sql import functions as F

from tallyframe.plans import duplicates, group_tests, missing_patterns, network

from .analysis import LINEITEM_NUMBERS, WIDE_COLUMNS, pearson_one_scan_sql, wide_gappy, wide_gappy_sql
from .registry import EVENTS_WITH_GAPS, ORDERS_WITH_GAPS, events_with_gaps, fix, fix_sql, orders_with_gaps, query, sig, sig_sql, table, union_all


def _f_tail_sql(f: str, df1: str, df2: str) -> str:
    """One less the incomplete beta series in x = df1 f / (df2 + df1 f), whose terms fall from about df1 f / 2 on."""
    x, a, b = f"({df1} * {f} / ({df2} + {df1} * {f}))", f"({df1} / 2)", f"({df2} / 2)"
    term = f"exp(lgamma({a} + {b} + n) - lgamma({b}) - lgamma({a} + n + 1) + ({a} + n) * ln({x}) + {b} * ln(1 - {x}))"
    return f"greatest(0.0, 1 - (SELECT sum({term}) FROM range(4000) r(n)))"


def _chi_tail_sql(x: str, df: str) -> str:
    term = f"exp(({df} / 2 + n) * ln({x} / 2) - {x} / 2 - lgamma({df} / 2 + n + 1))"
    return f"greatest(0.0, 1 - (SELECT sum({term}) FROM range(4000) r(n)))"


def _group_tests_sql(source: str, by: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        base = f"""WITH v AS (SELECT {by} AS g, {c}::DOUBLE AS x FROM {source} WHERE {by} IS NOT NULL AND {c} IS NOT NULL),
             s AS (SELECT g, count(*)::DOUBLE AS n, avg(x) AS m, var_samp(x) AS var, count(*) / var_samp(x) AS w FROM v GROUP BY g),
             t AS (SELECT count(*)::DOUBLE AS k, sum(n) AS n, sum(w) AS w, sum(w * m) / sum(w) AS wm, sum(n * m) / sum(n) AS m FROM s)"""
        anova = f"""{base}, f AS (SELECT t.k, t.n, (SELECT sum(n * (s.m - t.m) ** 2) FROM s) / (t.k - 1) / ((SELECT sum((n - 1) * var) FROM s) / (t.n - t.k)) AS f,
                               t.k - 1 AS df1, t.n - t.k AS df2 FROM t)
             SELECT '{c}' AS "column", 'anova' AS test, k::BIGINT AS groups, n::BIGINT AS n, f, df1, df2, {_f_tail_sql("f", "df1", "df2")} AS p FROM f"""
        welch = f"""{base}, l AS (SELECT sum((1 - s.w / t.w) ** 2 / (s.n - 1)) AS lack, sum(s.w * (s.m - t.wm) ** 2) AS a FROM s, t),
             f AS (SELECT k, n, a / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * lack) AS f, k - 1 AS df1, (k * k - 1) / (3 * lack) AS df2 FROM t, l)
             SELECT '{c}' AS "column", 'welch' AS test, k::BIGINT AS groups, n::BIGINT AS n, f, df1, df2, {_f_tail_sql("f", "df1", "df2")} AS p FROM f"""
        kruskal = f"""{base}, r AS (SELECT g, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM v),
             h AS (SELECT k, n, (12 / (n * (n + 1)) * (SELECT sum(rr) FROM (SELECT sum(r) ** 2 / count(*) AS rr FROM r GROUP BY g)) - 3 * (n + 1))
                          / (1 - (SELECT sum(c ** 3 - c) FROM (SELECT count(*)::DOUBLE AS c FROM v GROUP BY x)) / (n ** 3 - n)) AS f, k - 1 AS df1 FROM t)
             SELECT '{c}' AS "column", 'kruskal' AS test, k::BIGINT AS groups, n::BIGINT AS n, f, df1, NULL::DOUBLE AS df2, {_chi_tail_sql("f", "df1")} AS p FROM h"""
        parts += [f"SELECT * FROM ({q})" for q in (anova, welch, kruskal)]
    return f"""SELECT "column", test, groups, n, {sig_sql("f")} AS statistic, df1, {sig_sql("df2")} AS df2, {fix_sql("p", 5)} AS p_value
               FROM ({union_all(parts)})"""


@query("group_tests", _group_tests_sql("lineitem", "l_returnflag", LINEITEM_NUMBERS))
def _(spark, sf):
    out = group_tests.group_tests(table(spark, sf, "lineitem"), "l_returnflag", LINEITEM_NUMBERS)
    return out.withColumns({"statistic": sig("statistic"), "df2": sig("df2"), "p_value": fix("p_value", 5)})


@query(
    "crosstab",
    f"""WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY ALL),
             m AS (SELECT *, sum(n) OVER (PARTITION BY o_orderpriority) AS r, sum(n) OVER (PARTITION BY o_orderstatus) AS k, sum(n) OVER () AS t FROM c)
        SELECT o_orderpriority, o_orderstatus, n, r::BIGINT AS row_total, k::BIGINT AS column_total, t::BIGINT AS total,
               {fix_sql("r::DOUBLE * k / t")} AS expected, {fix_sql("(n - r::DOUBLE * k / t) / sqrt(r::DOUBLE * k / t)")} AS residual FROM m""",
)
def _(spark, sf):
    out = group_tests.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")
    return out.withColumns({"expected": fix("expected"), "residual": fix("residual")})


@query(
    "chi_square",
    f"""WITH c AS (SELECT lang, source, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL),
             a AS (SELECT lang, sum(n)::DOUBLE AS r FROM c GROUP BY lang), b AS (SELECT source, sum(n)::DOUBLE AS k FROM c GROUP BY source),
             x AS (SELECT sum((coalesce(n, 0) - r * k / t) ** 2 / (r * k / t)) AS x, any_value(t) AS t
                   FROM a CROSS JOIN b LEFT JOIN c USING (lang, source) CROSS JOIN (SELECT sum(n)::DOUBLE AS t FROM c)),
             s AS (SELECT x, t, (SELECT count(*)::DOUBLE FROM a) AS r, (SELECT count(*)::DOUBLE FROM b) AS k FROM x),
             d AS (SELECT *, (r - 1) * (k - 1) AS df FROM s)
        SELECT 'lang' AS column_a, 'source' AS column_b, t::BIGINT AS n, {sig_sql("x")} AS statistic, df,
               {fix_sql(_chi_tail_sql("x", "df"), 5)} AS p_value, {fix_sql("sqrt(x / t / (least(r, k) - 1))")} AS cramers_v FROM d""",
)
def _(spark, sf):
    out = group_tests.chi_square(table(spark, sf, "documents"), "lang", "source")
    return out.withColumns({"statistic": sig("statistic"), "p_value": fix("p_value", 5), "cramers_v": fix("cramers_v")})


_GAP_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"]
_GAP_MASK = " + ".join(f"{1 << i} * ({c} IS NULL)::INT" for i, c in enumerate(_GAP_COLUMNS))
_GAP_NAMES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN s & {1 << i} > 0 THEN '{c}' END" for i, c in enumerate(_GAP_COLUMNS)) + "], lambda x: x IS NOT NULL), ',')"


def _listed(out):
    return out.withColumn("columns", F.array_join("columns", ","))


@query(
    "missing_patterns",
    f"""WITH m AS (SELECT {_GAP_MASK} AS s, count(*) AS n FROM {ORDERS_WITH_GAPS} GROUP BY 1)
        SELECT {_GAP_NAMES} AS columns, bit_count(s)::BIGINT AS missing_columns, n AS rows, round(100.0 * n / sum(n) OVER (), 2) AS pct FROM m""",
)
def _(spark, sf):
    return _listed(missing_patterns.missing_patterns(orders_with_gaps(spark, sf)))


@query(
    "missing_together",
    f"""WITH m AS (SELECT {_GAP_MASK} AS b FROM {ORDERS_WITH_GAPS}),
             c AS (SELECT s, count(*) AS n FROM range(1, {1 << len(_GAP_COLUMNS)}) r(s), m WHERE b & s = s GROUP BY s)
        SELECT {_GAP_NAMES} AS columns, bit_count(s)::BIGINT AS missing_columns, n AS rows, round(100.0 * n / (SELECT count(*) FROM m), 2) AS pct
        FROM c WHERE n >= 0.05 * (SELECT count(*) FROM m) AND NOT EXISTS (SELECT 1 FROM c AS t WHERE t.s & c.s = c.s AND t.s <> c.s AND t.n = c.n)""",
)
def _(spark, sf):
    """Every subset of columns in SQL, none here."""
    return _listed(missing_patterns.missing_together(orders_with_gaps(spark, sf), min_share=0.05))


# A link is in the forest exactly if no path of stronger links joins its ends.
@query(
    "corr_network",
    f"""WITH RECURSIVE m AS MATERIALIZED ({pearson_one_scan_sql(wide_gappy_sql(), WIDE_COLUMNS)}),
             e AS MATERIALIZED (SELECT col_a, col_b, r, row_number() OVER (ORDER BY abs(r) DESC, least(col_a, col_b) DESC, greatest(col_a, col_b) DESC) AS place
                                FROM m WHERE abs(r) >= 0.3 AND list_position({WIDE_COLUMNS}, col_a) < list_position({WIDE_COLUMNS}, col_b)),
             w AS MATERIALIZED (SELECT place, col_a AS x, col_b AS y FROM e UNION ALL SELECT place, col_b, col_a FROM e),
             reach(place, node) AS (SELECT place, col_a FROM e UNION SELECT reach.place, w.y FROM reach JOIN w ON w.x = reach.node AND w.place < reach.place),
             near(start, node) AS (SELECT x, x FROM w UNION SELECT near.start, w.y FROM near JOIN w ON w.x = near.node)
        SELECT col_a, col_b, r, NOT EXISTS (SELECT 1 FROM reach WHERE reach.place = e.place AND reach.node = e.col_b) AS in_forest,
               (SELECT min(node) FROM near WHERE start = e.col_a) AS component FROM e""",
)
def _(spark, sf):
    return network.correlation_network(wide_gappy(spark, sf), threshold=0.3, digits=6).withColumn("r", fix("r"))


@query(
    "duplicate_rows",
    """SELECT doc_id, representative, copies
       FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text, lang) AS representative, count(*) OVER (PARTITION BY text, lang) AS copies FROM documents)
       WHERE copies > 1""",
)
def _(spark, sf):
    return duplicates.duplicate_rows(table(spark, sf, "documents"), "doc_id", ["text", "lang"])


@query("duplicate_rows_missing", "SELECT count(*) AS rows FROM (SELECT DISTINCT event_type, value FROM (SELECT event_type, value FROM " + EVENTS_WITH_GAPS + "))")
def _(spark, sf):
    """Missing values are equal, NaN too."""
    return duplicates.without_duplicates(events_with_gaps(spark, sf).select("event_type", "value")).agg(F.count(F.lit(1)).alias("rows"))

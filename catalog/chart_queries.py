"""The tables behind charts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tallyframe.plans import charts

from .registry import EVENTS_WITH_GAPS, events_with_gaps, fix, fix_sql, query, sig, sig_sql, table, union_all


def bin_sql(c: str, source: str, bins: int) -> str:
    """Zero-based bin of a value between the smallest and largest of its column."""
    lo, hi = f"(SELECT min({c})::DOUBLE FROM {source})", f"(SELECT max({c})::DOUBLE FROM {source})"
    edge = f"({lo} + {{i}} * (({hi} - {lo}) / {bins}))"
    guess = f"least(floor(({c} - {lo}) / ({hi} - {lo}) * {bins}), {bins - 1})"
    below, above = edge.format(i=guess), edge.format(i=f"({guess} + 1)")
    return f"""(CASE WHEN {c} < {below} THEN {guess} - 1
                     WHEN {guess} < {bins - 1} AND {c} >= {above} THEN {guess} + 1 ELSE {guess} END)::INTEGER"""


@query(
    "density",
    f"""WITH v AS (SELECT value AS v FROM {EVENTS_WITH_GAPS} WHERE value IS NOT NULL),
            f AS (SELECT count(*) AS n, min(v) AS mn, max(v) AS mx, stddev_samp(v) * power(count(*), -0.2) AS w FROM v),
            s AS (SELECT v, mn, mx, (mx - mn) / 1000 AS st, least(floor((v - mn) / (mx - mn) * 1000), 999) AS g FROM v, f),
            b AS (SELECT CASE WHEN v < mn + g * st THEN g - 1 WHEN g < 999 AND v >= mn + (g + 1) * st THEN g + 1 ELSE g END AS bin, count(*) AS c
                  FROM s GROUP BY 1),
            m AS (SELECT (mn + bin * ((mx - mn) / 1000) + CASE WHEN bin = 999 THEN mx ELSE mn + (bin + 1) * ((mx - mn) / 1000) END) / 2 AS mid, c FROM b, f),
            g AS (SELECT mn - 3 * w + i * (mx - mn + 6 * w) / 199 AS x FROM f, (SELECT unnest(range(200)) AS i))
       SELECT {fix_sql('x')} AS x, {fix_sql('sum(exp(-power((x - mid) / w, 2) / 2) * c) / any_value(n * w * sqrt(2 * pi()))')} AS density
       FROM g, m, f GROUP BY x""",
)
def _(spark, sf):
    out = charts.density(events_with_gaps(spark, sf), "value")
    return out.select(fix("x").alias("x"), fix("density").alias("density"))


@query("histogram_discrete", "SELECT (row_number() OVER (ORDER BY l_linenumber) - 1)::INTEGER AS bin, l_linenumber::DOUBLE AS lo, l_linenumber::DOUBLE AS hi, count(*) AS count FROM lineitem GROUP BY l_linenumber")
def _(spark, sf):
    return charts.fitted_histogram(table(spark, sf, "lineitem"), "l_linenumber")


@query(
    "bar_counts",
    "SELECT c_mktsegment AS value, count(*) AS count FROM customer GROUP BY 1 ORDER BY count DESC, value LIMIT 10",
)
def _(spark, sf):
    return charts.bar_counts(table(spark, sf, "customer"), "c_mktsegment")


@query(
    "pie_shares",
    """SELECT event_type AS value, count(*) AS count, round(count(*) / (SELECT count(*) FROM events) * 100, 1) AS percent
       FROM events GROUP BY event_type""",
)
def _(spark, sf):
    return charts.pie_shares(table(spark, sf, "events"), "event_type")


@query(
    "scatter_points",
    f"SELECT user_id, value, event_type FROM {EVENTS_WITH_GAPS} WHERE value IS NOT NULL AND event_type IS NOT NULL",
)
def _(spark, sf):
    return charts.scatter_points(events_with_gaps(spark, sf), "user_id", "value", "event_type")


_PLOTTED = f"(SELECT * FROM {EVENTS_WITH_GAPS} WHERE value IS NOT NULL AND event_type IS NOT NULL)"


@query(
    "scatter_grid",
    f"""SELECT {bin_sql('user_id', _PLOTTED, 50)} AS gx, {bin_sql('value', _PLOTTED, 50)} AS gy, event_type AS hue, count(*) AS count
        FROM {_PLOTTED} GROUP BY ALL""",
)
def _(spark, sf):
    return charts.scatter_grid(events_with_gaps(spark, sf), "user_id", "value", "event_type")


_PAIRED = f"(SELECT * FROM {EVENTS_WITH_GAPS} WHERE value IS NOT NULL)"


@query(
    "pair_grid",
    union_all(
        [
            f"""SELECT '{a}' AS col_x, '{b}' AS col_y, {bin_sql(a, _PAIRED, 20)} AS gx, {bin_sql(b, _PAIRED, 20)} AS gy, count(*) AS count
                FROM {_PAIRED} GROUP BY ALL"""
            for a, b in combinations(["event_id", "user_id", "value"], 2)
        ]
        + [
            f"SELECT '{c}' AS col_x, '{c}' AS col_y, {bin_sql(c, _PAIRED, 20)} AS gx, 0 AS gy, count(*) AS count FROM {_PAIRED} GROUP BY ALL"
            for c in ("event_id", "user_id", "value")
        ]
    ),
)
def _(spark, sf):
    return charts.pair_grid(events_with_gaps(spark, sf), max_cols=5)


def _box_sql(by: str | None) -> str:
    source = f"(SELECT * FROM {EVENTS_WITH_GAPS} WHERE value IS NOT NULL{f' AND {by} IS NOT NULL' if by else ''})"
    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    join = f"JOIN q USING ({by})" if by else ", q"
    return f"""WITH q AS (SELECT {key}quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
                          FROM {source}{group}),
                    v AS (SELECT {key}value, q1, median, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
                          FROM {source} s {join})
               SELECT {key}{sig_sql('q1')} AS q1, {sig_sql('median')} AS median, {sig_sql('q3')} AS q3,
                      min(value) FILTER (inside) AS whisker_low, max(value) FILTER (inside) AS whisker_high,
                      count(*) FILTER (NOT inside) AS outliers, count(*) AS count
               FROM v GROUP BY {key}v.q1, v.median, v.q3"""


@query("box_stats", _box_sql("event_type"))
def _(spark, sf):
    out = charts.box_stats(events_with_gaps(spark, sf), "value", "event_type")
    return out.withColumns({c: sig(c) for c in ("q1", "median", "q3")})


@query("box_stats_whole", _box_sql(None))
def _(spark, sf):
    out = charts.box_stats(events_with_gaps(spark, sf), "value")
    return out.withColumns({c: sig(c) for c in ("q1", "median", "q3")})


@query(
    "box_outliers",
    f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {_PLOTTED} GROUP BY event_type)
        SELECT event_type, value FROM {_PLOTTED} JOIN q USING (event_type)
        WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
)
def _(spark, sf):
    return charts.box_outliers(events_with_gaps(spark, sf), "value", "event_type")


def bundle_sql(source: str, numbers: list[str], texts: list[str], few: list[str]) -> str:
    """Every chart of the bundle from its own statement; ``source`` has no gaps, so the missing chart is empty. ``few``: texts of at most ten values."""
    rows = lambda chart, kind, series, label, x, y, value, rest: (
        f"SELECT {chart} AS chart_id, '{kind}' AS kind, {series} AS series, {label} AS label, {x} AS x, {y} AS y, {value}::DOUBLE AS value {rest}"
    )
    none = "NULL"
    parts = []
    for c in numbers:
        edges = f"(SELECT min({c})::DOUBLE AS mn, max({c})::DOUBLE AS mx FROM {source}), range(20) t(i)"
        lo, hi = "mn + i * ((mx - mn) / 20)", "CASE WHEN i = 19 THEN mx ELSE mn + (i + 1) * ((mx - mn) / 20) END"
        count = f"(SELECT count(*) FROM {source} WHERE {c} >= {lo} AND ({c} < {hi} OR i = 19 AND {c} <= mx))"
        parts.append(rows(f"'hist_{c}'", "histogram", f"'{c}'", "i::VARCHAR", fix_sql(lo), fix_sql(hi), count, f"FROM {edges}"))
    for c in texts:
        counted = f"(SELECT {c} AS v, count(*) AS n FROM {source} GROUP BY 1 ORDER BY n DESC, v LIMIT 10)"
        parts.append(rows(f"'bar_{c}'", "bar", none, "v", none, none, "n", f"FROM {counted}"))
        if c not in few:
            continue
        parts.append(rows(f"'pie_{c}'", "pie", none, "v", none, none, f"round(n / (SELECT count(*) FROM {source}) * 100, 1)", f"FROM {counted}"))
        for n in numbers[:2]:
            box = f"""(SELECT {c} AS k, unnest(['q1', 'median', 'q3', 'whisker_low', 'whisker_high']) AS stat,
                              unnest([q1, median, q3, min(v) FILTER (inside), max(v) FILTER (inside)]) AS v
                       FROM (SELECT {c}, {n}::DOUBLE AS v, q1, median, q3, {n} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
                             FROM {source} JOIN (SELECT {c}, quantile_cont({n}, 0.25) AS q1, quantile_cont({n}, 0.5) AS median, quantile_cont({n}, 0.75) AS q3
                                                 FROM {source} GROUP BY {c}) USING ({c}))
                       GROUP BY {c}, q1, median, q3)"""
            parts.append(rows(f"'box_{n}_by_{c}'", "box", "k", "stat", none, none, "v", f"FROM {box}"))
    for i, a in enumerate(numbers):
        for b in numbers[:i]:
            parts.append(rows("'correlation'", "heatmap", f"'{a}'", f"'{b}'", none, none, f"corr({a}, {b})", f"FROM {source}"))
    for a, b in list(zip(numbers, numbers[1:], strict=False))[:2]:
        grid = f"(SELECT {bin_sql(a, source, 50)} AS gx, {bin_sql(b, source, 50)} AS gy, count(*) AS n FROM {source} GROUP BY ALL)"
        parts.append(rows(f"'scatter_{a}_{b}'", "scatter", none, none, "gx::DOUBLE", "gy::DOUBLE", "n", f"FROM {grid}"))
    return f"SELECT chart_id, kind, series, label, x, y, {fix_sql('value')} AS value FROM ({union_all(parts)})"


@query("chart_bundle", bundle_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"], ["o_orderstatus", "o_orderpriority"]))
def _(spark, sf):
    out = charts.chart_bundle(table(spark, sf, "orders"))
    return out.withColumns({"x": fix("x"), "y": fix("y"), "value": fix("value")})


@query(
    "missing_chart",
    f"""SELECT * FROM (
          SELECT 'event_type' AS "column", count(*) - count(event_type) AS missing_count, round((count(*) - count(event_type)) / count(*) * 100, 2) AS missing_percent FROM {EVENTS_WITH_GAPS}
          UNION ALL
          SELECT 'value' AS "column", count(*) - count(value) AS missing_count, round((count(*) - count(value)) / count(*) * 100, 2) AS missing_percent FROM {EVENTS_WITH_GAPS})""",
)
def _(spark, sf):
    return charts.missing_profile(events_with_gaps(spark, sf))


@query("bar_for_text_histogram", "SELECT p_type AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, value LIMIT 10")
def _(spark, sf):
    return charts.histogram(table(spark, sf, "part"), "p_type")


@query(
    "capped_histogram",
    union_all(
        [
            f"""SELECT '{c}' AS "column", b.bin::INTEGER AS bin, count(v.x) AS count
                FROM (SELECT unnest(range((SELECT least(10, count(DISTINCT {c})) FROM lineitem))) AS bin) b
                LEFT JOIN (SELECT least(floor(({c} - mn) / (mx - mn) * k), k - 1) AS x
                           FROM lineitem, (SELECT min({c}) AS mn, max({c}) AS mx, least(10, count(DISTINCT {c})) AS k FROM lineitem)) v ON v.x = b.bin
                GROUP BY b.bin"""
            for c in ("l_linenumber", "l_quantity")
        ]
    ),
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_linenumber", F.col("l_quantity").cast("int").alias("l_quantity"))
    return charts.capped_histogram(df).select("column", "bin", "count")

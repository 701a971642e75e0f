"""Profiles, correlations, resampling and reports."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tallyframe.operators import filters, outliers, sorting
from tallyframe.operators.aggregate import group_and_aggregate
from tallyframe.operators.timeseries import resample
from tallyframe.plans import charts, correlation, frequencies, profile, report, statistics
from tallyframe.plans.cleaning import default_clean
from tallyframe.plans.storage import scratch_path
from tallyframe.streaming import micro_batched_files, resample_stream

from .cleaning_queries import outlier_counts_sql
from .registry import EVENTS_WITH_GAPS, events_with_gaps, fix, fix_sql, query, sig, sig_sql, table, union_all

LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
EVENT_NUMBERS = ["event_id", "user_id", "value"]

# ---------------------------------------------------------------- flagship


@query(
    "flagship",
    f"""WITH r AS (SELECT * FROM events WHERE user_id BETWEEN 10 AND 100),
             b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM r),
             k AS (SELECT r.* FROM r, b WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
        SELECT event_type, count(value) AS value_count, {sig_sql('quantile_cont(value, 0.5)')} AS value_median
        FROM k GROUP BY event_type ORDER BY event_type""",
)
def flagship(spark, sf):
    """Range filter, outlier removal, grouped count and median, sort."""
    df = filters.filter_by_range(table(spark, sf, "events"), "user_id", 10, 100)
    df = outliers.handle_outliers(df, ["value"])
    out = group_and_aggregate(df, "event_type", {"value": ["count", "median"]}, sort=False)
    out = out.withColumn("value_median", sig("value_median"))
    return sorting.sort_values(out, ["event_type"])


# ---------------------------------------------------------------- profiles


def _profile_sql(source: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        quantiles = ", ".join(
            f"{sig_sql(f'quantile_cont({c}, {p})')} AS {name}"
            for name, p in (("median", 0.5), ("q10", 0.1), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q90", 0.9))
        )
        parts.append(
            f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing,
                       round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct,
                       {sig_sql(f'avg({c})')} AS mean, {sig_sql(f'stddev_samp({c})')} AS std, {sig_sql(f'var_samp({c})')} AS var,
                       min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, {sig_sql(f'max({c}) - min({c})')} AS range,
                       count(DISTINCT {c}) AS unique_values, {quantiles},
                       {fix_sql(f'skewness({c})')} AS skew, {fix_sql(f'kurtosis({c})')} AS kurtosis
                FROM {source}"""
        )
    return union_all(parts)


def _profile(df):
    out = statistics.numeric_profile(df)
    rounded = {"mean", "std", "var", "range", "median", "q10", "q25", "q50", "q75", "q90"}
    return out.select(
        [
            sig(c).alias(c) if c in rounded else fix(c).alias(c) if c in ("skew", "kurtosis") else F.col(c)
            for c in out.columns
        ]
    )


@query("numeric_profile", _profile_sql("lineitem", LINEITEM_NUMBERS))
def _(spark, sf):
    return _profile(table(spark, sf, "lineitem"))


@query("numeric_profile_gaps", _profile_sql(EVENTS_WITH_GAPS, EVENT_NUMBERS))
def _(spark, sf):
    return _profile(events_with_gaps(spark, sf))


@query(
    "describe",
    union_all(
        [
            f"""SELECT '{c}' AS "column", count({c}) AS count, {sig_sql(f'avg({c})')} AS mean, {sig_sql(f'stddev_samp({c})')} AS std,
                       min({c})::DOUBLE AS min, {sig_sql(f'quantile_cont({c}, 0.25)')} AS q25, {sig_sql(f'quantile_cont({c}, 0.5)')} AS q50,
                       {sig_sql(f'quantile_cont({c}, 0.75)')} AS q75, max({c})::DOUBLE AS max FROM orders"""
            for c in ("o_orderkey", "o_custkey", "o_totalprice")
        ]
    ),
)
def _(spark, sf):
    out = statistics.describe(table(spark, sf, "orders"))
    return out.select([sig(c).alias(c) if c in ("mean", "std", "q25", "q50", "q75") else F.col(c) for c in out.columns])


def _histogram_sql(source: str, columns: list[str], bins: int, tag: bool = True) -> str:
    """Bins by comparing with the edges themselves."""
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT {f"'{c}' AS " + '"column", ' if tag else ''}b.bin::INTEGER AS bin, {sig_sql('b.lo')} AS lo, {sig_sql('b.hi')} AS hi,
                       count(v.x) AS count
                FROM (SELECT i AS bin, mn + i * ((mx - mn) / {bins}) AS lo,
                             CASE WHEN i = {bins - 1} THEN mx ELSE mn + (i + 1) * ((mx - mn) / {bins}) END AS hi, mx
                      FROM (SELECT min({c})::DOUBLE AS mn, max({c})::DOUBLE AS mx FROM {source}), range({bins}) t(i)) b
                LEFT JOIN (SELECT {c}::DOUBLE AS x FROM {source} WHERE {c} IS NOT NULL) v
                  ON v.x >= b.lo AND (v.x < b.hi OR (b.bin = {bins - 1} AND v.x <= b.mx))
                GROUP BY b.bin, b.lo, b.hi"""
        )
    return union_all(parts)


@query("profile_histogram", _histogram_sql("lineitem", LINEITEM_NUMBERS, 10))
def _(spark, sf):
    out = charts.profile_histogram(table(spark, sf, "lineitem"))
    return out.withColumns({"lo": sig("lo"), "hi": sig("hi")})


@query("histogram", _histogram_sql(EVENTS_WITH_GAPS, ["value"], 20, tag=False))
def _(spark, sf):
    out = charts.histogram(events_with_gaps(spark, sf), "value")
    return out.withColumns({"lo": sig("lo"), "hi": sig("hi")})


def _categorical_sql(source: str, columns: list[str], top_n: int) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT '{c}' AS "column", t.n AS count, t.rows - t.n AS missing,
                       round((t.rows - t.n) / t.rows * 100, 2) AS missing_pct, t.d AS unique_values,
                       r.rank::INTEGER AS rank, r.value, r.value_count, round(r.value_count / t.n * 100, 2) AS value_pct
                FROM (SELECT count({c}) AS n, count(*) AS rows, count(DISTINCT {c}) AS d FROM {source}) t,
                     (SELECT {c} AS value, count(*) AS value_count, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank
                      FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) r
                WHERE r.rank <= {top_n}"""
        )
    return union_all(parts)


@query("categorical_profile", _categorical_sql("part", ["p_name", "p_brand", "p_type"], 10))
def _(spark, sf):
    return frequencies.categorical_profile(table(spark, sf, "part"))


@query("categorical_profile_gaps", _categorical_sql(EVENTS_WITH_GAPS, ["event_type"], 3))
def _(spark, sf):
    return frequencies.categorical_profile(events_with_gaps(spark, sf), top_n=3)


@query(
    "categorical_limited",
    union_all(
        [
            f"""SELECT '{c}' AS "column", 0 AS missing, 0.0::DOUBLE AS missing_pct, t.d AS unique_values, r.rank::INTEGER AS rank, r.value, r.value_count
                FROM (SELECT count(DISTINCT {c}) AS d FROM part) t LEFT JOIN
                     (SELECT {c} AS value, count(*) AS value_count, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank
                      FROM part GROUP BY {c}) r ON r.rank <= 5 AND t.d <= 30"""
            for c in ("p_brand", "p_type")
        ]
    ),
)
def _(spark, sf):
    return frequencies.categorical_limited(table(spark, sf, "part").withColumn("p_name", F.concat("p_name", F.col("p_partkey").cast("string"))), max_cols=2)


def _column_analysis_sql(source: str, numbers: list[str], others: list[str]) -> str:
    parts = []
    for c in numbers:
        outlying = f"""(SELECT outlier_count FROM ({outlier_counts_sql(source, [c])}))"""
        parts.append(
            f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct,
                       min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, {sig_sql(f'avg({c})')} AS mean,
                       {sig_sql(f'quantile_cont({c}, 0.5)')} AS median, {sig_sql(f'stddev_samp({c})')} AS std,
                       {sig_sql(f'quantile_cont({c}, 0.25)')} AS q1, {sig_sql(f'quantile_cont({c}, 0.75)')} AS q3,
                       {outlying} AS outlier_count, NULL::BIGINT AS unique_values, NULL::VARCHAR AS mode,
                       NULL::BIGINT AS mode_count, NULL::VARCHAR AS top_values FROM {source}"""
        )
    for c in others:
        counts = f"(SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v LIMIT 5)"
        parts.append(
            f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct,
                       NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT,
                       count(DISTINCT {c}), (SELECT v FROM {counts} LIMIT 1), (SELECT n FROM {counts} LIMIT 1),
                       (SELECT string_agg(v || '=' || n, ', ' ORDER BY n DESC, v) FROM {counts}) FROM {source}"""
        )
    return union_all(parts)


@query(
    "column_analysis",
    _column_analysis_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"]),
)
def _(spark, sf):
    out = profile.column_analysis(table(spark, sf, "customer"))
    return out.withColumns({c: sig(c) for c in ("mean", "median", "std", "q1", "q3")})


@query(
    "numeric_limited",
    f"""WITH s AS ({union_all([f'''SELECT {i} AS place, '{c}' AS "column", count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*) * 100, 1) AS missing_pct,
                 min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, {sig_sql(f'avg({c})')} AS mean, {sig_sql(f'quantile_cont({c}, 0.5)')} AS median,
                 {sig_sql(f'stddev_samp({c})')} AS std FROM {EVENTS_WITH_GAPS}''' for i, c in enumerate(EVENT_NUMBERS)])}),
             o AS ({outlier_counts_sql(EVENTS_WITH_GAPS, EVENT_NUMBERS)})
        SELECT s.* EXCLUDE (place) FROM s JOIN o USING ("column") ORDER BY o.outlier_count DESC, place LIMIT 2""",
)
def _(spark, sf):
    out = profile.numeric_limited(events_with_gaps(spark, sf), max_cols=2)
    return out.withColumns({c: sig(c) for c in ("mean", "median", "std")})


@query(
    "top_variance",
    f"""SELECT "column", variance FROM ({union_all([f'''SELECT '{c}' AS "column", {sig_sql(f'var_samp({c})')} AS variance FROM lineitem''' for c in LINEITEM_NUMBERS])})
        ORDER BY variance DESC, "column" LIMIT 5""",
)
def _(spark, sf):
    return charts.top_variance(table(spark, sf, "lineitem")).withColumn("variance", sig("variance"))


@query(
    "dataset_summary",
    union_all(
        [
            "SELECT 'shape' AS section, 'columns' AS name, 5 AS value",
            f"SELECT 'shape' AS section, 'rows' AS name, count(*) AS value FROM {EVENTS_WITH_GAPS}",
            "SELECT * FROM (VALUES ('kind', 'numeric', 3), ('kind', 'categorical', 1), ('kind', 'datetime', 1), ('kind', 'other', 0)) t(section, name, value)",
            *[
                f"SELECT 'missing' AS section, '{c}' AS name, count(*) - count({c}) AS value FROM {EVENTS_WITH_GAPS}"
                for c in ("event_id", "ts", "user_id", "event_type", "value")
            ],
            f"SELECT 'total' AS section, 'missing_cells' AS name, 2 * count(*) - count(event_type) - count(value) AS value FROM {EVENTS_WITH_GAPS}",
        ]
    ),
)
def _(spark, sf):
    return profile.dataset_summary(events_with_gaps(spark, sf))


@query(
    "summary_flags",
    union_all(
        [
            "SELECT * FROM (VALUES ('columns_of_type', 'bigint', 2), ('columns_of_type', 'string', 2), ('columns_of_type', 'double', 1), ('columns_of_type', 'timestamp_ntz', 1)) t(flag, name, value)",
            *[
                f"SELECT 'many_distinct' AS flag, '{c}' AS name, count(DISTINCT {c}) AS value FROM events HAVING count(DISTINCT {c}) > 10"
                for c in ("event_type", "props")
            ],
            f"""SELECT 'has_outliers' AS flag, "column" AS name, outlier_count AS value
                FROM ({outlier_counts_sql('events', EVENT_NUMBERS)}) WHERE outlier_count > 0""",
        ]
    ),
)
def _(spark, sf):
    return profile.summary_flags(table(spark, sf, "events"))


# ---------------------------------------------------------------- correlation


def _pearson_sql(source: str, columns: list[str]) -> str:
    parts = [f"SELECT '{c}' AS col_a, '{c}' AS col_b, 1.0::DOUBLE AS r" for c in columns]
    for a, b in combinations(columns, 2):
        parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {fix_sql(f'corr({a}, {b})')} AS r FROM {source}")
        parts.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, {fix_sql(f'corr({a}, {b})')} AS r FROM {source}")
    return union_all(parts)


def _ranked(source: str, a: str, b: str) -> str:
    """Average ranks after dropping rows where either value is missing."""
    return f"""(SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra,
                       rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb
                FROM (SELECT {a} AS a, {b} AS b FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"""


def _spearman_sql(source: str, columns: list[str]) -> str:
    parts = [f"SELECT '{c}' AS col_a, '{c}' AS col_b, 1.0::DOUBLE AS r" for c in columns]
    for a, b in combinations(columns, 2):
        for x, y in ((a, b), (b, a)):
            parts.append(f"SELECT '{x}' AS col_a, '{y}' AS col_b, {fix_sql('corr(ra, rb)')} AS r FROM {_ranked(source, a, b)}")
    return union_all(parts)


@query("corr_pearson", _pearson_sql("lineitem", LINEITEM_NUMBERS))
def _(spark, sf):
    return correlation.correlation_matrix(table(spark, sf, "lineitem")).withColumn("r", fix("r"))


@query("corr_pearson_gaps", _pearson_sql(EVENTS_WITH_GAPS, EVENT_NUMBERS))
def _(spark, sf):
    return correlation.correlation_matrix(events_with_gaps(spark, sf)).withColumn("r", fix("r"))


# More columns than one aggregate takes: the same four, eight times over with a shift.
_WIDE = [(f"{c}_{k}", f"({c} + {k} * l_linenumber)") for k in range(8) for c in ("l_quantity", "l_discount", "l_tax", "l_suppkey")]


WIDE_COLUMNS = [n for n, _ in _WIDE]


def wide_gappy_sql() -> str:
    """Each column is missing in a ninth of the rows."""
    return f"(SELECT {', '.join(f'CASE WHEN l_suppkey % 9 = {i % 9} THEN NULL ELSE {e}::DOUBLE END AS {n}' for i, (n, e) in enumerate(_WIDE))} FROM lineitem)"


def wide_gappy(spark, sf):
    return table(spark, sf, "lineitem").select(
        [F.when(F.col("l_suppkey") % 9 != i % 9, F.expr(e).cast("double")).alias(n) for i, (n, e) in enumerate(_WIDE)]
    )


def pearson_one_scan_sql(source: str, columns: list[str]) -> str:
    """All pairs as columns of one row, then unpivoted: hundreds of separate scans would take minutes."""
    pairs = list(combinations(range(len(columns)), 2))
    cells = ", ".join(f"{fix_sql(f'corr({columns[i]}, {columns[j]})')} AS r_{i}_{j}" for i, j in pairs)
    names = "[" + ", ".join(f"'{c}'" for c in columns) + "]"
    return f"""WITH u AS (UNPIVOT (SELECT {cells} FROM {source}) ON COLUMNS(*) INTO NAME pair VALUE r),
                    p AS (SELECT split_part(pair, '_', 2)::INTEGER AS i, split_part(pair, '_', 3)::INTEGER AS j, r FROM u)
               SELECT {names}[i + 1] AS col_a, {names}[j + 1] AS col_b, r FROM p
               UNION ALL SELECT {names}[j + 1] AS col_a, {names}[i + 1] AS col_b, r FROM p
               UNION ALL SELECT unnest({names}) AS col_a, unnest({names}) AS col_b, 1.0::DOUBLE AS r"""


@query("corr_pearson_wide", pearson_one_scan_sql(wide_gappy_sql(), WIDE_COLUMNS))
def _(spark, sf):
    return correlation.correlation_matrix(wide_gappy(spark, sf)).withColumn("r", fix("r"))


@query("corr_spearman", _spearman_sql("lineitem", LINEITEM_NUMBERS))
def _(spark, sf):
    return correlation.correlation_matrix(table(spark, sf, "lineitem"), "spearman").withColumn("r", fix("r"))


@query("corr_spearman_gaps", _spearman_sql(EVENTS_WITH_GAPS, EVENT_NUMBERS))
def _(spark, sf):
    return correlation.correlation_matrix(events_with_gaps(spark, sf), "spearman").withColumn("r", fix("r"))


# Gaps in other rows for each column but the last two, which have none; the first two are missing in the same rows.
_GAPPY_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey", "l_partkey"]
_GAPPY = f"""(SELECT {", ".join(f"CASE WHEN (l_orderkey * 7 + l_linenumber) % {m} = {m - 1} THEN NULL ELSE {c} END AS {c}" for c, m in zip(_GAPPY_COLUMNS, (5, 5, 7, 3)))},
                    l_suppkey, l_partkey FROM lineitem)"""


def _gappy(spark, sf):
    df = table(spark, sf, "lineitem")
    place = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    gaps = dict(zip(_GAPPY_COLUMNS, (5, 5, 7, 3)))
    return df.select([F.when(place % gaps[c] != gaps[c] - 1, F.col(c)).alias(c) if c in gaps else F.col(c) for c in _GAPPY_COLUMNS])


@query("corr_spearman_many_gaps", _spearman_sql(_GAPPY, _GAPPY_COLUMNS))
def _(spark, sf):
    return correlation.correlation_matrix(_gappy(spark, sf), "spearman").withColumn("r", fix("r"))


def _kendall_sql(source: str, columns: list[str]) -> str:
    """Discordant pairs by binary digits of one rank: before a row with a 0 there stand so many with a 1, of smaller other rank."""
    parts = [f"SELECT '{c}' AS col_a, '{c}' AS col_b, 1.0::DOUBLE AS r" for c in columns]
    for a, b in combinations(columns, 2):
        tau = f"""WITH r AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY {a}) AS a, dense_rank() OVER (ORDER BY {b}) AS b
                                          FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
                  g AS (SELECT a, level, b >> (level + 1) AS prefix, sum((b >> level) & 1) AS one, sum(1 - ((b >> level) & 1)) AS zero
                        FROM r, range(22) l(level) GROUP BY ALL),
                  w AS (SELECT zero, sum(one) OVER (PARTITION BY level, prefix ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ones FROM g),
                  s AS (SELECT (SELECT count(*)::DOUBLE * (count(*) - 1) / 2 FROM r) AS n,
                               (SELECT sum(k * (k - 1) / 2) FROM (SELECT count(*)::DOUBLE AS k FROM r GROUP BY a)) AS ta,
                               (SELECT sum(k * (k - 1) / 2) FROM (SELECT count(*)::DOUBLE AS k FROM r GROUP BY b)) AS tb,
                               (SELECT sum(k * (k - 1) / 2) FROM (SELECT count(*)::DOUBLE AS k FROM r GROUP BY a, b)) AS tab,
                               (SELECT coalesce(sum(zero * ones), 0)::DOUBLE FROM w) AS disc)
                  SELECT {fix_sql("(n - ta - tb + tab - 2 * disc) / (sqrt(n - ta) * sqrt(n - tb))")} FROM s"""
        parts.append(f"SELECT unnest(['{a}', '{b}']) AS col_a, unnest(['{b}', '{a}']) AS col_b, ({tau}) AS r")
    return union_all(parts)


@query("corr_kendall", _kendall_sql("lineitem", LINEITEM_NUMBERS))
def _(spark, sf):
    return correlation.correlation_matrix(table(spark, sf, "lineitem"), "kendall").withColumn("r", fix("r"))


@query("corr_kendall_many_gaps", _kendall_sql(_GAPPY, _GAPPY_COLUMNS))
def _(spark, sf):
    """In blocks, as tables over one task's size are."""
    return correlation.correlation_matrix(_gappy(spark, sf), "kendall", one_task=20_000).withColumn("r", fix("r"))


@query("corr_kendall_continuous", _kendall_sql("orders", ["o_custkey", "o_totalprice"]))
def _(spark, sf):
    """Nearly every value of a kind."""
    out = correlation.correlation_matrix(table(spark, sf, "orders"), "kendall", ["o_custkey", "o_totalprice"])
    return out.withColumn("r", fix("r"))


# Some columns that do hang together.
_LINKED = """(SELECT l_quantity, l_extendedprice, l_quantity * l_extendedprice AS spend, l_discount,
                     l_extendedprice * (1 - l_discount) AS net FROM lineitem)"""
_LINKED_COLUMNS = ["l_quantity", "l_extendedprice", "spend", "l_discount", "net"]


def _linked(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_quantity",
        "l_extendedprice",
        (F.col("l_quantity") * F.col("l_extendedprice")).alias("spend"),
        "l_discount",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
    )


@query(
    "strong_corr",
    f"""SELECT * FROM ({union_all([f"SELECT '{a}' AS col_a, '{b}' AS col_b, {fix_sql(f'corr({a}, {b})', 3)} AS r FROM {_LINKED} HAVING abs(corr({a}, {b})) >= 0.5" for a, b in combinations(_LINKED_COLUMNS, 2)])})
        ORDER BY abs(r) DESC, col_a, col_b LIMIT 50""",
)
def _(spark, sf):
    out = correlation.strong_correlations(_linked(spark, sf), threshold=0.5, max_pairs=50)
    return out.withColumn("r", fix("r", 3))


@query(
    "strong_corr_matrix",
    f"""WITH m AS ({_pearson_sql(_LINKED, _LINKED_COLUMNS)}),
             s AS (SELECT DISTINCT col_a FROM m WHERE col_a <> col_b AND abs(r) >= 0.65)
        SELECT * FROM m WHERE col_a IN (SELECT col_a FROM s) AND col_b IN (SELECT col_a FROM s)""",
)
def _(spark, sf):
    return correlation.strong_matrix(_linked(spark, sf), threshold=0.65).withColumn("r", fix("r"))


@query(
    "corr_matrix_wide",
    f"""SELECT col_a AS "column", {', '.join(f"max(CASE WHEN col_b = '{c}' THEN {fix_sql('r', 3)} END) AS {c}" for c in _LINKED_COLUMNS)}
        FROM ({_pearson_sql(_LINKED, _LINKED_COLUMNS)}) GROUP BY col_a""",
)
def _(spark, sf):
    matrix = correlation.correlation_matrix(_linked(spark, sf)).withColumn("r", fix("r"))
    out = correlation.wide_matrix(matrix, _LINKED_COLUMNS)
    return out.select("column", *[fix(c, 3).alias(c) for c in _LINKED_COLUMNS])


@query(
    "corr_min_threshold",
    f"""SELECT col_a, col_b, CASE WHEN abs(r) >= 0.6 THEN r ELSE 0.0 END AS r FROM ({_pearson_sql(_LINKED, _LINKED_COLUMNS)})""",
)
def _(spark, sf):
    return correlation.correlation_matrix(_linked(spark, sf), min_corr=0.6).withColumn("r", fix("r"))


_WHOLE_ROWS = """(SELECT event_id, user_id, value, spell FROM (
    SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
           CASE WHEN event_id % 5 = 0 THEN NULL ELSE (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000 END AS spell
    FROM events) WHERE value IS NOT NULL AND spell IS NOT NULL)"""


@query(
    "corr_heatmap",
    f"""WITH p AS (SELECT * FROM (VALUES ('event_id', 0), ('user_id', 1), ('value', 2), ('spell', 3)) t(c, i))
        SELECT m.* FROM ({_pearson_sql(_WHOLE_ROWS, ['event_id', 'user_id', 'value', 'spell'])}) m
        JOIN p x ON x.c = m.col_a JOIN p y ON y.c = m.col_b WHERE x.i > y.i""",
)
def _(spark, sf):
    since = F.col("ts") - F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    df = events_with_gaps(spark, sf).select(
        "event_id", "user_id", "value", F.when(F.col("event_id") % 5 != 0, since).alias("spell")
    )
    return charts.heatmap(df).withColumn("r", fix("r"))


# ---------------------------------------------------------------- time series


def _resample_sql(label: str, step: str, close: str, agg: str, empty: str = "NULL") -> str:
    """``label`` maps a day to its period's end, ``close`` a step's start to the end of its period."""
    return f"""WITH p AS (SELECT ts::DATE AS d, value FROM (
                            SELECT CASE WHEN event_id % 1000 = 1 THEN ts + INTERVAL 400 DAY ELSE ts END AS ts, value FROM {EVENTS_WITH_GAPS})
                          WHERE value IS NOT NULL),
                    g AS (SELECT {label.format(d='d')} AS date, {agg} AS value FROM p GROUP BY 1),
                    s AS (SELECT {close.format(d='x::DATE')} AS date FROM (
                            SELECT unnest(generate_series((SELECT min(date) FROM g)::TIMESTAMP, (SELECT max(date) FROM g)::TIMESTAMP, INTERVAL {step})) AS x))
               SELECT s.date, coalesce(g.value, {empty}) AS value FROM s LEFT JOIN g USING (date)"""


def _spread_events(spark, sf):
    """All events, some of them moved far ahead, so that there are periods without any."""
    late = F.col("ts") + F.expr("INTERVAL 400 DAY")
    return events_with_gaps(spark, sf).withColumn("ts", F.when(F.col("event_id") % 1000 == 1, late).otherwise(F.col("ts")))


def _resampled(spark, sf, freq, agg):
    return resample(_spread_events(spark, sf), "ts", "value", freq, agg)


@query("resample_day", _resample_sql("{d}", "1 DAY", "{d}", sig_sql("avg(value)")))
def _(spark, sf):
    return _resampled(spark, sf, "D", "mean").withColumn("value", sig("value"))


@query("resample_week", _resample_sql("({d} + ((7 - isodow({d}))::INTEGER))", "7 DAY", "{d}", sig_sql("sum(value)"), "0"))
def _(spark, sf):
    return _resampled(spark, sf, "W", "sum").withColumn("value", sig("value"))


@query("resample_stream", _resample_sql("{d}", "1 DAY", "{d}", sig_sql("avg(value)")))
def _(spark, sf):
    """The same events as a stream of files, one file per batch; every day stays open long enough."""
    df = _spread_events(spark, sf)
    folder, out, state = (scratch_path(spark, f"resample-{n}") for n in ("in", "out", "state"))
    df.repartition(4, "event_id").write.parquet(folder)
    states, late = resample_stream(micro_batched_files(spark, folder, df.schema), "ts", "value", out, state, lateness="1000 days")
    if late:
        raise AssertionError(f"{late} rows came too late")
    return states.resampled("D", "mean").withColumn("value", sig("value"))


def _months_sql(label: str, step: str, agg: str, empty: str = "NULL") -> str:
    return f"""WITH g AS (SELECT {label.format(d='o_orderdate::DATE')} AS date, {agg} AS value
                          FROM (SELECT o_totalprice, CASE WHEN o_orderkey % 997 = 1 THEN o_orderdate + INTERVAL 1200 DAY ELSE o_orderdate END AS o_orderdate FROM orders) GROUP BY 1),
                    s AS (SELECT last_day(x::DATE) AS date FROM (
                            SELECT unnest(generate_series(date_trunc('month', (SELECT min(date) FROM g))::TIMESTAMP,
                                                          date_trunc('month', (SELECT max(date) FROM g))::TIMESTAMP, INTERVAL {step})) AS x))
               SELECT s.date, coalesce(g.value, {empty}) AS value FROM s LEFT JOIN g USING (date)"""


def _spread_orders(spark, sf):
    """All orders, some of them moved years ahead."""
    late = F.col("o_orderdate") + F.expr("INTERVAL 1200 DAY")
    when = F.when(F.col("o_orderkey") % 997 == 1, late).otherwise(F.col("o_orderdate"))
    return table(spark, sf, "orders").withColumn("o_orderdate", when)


@query("resample_month", _months_sql("last_day({d})", "1 MONTH", "count(o_totalprice)", "0"))
def _(spark, sf):
    return resample(_spread_orders(spark, sf), "o_orderdate", "o_totalprice", "ME", "count")


@query(
    "resample_quarter",
    _months_sql("last_day((date_trunc('quarter', {d}) + INTERVAL 2 MONTH)::DATE)", "3 MONTH", "min(o_totalprice)"),
)
def _(spark, sf):
    df = _spread_orders(spark, sf).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return resample(df, "o_orderdate", "o_totalprice", "QE", "min")


@query(
    "resample_year",
    _months_sql("last_day((date_trunc('year', {d}) + INTERVAL 11 MONTH)::DATE)", "12 MONTH", "max(o_totalprice)"),
)
def _(spark, sf):
    return resample(_spread_orders(spark, sf), "o_orderdate", "o_totalprice", "YE", "max")


# ---------------------------------------------------------------- whole-table jobs


def _side_sql(source: str, columns: list[str], suffix: str) -> str:
    return union_all(
        [
            f"""SELECT '{c}' AS "column", count({c}) AS count_{suffix}, count(*) - count({c}) AS missing_{suffix}, avg({c}) AS mean_{suffix},
                       stddev_samp({c}) AS std_{suffix}, min({c})::DOUBLE AS min_{suffix}, max({c})::DOUBLE AS max_{suffix} FROM {source}"""
            for c in columns
        ]
    )


_KEPT = f"""(SELECT * FROM {EVENTS_WITH_GAPS} WHERE NOT coalesce(
    value < (SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) FROM {EVENTS_WITH_GAPS})
    OR value > (SELECT quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) FROM {EVENTS_WITH_GAPS}), false))"""


@query(
    "report_before_after",
    f"""SELECT "column", count_before, missing_before, {sig_sql('mean_before')} AS mean_before, {sig_sql('std_before')} AS std_before,
               min_before, max_before, count_after, missing_after, {sig_sql('mean_after')} AS mean_after, {sig_sql('std_after')} AS std_after,
               min_after, max_after, count_before + missing_before - count_after - missing_after AS rows_removed,
               {fix_sql('mean_after - mean_before')} AS mean_change
        FROM ({_side_sql(EVENTS_WITH_GAPS, EVENT_NUMBERS, 'before')}) JOIN ({_side_sql(_KEPT, EVENT_NUMBERS, 'after')}) USING ("column")""",
)
def _(spark, sf):
    df = events_with_gaps(spark, sf, nan=False)
    out = report.before_after(df, default_clean(df))
    return out.withColumns(
        {c: sig(c) for c in ("mean_before", "std_before", "mean_after", "std_after")} | {"mean_change": fix("mean_change")}
    )


@query(
    "report_shapes",
    union_all(
        [
            f"SELECT '{name}' AS dataset, count(*) AS rows, 5 AS columns, 2 * count(*) - count(event_type) - count(value) AS missing_cells FROM {source}"
            for name, source in (("original", EVENTS_WITH_GAPS), ("processed", _KEPT))
        ]
    ),
)
def _(spark, sf):
    df = events_with_gaps(spark, sf)
    return report.report_tables({"original": df, "processed": default_clean(df)})["shape"]


@query(
    "report_sample",
    union_all(
        [
            f"""SELECT '{name}' AS dataset, "row", "column", "value" FROM (
                  SELECT "row", unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS "column",
                         unnest([n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR]) AS "value"
                  FROM (SELECT *, row_number() OVER (ORDER BY n_name)::INTEGER AS "row" FROM nation WHERE {test}) WHERE "row" <= 5)"""
            for name, test in (("all", "true"), ("even", "n_nationkey % 2 = 0"))
        ]
    ),
)
def _(spark, sf):
    df = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return report.report_tables({"all": df, "even": df.where("n_nationkey % 2 = 0")}, sample_by=["n_name"])["sample"]


@query(
    "report_columns",
    union_all(
        [
            f"""SELECT 'nations' AS dataset, '{c}' AS "column", '{t}' AS dtype, '{k}' AS kind, count(*) - count({c}) AS missing_count FROM nation"""
            for c, t, k in (("n_nationkey", "int", "numeric"), ("n_name", "string", "categorical"), ("n_regionkey", "int", "numeric"))
        ]
        + [
            f"""SELECT 'events' AS dataset, '{c}' AS "column", '{t}' AS dtype, '{k}' AS kind, count(*) - count({c}) AS missing_count FROM {EVENTS_WITH_GAPS}"""
            for c, t, k in (
                ("event_id", "bigint", "numeric"),
                ("ts", "timestamp_ntz", "datetime"),
                ("user_id", "bigint", "numeric"),
                ("event_type", "string", "categorical"),
                ("value", "double", "numeric"),
            )
        ]
    ),
)
def _(spark, sf):
    return report.report_tables({"nations": table(spark, sf, "nation"), "events": events_with_gaps(spark, sf)})["columns"]

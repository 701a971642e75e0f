"""Types, missing values, outliers, scaling and cleaning steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import duration_seconds
from tallyframe.operators import filters, missing, outliers, scaling, types
from tallyframe.plans.cleaning import clean_with, default_clean

from .registry import (
    EVENTS_WITH_GAPS,
    ORDERS_WITH_GAPS,
    events_with_gaps,
    fix,
    fix_sql,
    orders_with_gaps,
    query,
    sig,
    sig_sql,
    table,
    union_all,
)

# ---------------------------------------------------------------- types


@query(
    "coerce_numeric",
    """SELECT l_orderkey, l_linenumber,
              CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS quantity,
              CASE WHEN l_linenumber > 4 THEN 'unknown' ELSE CAST(l_linenumber AS VARCHAR) END AS line,
              l_returnflag
       FROM lineitem""",
)
def _(spark, sf):
    line = F.col("l_linenumber")
    df = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(line == 7, F.lit("1d")).otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("string"))).alias("quantity"),
        F.when(line > 4, F.lit("unknown")).otherwise(line.cast("string")).alias("line"),
        "l_returnflag",
    )
    return types.coerce_numeric(df)


@query(
    "convert_types",
    """SELECT event_id,
              CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN NULL ELSE event_id END AS whole,
              CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS number,
              CAST(user_id AS VARCHAR) AS label,
              CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(date_trunc('day', ts) AS TIMESTAMP) END AS moment
       FROM events""",
)
def _(spark, sf):
    key = F.col("event_id")
    df = table(spark, sf, "events").select(
        "event_id",
        F.when(key % 4 == 0, F.lit("x"))
        .when(key % 4 == 1, F.lit("3.7"))
        .when(key % 4 == 2, F.concat(key.cast("string"), F.lit(".0")))
        .otherwise(key.cast("string"))
        .alias("whole"),
        F.when(key % 5 == 0, F.lit("none")).otherwise(F.col("value").cast("string")).alias("number"),
        F.col("user_id").alias("label"),
        F.when(key % 3 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("moment"),
    )
    return types.convert_data_types(
        df, {"whole": "int", "number": "float", "label": "str", "moment": "datetime", "absent": "int"}
    )


@query(
    "convert_bool",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false
                                          WHEN 4 THEN NULL ELSE NULL END AS flag
       FROM events""",
)
def _(spark, sf):
    words = ["Yes", "NO", "1", "false", "maybe", None]
    pick = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("event_id") % 6 + 1).cast("int"))
    df = table(spark, sf, "events").select("event_id", pick.alias("flag"))
    return types.convert_data_types(df, {"flag": "bool"})


def _column_types_sql(source: str, columns: list[tuple[str, str, str]]) -> str:
    """Columns as (name, data type, family)."""
    parts = []
    for name, dtype, kind in columns:
        category = (
            f"CASE WHEN count(DISTINCT {name}) <= least(10, floor(count(*) / 10)) THEN 'categorical' ELSE 'text' END"
            if kind == "text"
            else f"'{kind}'"
        )
        parts.append(
            f"""SELECT '{name}' AS "column", '{dtype}' AS dtype, {category} AS category,
                       count(*) - count({name}) AS missing_count,
                       round((count(*) - count({name})) / count(*) * 100, 2) AS missing_percent,
                       count(DISTINCT {name}) AS unique_count,
                       round(count(DISTINCT {name}) / count(*) * 100, 2) AS unique_percent
                FROM {source}"""
        )
    return union_all(parts)


@query(
    "column_types",
    _column_types_sql(
        EVENTS_WITH_GAPS,
        [
            ("event_id", "bigint", "integer"),
            ("ts", "timestamp_ntz", "datetime"),
            ("user_id", "bigint", "integer"),
            ("event_type", "string", "text"),
            ("value", "double", "float"),
        ],
    ),
)
def _(spark, sf):
    return types.column_types(events_with_gaps(spark, sf))


@query(
    "column_types_texts",
    _column_types_sql(
        "documents",
        [
            ("doc_id", "bigint", "integer"),
            ("text", "string", "text"),
            ("lang", "string", "text"),
            ("source", "string", "text"),
            ("n_chars", "bigint", "integer"),
        ],
    ),
)
def _(spark, sf):
    return types.column_types(table(spark, sf, "documents"))


@query(
    "detect_free_text",
    union_all(
        [
            f"""SELECT '{c}' AS "column", {sig_sql(f'avg(length({c}))')} AS avg_length, max(length({c}))::INTEGER AS max_length,
                       avg(length({c})) > 25 OR max(length({c})) > 100 AS is_free_text,
                       CASE WHEN length(min({c})) > 50 THEN substr(min({c}), 1, 50) || '...' ELSE min({c}) END AS sample
                FROM documents"""
            for c in ("text", "lang", "source")
        ]
    ),
)
def _(spark, sf):
    return types.detect_free_text(table(spark, sf, "documents")).withColumn("avg_length", sig("avg_length"))


_INTEGERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query(
    "narrow_ints",
    union_all(
        [
            f"""SELECT '{c}' AS "column", CASE WHEN max({c}) <= 127 THEN 'tinyint' WHEN max({c}) <= 32767 THEN 'smallint'
                       WHEN max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS dtype,
                       sum({c})::BIGINT AS total, count({c}) AS filled
                FROM lineitem"""
            for c in _INTEGERS
        ]
    ),
)
def _(spark, sf):
    df = types.narrow_integers(table(spark, sf, "lineitem"))
    facts = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
            F.sum(c).alias("total"),
            F.count(c).alias("filled"),
        )
        for c in _INTEGERS
    ]
    return df.agg(F.array(*facts).alias("f")).select(F.inline("f"))


@query(
    "categorical_candidates",
    union_all(
        [
            f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count,
                       count(DISTINCT {c}) < count(*) * 0.5 AS is_categorical FROM part"""
            for c in ("p_name", "p_brand", "p_type")
        ]
    ),
)
def _(spark, sf):
    return types.categorical_candidates(table(spark, sf, "part"))


@query(
    "duration_seconds",
    """SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000 AS seconds FROM events""",
)
def _(spark, sf):
    since = F.col("ts") - F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", duration_seconds(since).cast("double").alias("seconds"))


# ---------------------------------------------------------------- missing values

_GAPPY = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"]


def _ratio(c: str, source: str = ORDERS_WITH_GAPS) -> str:
    return f"(SELECT avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) FROM {source})"


@query(
    "missing_drop_rows",
    f"SELECT * FROM {ORDERS_WITH_GAPS} WHERE "
    + " AND ".join(f"({_ratio(c)} <= 0.3 OR {c} IS NOT NULL)" for c in _GAPPY),
)
def _(spark, sf):
    return missing.drop_missing_rows(orders_with_gaps(spark, sf), threshold=0.3)


@query("missing_drop_columns", f"SELECT o_orderkey, o_custkey, o_orderstatus FROM {ORDERS_WITH_GAPS}")
def _(spark, sf):
    return missing.drop_missing_columns(orders_with_gaps(spark, sf), threshold=0.3)


@query(
    "missing_fill",
    f"""SELECT o_orderkey, o_custkey, coalesce(o_totalprice, 0.5) AS o_totalprice,
               coalesce(o_orderpriority, 'unknown') AS o_orderpriority, o_orderstatus
        FROM {ORDERS_WITH_GAPS}""",
)
def _(spark, sf):
    return missing.handle_missing_values(
        orders_with_gaps(spark, sf),
        "fill_values",
        threshold=0.3,
        fill_values={"o_totalprice": 0.5, "o_orderpriority": "unknown", "o_orderstatus": "?"},
    )


_MODE = "(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(
    "missing_fill_auto",
    f"""SELECT o_orderkey, o_custkey,
               {sig_sql(f'coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM {ORDERS_WITH_GAPS}))')} AS o_totalprice,
               coalesce(o_orderpriority, {_MODE.format(c='o_orderpriority', t=ORDERS_WITH_GAPS)}) AS o_orderpriority,
               coalesce(o_orderstatus, 'none') AS o_orderstatus
        FROM {ORDERS_WITH_GAPS}""",
)
def _(spark, sf):
    out = missing.fill_missing(orders_with_gaps(spark, sf), {"o_orderstatus": "none"}, threshold=0.0)
    return out.withColumn("o_totalprice", sig("o_totalprice"))


@query(
    "impute_mean",
    f"SELECT event_id, {sig_sql(f'coalesce(value, (SELECT avg(value) FROM {EVENTS_WITH_GAPS}))')} AS value FROM {EVENTS_WITH_GAPS}",
)
def _(spark, sf):
    out = missing.impute(events_with_gaps(spark, sf), "value", "mean")
    return out.select("event_id", sig("value").alias("value"))


@query(
    "impute_median",
    f"SELECT event_id, {sig_sql(f'coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {EVENTS_WITH_GAPS}))')} AS value FROM {EVENTS_WITH_GAPS}",
)
def _(spark, sf):
    out = missing.impute(events_with_gaps(spark, sf), "value", "median")
    return out.select("event_id", sig("value").alias("value"))


@query(
    "impute_mode",
    f"SELECT event_id, coalesce(event_type, {_MODE.format(c='event_type', t=EVENTS_WITH_GAPS)}) AS event_type FROM {EVENTS_WITH_GAPS}",
)
def _(spark, sf):
    return missing.impute(events_with_gaps(spark, sf), "event_type", "mode").select("event_id", "event_type")


@query(
    "impute_constant",
    f"SELECT event_id, coalesce(value, 7.25) AS value FROM {EVENTS_WITH_GAPS}",
)
def _(spark, sf):
    return missing.impute(events_with_gaps(spark, sf), "value", "constant", "7.25").select("event_id", "value")


@query("impute_drop", f"SELECT event_id, value FROM {EVENTS_WITH_GAPS} WHERE value IS NOT NULL")
def _(spark, sf):
    return missing.impute(events_with_gaps(spark, sf), "value", "drop").select("event_id", "value")


_MISSING = union_all(
    [
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count, count(*) AS row_count FROM {ORDERS_WITH_GAPS}"""
        for c in _GAPPY
    ]
)


@query(
    "missing_profile",
    f"""SELECT "column", missing_count, round(missing_count / row_count * 100, 2) AS missing_percent
        FROM ({_MISSING}) WHERE missing_count > 0""",
)
def _(spark, sf):
    return missing.missing_profile(orders_with_gaps(spark, sf))


@query(
    "missing_summary",
    f"""SELECT count(*) FILTER (missing_count > 0) AS columns_with_missing,
               count(*) FILTER (missing_count / row_count > 0.1) AS columns_over_10_percent,
               count(*) FILTER (missing_count / row_count > 0.5) AS columns_over_50_percent,
               sum(missing_count)::BIGINT AS missing_cells,
               round(sum(missing_count) / sum(row_count) * 100, 2) AS missing_percent
        FROM ({_MISSING})""",
)
def _(spark, sf):
    return missing.missing_summary(orders_with_gaps(spark, sf))


# ---------------------------------------------------------------- outliers


def _iqr(c: str, source: str, t: float = 1.5) -> tuple[str, str]:
    q1 = f"(SELECT quantile_cont({c}, 0.25) FROM {source})"
    q3 = f"(SELECT quantile_cont({c}, 0.75) FROM {source})"
    return f"({q1} - {t} * ({q3} - {q1}))", f"({q3} + {t} * ({q3} - {q1}))"


def _not_outside(c: str, lo: str, hi: str) -> str:
    return f"NOT coalesce({c} < {lo} OR {c} > {hi}, false)"


_LO, _HI = _iqr("value", EVENTS_WITH_GAPS)
_FEW = "SELECT event_id, user_id, value FROM"


@query(
    "outlier_iqr_remove",
    f"""WITH a AS ({_FEW} {EVENTS_WITH_GAPS} WHERE {_not_outside('value', _LO, _HI)}),
             b AS (SELECT *, value * user_id AS load FROM a)
        SELECT event_id, user_id, value FROM b WHERE {_not_outside('load', *_iqr('load', 'b'))}""",
)
def _(spark, sf):
    df = events_with_gaps(spark, sf, nan=False).withColumn("load", F.col("value") * F.col("user_id"))
    out = outliers.handle_outliers(df, ["value", "load"], sequential=True)
    return out.select("event_id", "user_id", "value")


_LOADED = f"(SELECT *, value * user_id AS load FROM {EVENTS_WITH_GAPS})"


@query(
    "outlier_iqr_one_pass",
    f"""{_FEW} {_LOADED} WHERE {_not_outside('value', *_iqr('value', _LOADED))}
        AND {_not_outside('load', *_iqr('load', _LOADED))}""",
)
def _(spark, sf):
    df = events_with_gaps(spark, sf, nan=False).withColumn("load", F.col("value") * F.col("user_id"))
    return outliers.handle_outliers(df, ["value", "load"]).select("event_id", "user_id", "value")


@query(
    "outlier_z_remove",
    f"""{_FEW} {EVENTS_WITH_GAPS} WHERE NOT coalesce(
          abs(value - (SELECT avg(value) FROM {EVENTS_WITH_GAPS})) / (SELECT stddev_pop(value) FROM {EVENTS_WITH_GAPS}) > 2, false)""",
)
def _(spark, sf):
    out = outliers.handle_outliers(events_with_gaps(spark, sf, nan=False), ["value"], "zscore", 2)
    return out.select("event_id", "user_id", "value")


_P_LO = f"(SELECT quantile_cont(value, 0.05) FROM {EVENTS_WITH_GAPS})"
_P_HI = f"(SELECT quantile_cont(value, 0.95) FROM {EVENTS_WITH_GAPS})"


@query("outlier_pct_remove", f"{_FEW} {EVENTS_WITH_GAPS} WHERE {_not_outside('value', _P_LO, _P_HI)}")
def _(spark, sf):
    out = outliers.handle_outliers(events_with_gaps(spark, sf, nan=False), ["value"], "percentile", 5)
    return out.select("event_id", "user_id", "value")


@query(
    "outlier_clip",
    f"""SELECT event_id, {sig_sql(f'CASE WHEN value < {_LO} THEN {_LO} WHEN value > {_HI} THEN {_HI} ELSE value END')} AS value
        FROM {EVENTS_WITH_GAPS}""",
)
def _(spark, sf):
    out = outliers.handle_outliers(events_with_gaps(spark, sf), ["value"], strategy="clip")
    return out.select("event_id", sig("value").alias("value"))


_MEAN, _SPREAD = (f"(SELECT {f}(value) FROM {EVENTS_WITH_GAPS})" for f in ("avg", "stddev_samp"))


@query(
    "outlier_clip_z",
    f"""SELECT event_id, {sig_sql(f'CASE WHEN value < {_MEAN} - 2 * {_SPREAD} THEN {_MEAN} - 2 * {_SPREAD} WHEN value > {_MEAN} + 2 * {_SPREAD} THEN {_MEAN} + 2 * {_SPREAD} ELSE value END')} AS value
        FROM {EVENTS_WITH_GAPS}""",
)
def _(spark, sf):
    out = outliers.handle_outliers(events_with_gaps(spark, sf), ["value"], "zscore", 2, "clip")
    return out.select("event_id", sig("value").alias("value"))


def _replaced(fill: str) -> str:
    kept = f"(SELECT {fill} FROM {EVENTS_WITH_GAPS} WHERE {_not_outside('value', _LO, _HI)})"
    return f"""SELECT event_id, {sig_sql(f'CASE WHEN value < {_LO} OR value > {_HI} THEN {kept} ELSE value END')} AS value
               FROM {EVENTS_WITH_GAPS}"""


@query("outlier_mean", _replaced("avg(value)"))
def _(spark, sf):
    out = outliers.handle_outliers(events_with_gaps(spark, sf), ["value"], strategy="replace_mean")
    return out.select("event_id", sig("value").alias("value"))


@query("outlier_median", _replaced("quantile_cont(value, 0.5)"))
def _(spark, sf):
    out = outliers.handle_outliers(events_with_gaps(spark, sf), ["value"], strategy="replace_median")
    return out.select("event_id", sig("value").alias("value"))


def outlier_counts_sql(source: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        lo, hi = _iqr(c, source)
        parts.append(
            f"""SELECT '{c}' AS "column", {sig_sql(f'quantile_cont({c}, 0.25)')} AS q1, {sig_sql(f'quantile_cont({c}, 0.75)')} AS q3,
                       count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS outlier_count FROM {source}"""
        )
    return union_all(parts)


@query("outlier_counts", outlier_counts_sql(EVENTS_WITH_GAPS, ["event_id", "user_id", "value"]))
def _(spark, sf):
    out = outliers.outlier_counts(events_with_gaps(spark, sf))
    return out.select("column", sig("q1").alias("q1"), sig("q3").alias("q3"), "outlier_count")


# ---------------------------------------------------------------- scaling

_SCALED = ["user_id", "value"]


def _over(c: str, f: str) -> str:
    return f"(SELECT {f.format(c=c)} FROM {EVENTS_WITH_GAPS})"


def _scale_sql(formula: str) -> str:
    cells = ", ".join(f"{fix_sql(formula(c))} AS {c}" for c in _SCALED)
    return f"SELECT event_id, {cells} FROM {EVENTS_WITH_GAPS}"


def _scaled(spark, sf, method, **options):
    out = scaling.normalize_data(events_with_gaps(spark, sf), _SCALED, method, **options)
    return out.select("event_id", *[fix(c).alias(c) for c in _SCALED])


@query(
    "scale_minmax",
    _scale_sql(lambda c: f"(({c} - {_over(c, 'min({c})')}) / ({_over(c, 'max({c})')} - {_over(c, 'min({c})')}))"),
)
def _(spark, sf):
    return _scaled(spark, sf, "minmax")


@query(
    "scale_minmax_range",
    _scale_sql(
        lambda c: f"(({c} - {_over(c, 'min({c})')}) / ({_over(c, 'max({c})')} - {_over(c, 'min({c})')}) * 15 - 5)"
    ),
)
def _(spark, sf):
    return _scaled(spark, sf, "minmax", custom_range=(-5, 10))


@query("scale_zscore", _scale_sql(lambda c: f"(({c} - {_over(c, 'avg({c})')}) / {_over(c, 'stddev_pop({c})')})"))
def _(spark, sf):
    return _scaled(spark, sf, "zscore")


@query(
    "scale_robust",
    _scale_sql(
        lambda c: f"(({c} - {_over(c, 'quantile_cont({c}, 0.5)')}) / "
        f"({_over(c, 'quantile_cont({c}, 0.75)')} - {_over(c, 'quantile_cont({c}, 0.25)')}))"
    ),
)
def _(spark, sf):
    return _scaled(spark, sf, "robust")


@query(
    "scale_log",
    _scale_sql(
        lambda c: f"ln({c} + CASE WHEN {_over(c, 'min({c})')} <= 0 THEN abs({_over(c, 'min({c})')}) + 1 ELSE 0 END)"
    ),
)
def _(spark, sf):
    return _scaled(spark, sf, "log")


# ---------------------------------------------------------------- steps


@query(
    "cleaning_steps",
    f"""WITH a AS (SELECT event_id, event_type, user_id, coalesce(value, 0.0) AS value FROM {EVENTS_WITH_GAPS}),
             b AS (SELECT * FROM a WHERE user_id >= 5 AND user_id <= 120),
             c AS (SELECT * FROM b WHERE {_not_outside('value', *_iqr('value', 'b'))})
        SELECT event_id, event_type, user_id,
               {fix_sql('(value - (SELECT min(value) FROM c)) / ((SELECT max(value) FROM c) - (SELECT min(value) FROM c))')} AS value
        FROM c""",
)
def _(spark, sf):
    out = clean_with(
        events_with_gaps(spark, sf),
        [
            ("fill", missing.fill_missing, {"fill_values": {"value": 0.0}, "threshold": 0.1}),
            ("range", filters.filter_by_range, {"column": "user_id", "min_value": 5, "max_value": 120}),
            ("outliers", outliers.handle_outliers, {"columns": ["value"]}),
            ("scale", scaling.normalize_data, {"columns": ["value"]}),
        ],
    )
    return out.select("event_id", "event_type", "user_id", fix("value").alias("value"))


def _default_clean_sql(columns: list[str]) -> str:
    """One step per column: each takes its bounds from what the columns before have kept."""
    steps = [f"s0 AS (SELECT * FROM {EVENTS_WITH_GAPS})"]
    for i, c in enumerate(columns):
        steps.append(f"s{i + 1} AS (SELECT * FROM s{i} WHERE {_not_outside(c, *_iqr(c, f's{i}'))})")
    return f"WITH {', '.join(steps)} SELECT event_id, event_type, user_id, value FROM s{len(columns)}"


@query("default_clean", _default_clean_sql(["event_id", "user_id", "value"]))
def _(spark, sf):
    out = default_clean(events_with_gaps(spark, sf, nan=False))
    return out.select("event_id", "event_type", "user_id", "value")

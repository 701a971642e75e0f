"""All tables of a full profile and of a batch job, cell by cell, against the statements of their parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.plans import jobs, profile
from tallyframe.plans.storage import scratch_path

from .analysis import _categorical_sql, _pearson_sql, _profile_sql, _side_sql
from .chart_queries import bundle_sql
from .cleaning_queries import _iqr, _not_outside
from .querying import _stats_sql
from .registry import fix, query, sig, sig_sql, table, union_all
from .text_queries import _freq_sql

# Columns that name a row of each part, and those with few digits before the point.
_KEYS = {
    "summary": ["section", "name"],
    "numeric": ["column"],
    "categorical": ["column", "rank"],
    "correlation": ["col_a", "col_b"],
    "strong_correlation": ["col_a", "col_b"],
    "group": ["lang"],
    "text_summary": ["column"],
    "text_word_freq": ["column", "rank"],
    "text_keywords": ["column", "rank"],
    "text_samples": ["column", "rank"],
}
_FIXED = {"skew", "kurtosis", "r"}


_BATCH_KEYS = {f"profile_{part}": keys for part, keys in _KEYS.items()} | {
    "profile_group": ["c_mktsegment"],
    "cleaned": ["c_custkey"],
    "report_shape": ["dataset"],
    "report_columns": ["dataset", "column"],
    "report_describe": ["dataset", "column"],
    "report_before_after": ["column"],
}


def _cells(part: str, rows: DataFrame, keys: list[str]) -> DataFrame:

    def cell(c: str):
        kind = rows.schema[c].dataType.typeName()
        number = F.lit(None) if kind == "string" else fix(c) if c in _FIXED else sig(c) if kind == "double" else F.col(f"`{c}`")
        text = F.col(f"`{c}`") if kind == "string" else F.lit(None)
        return F.struct(F.lit(c).alias("name"), number.cast("double").alias("number"), text.cast("string").alias("text"))

    key = F.concat_ws("/", *[F.col(f"`{k}`").cast("string") for k in keys])
    return rows.select(F.lit(part).alias("part"), key.alias("key"), F.inline(F.array(*[cell(c) for c in rows.columns if c not in keys])))


def _cells_sql(part: str, statement: str, numbers: list[str], texts: list[str] = [], keys: list[str] | None = None) -> str:  # noqa: B006
    key = " || '/' || ".join(f'"{k}"::VARCHAR' for k in keys or _KEYS[part])
    listed = lambda names, of: "[" + ", ".join(of(n) for n in names) + "]"
    name = lambda n: f"'{n}'"
    return f"""SELECT '{part}' AS part, {key} AS key, unnest({listed([*numbers, *texts], name)}) AS name,
                      unnest({listed([*numbers, *texts], lambda n: f'"{n}"::DOUBLE' if n in numbers else 'NULL')}) AS number,
                      unnest({listed([*numbers, *texts], lambda n: f'"{n}"::VARCHAR' if n in texts else 'NULL')}) AS text FROM ({statement})"""


_PROFILED = "count missing missing_pct mean median std var min max range unique_values q10 q25 q50 q75 q90 skew kurtosis".split()
_COUNTED = "count missing missing_pct unique_values value_count value_pct".split()


def _full_profile_sql() -> str:
    numbers, categories = ["doc_id", "n_chars"], ["lang", "source"]
    summary = union_all(
        [
            "SELECT * FROM (VALUES ('shape', 'columns', 5), ('kind', 'numeric', 2), ('kind', 'categorical', 3), ('kind', 'datetime', 0), ('kind', 'other', 0)) t(section, name, value)",
            "SELECT 'shape' AS section, 'rows' AS name, count(*) AS value FROM documents",
            *[f"SELECT 'missing' AS section, '{c}' AS name, count(*) - count({c}) AS value FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")],
            "SELECT 'total' AS section, 'missing_cells' AS name, 5 * count(*) - count(doc_id) - count(text) - count(lang) - count(source) - count(n_chars) AS value FROM documents",
        ]
    )
    pearson = _pearson_sql("documents", numbers)
    words = f"""SELECT 'text' AS "column", row_number() OVER (ORDER BY count DESC, word)::INTEGER AS rank, word, count FROM ({_freq_sql("text", "documents", 30)})"""
    samples = """SELECT 'text' AS "column", row_number() OVER (ORDER BY length(text) DESC, text)::INTEGER AS rank, length(text)::INTEGER AS length,
                        CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS sample
                 FROM (SELECT text FROM documents ORDER BY length(text) DESC, text LIMIT 5)"""
    stats = [f"{c}_{s}" for c in numbers for s in ("count", "mean", "median", "std", "min", "max")]
    return union_all(
        [
            _cells_sql("summary", summary, ["value"]),
            _cells_sql("numeric", _profile_sql("documents", numbers), _PROFILED),
            _cells_sql("categorical", _categorical_sql("documents", categories, 10), _COUNTED, ["value"]),
            _cells_sql("correlation", pearson, ["r"]),
            _cells_sql("strong_correlation", f"SELECT * FROM ({pearson}) WHERE col_a < col_b AND abs(r) >= 0.7", ["r"]),
            _cells_sql("group", f"SELECT lang, {_stats_sql(numbers)} FROM documents WHERE lang IS NOT NULL GROUP BY lang", stats),
            _cells_sql("text_summary", f"""SELECT 'text' AS "column", count(text) AS response_count, {sig_sql("avg(length(text))")} AS avg_length FROM documents""", ["response_count", "avg_length"]),
            _cells_sql("text_word_freq", words, ["count"], ["word"]),
            _cells_sql("text_keywords", f"SELECT * FROM ({words}) WHERE rank <= 10", [], ["word"]),
            _cells_sql("text_samples", samples, ["length"], ["sample"]),
        ]
    )


@query("full_profile", _full_profile_sql())
def _(spark, sf):
    parts = profile.full_profile(table(spark, sf, "documents"), free_text=["text"])
    return reduce(DataFrame.unionByName, [_cells(part, rows, _KEYS[part]) for part, rows in parts.items()])


def _batch_sql() -> str:
    """Of the customers, which have no gaps; cleaning takes each number's bounds from what the numbers before have kept."""
    numbers, texts = ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"]
    columns = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")]
    steps = ["s0 AS (SELECT * FROM customer)"]
    for i, c in enumerate(numbers):
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT * FROM s{i} WHERE {_not_outside(c, *_iqr(c, f's{i}'))})")
    steps.append(f"kept AS (SELECT * FROM s{len(numbers)})")
    sources = {"original": "customer", "processed": "kept"}
    summary = union_all(
        [
            "SELECT * FROM (VALUES ('shape', 'columns', 5), ('kind', 'numeric', 3), ('kind', 'categorical', 2), ('kind', 'datetime', 0), ('kind', 'other', 0), ('total', 'missing_cells', 0)) t(section, name, value)",
            "SELECT 'shape' AS section, 'rows' AS name, count(*) AS value FROM kept",
            *[f"SELECT 'missing' AS section, '{c}' AS name, count(*) - count({c}) AS value FROM kept" for c, _ in columns],
        ]
    )
    shape = union_all([f"SELECT '{n}' AS dataset, count(*) AS rows, 5 AS columns, 0 AS missing_cells FROM {s}" for n, s in sources.items()])
    schema = union_all(
        [
            f"SELECT '{n}' AS dataset, '{c}' AS \"column\", '{kind}' AS dtype, '{'categorical' if kind == 'string' else 'numeric'}' AS kind, 0 AS missing_count"
            for n in sources
            for c, kind in columns
        ]
    )
    described = union_all([f"SELECT '{n}' AS dataset, * FROM ({_profile_sql(s, numbers)})" for n, s in sources.items()])
    change = f"""SELECT *, count_before - count_after AS rows_removed, mean_after - mean_before AS mean_change
                 FROM ({_side_sql("customer", numbers, "before")}) JOIN ({_side_sql("kept", numbers, "after")}) USING ("column")"""
    sides = [f"{s}_{side}" for side in ("before", "after") for s in ("count", "missing", "mean", "std", "min", "max")]
    pearson = _pearson_sql("kept", numbers)
    stats = [f"{c}_{s}" for c in numbers for s in ("count", "mean", "median", "std", "min", "max")]
    cells = lambda part, *rest: _cells_sql(part, *rest, keys=_BATCH_KEYS[part])
    parts = [
        cells("cleaned", "SELECT * FROM kept", ["c_nationkey", "c_acctbal"], texts),
        cells("profile_summary", summary, ["value"]),
        cells("profile_numeric", _profile_sql("kept", numbers), _PROFILED),
        cells("profile_categorical", _categorical_sql("kept", texts, 10), _COUNTED, ["value"]),
        cells("profile_correlation", pearson, ["r"]),
        cells("profile_strong_correlation", f"SELECT * FROM ({pearson}) WHERE col_a < col_b AND abs(r) >= 0.7", ["r"]),
        cells("profile_group", f"SELECT c_mktsegment, {_stats_sql(numbers)} FROM kept GROUP BY c_mktsegment", stats),
        cells("report_shape", shape, ["rows", "columns", "missing_cells"]),
        cells("report_columns", schema, ["missing_count"], ["dtype", "kind"]),
        cells("report_describe", described, ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]),
        cells("report_before_after", change, [*sides, "rows_removed", "mean_change"]),
        f"""SELECT 'charts' AS part, concat_ws('/', chart_id, series, label, floor(x)::BIGINT, floor(y)::BIGINT) AS key, kind AS name, value AS number, NULL AS text
            FROM ({bundle_sql("kept", numbers, texts, ["c_mktsegment"])})""",
    ]
    number = sig_sql("number")
    return f"""WITH {", ".join(steps)}, cells AS ({union_all(parts)})
               SELECT part, key, name, CASE WHEN part = 'charts' OR name IN ('r', 'skew', 'kurtosis') THEN number ELSE {number} END AS number, text FROM cells"""


@query("batch_job", _batch_sql())
def _(spark, sf):
    """Clean, profile, chart and write the customers; all that was written is read back."""
    paths = jobs.run_batch(table(spark, sf, "customer"), scratch_path(spark, "batch"))
    written = {name: spark.read.parquet(path) for name, path in paths.items()}
    charts = written.pop("charts")
    place = F.concat_ws("/", "chart_id", "series", "label", F.floor(fix("x")), F.floor(fix("y")))
    drawn = charts.select(F.lit("charts").alias("part"), place.alias("key"), F.col("kind").alias("name"), fix("value").alias("number"), F.lit(None).cast("string").alias("text"))
    return reduce(DataFrame.unionByName, [*[_cells(part, rows, _BATCH_KEYS[part]) for part, rows in written.items()], drawn])

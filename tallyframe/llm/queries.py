"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, chat, decontaminate, html, langid, licenses, lines, minhash, quality, rlz, suffixes, vectorcodes

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_texts(_table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.substring_report(_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(
        _table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_report(_table(spark, sf_dir, "documents"))


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_report(_table(spark, sf_dir, "documents"), minhash.Likeness(shingle=3, percent=85))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.vector_code_report(_table(spark, sf_dir, "embeddings"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_report(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontamination": op3_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_language_id": op5_language_id,
    "op6_html_extraction": op6_html_extraction,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_minhash_neardup": op10_minhash_neardup,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_codes": op12_vector_codes,
    "op13_chat_formatting": op13_chat_formatting,
}

# The SQL takes the query's own parameters: limits, the prior by moments, windows of eight words.
QUALITY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, coalesce('=' || source, '') AS host,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT id, s, count(*) OVER (PARTITION BY id, g) AS n
  FROM (SELECT id, s, array_to_string(w[s + 1 : s + 8], ' ') AS g
        FROM (SELECT id, w, unnest(range(0, len(w) - 7)) AS s FROM d WHERE len(w) >= 8))),
rep AS (
  SELECT id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT id, unnest(range(s, s + 8)) AS p FROM win WHERE n > 1) GROUP BY id),
ln AS (
  SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
m AS (
  SELECT d.id, doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (id) LEFT JOIN ln USING (id)),
r AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         CAST(100 * n_symbols > 10 * word_chars AS BIGINT) + CAST(100 * n_dup_lines > 50 * n_lines AS BIGINT)
         + CAST(word_chars > 25 * n_words AS BIGINT) AS soft_failures,
         CAST(100 * n_symbols > 4 * word_chars AS BIGINT) + CAST(100 * n_dup_lines > 20 * n_lines AS BIGINT)
         + CAST(word_chars > 15 * n_words AS BIGINT) AS strict_failures
  FROM m),
h AS (
  SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(base_failed OR soft_failures > 0 AS INT)) AS DOUBLE) AS f FROM r GROUP BY host),
fit AS (SELECT sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ** 2 AS var FROM h),
prior AS (SELECT mean, var, greatest(1.0, mean * (1 - mean) / nullif(var, 0) - 1) AS s FROM fit),
v AS (
  SELECT host, CASE WHEN var > 1e-12 THEN (f + mean * s) / (n + s) ELSE mean END > 0.5 AS host_rejected FROM h, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND CASE WHEN host_rejected THEN strict_failures ELSE soft_failures END = 0 AS kept,
       soft_failures, strict_failures, host_rejected
FROM r JOIN v USING (host)
"""

LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, i, list_extract(parts, i) AS line, trim(list_extract(parts, i), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))),
w AS (SELECT doc_id, i, bare, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l WHERE bare <> ''),
k AS (
  SELECT doc_id, n, bare || chr(10) || lead(bare) OVER d || chr(10) || lead(bare, 2) OVER d AS key
  FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY n)),
r AS (
  SELECT doc_id, n, row_number() OVER (PARTITION BY key ORDER BY doc_id, n) AS nth FROM k WHERE key IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(n, n + 3)) AS n FROM r WHERE nth > 1),
m AS (
  SELECT l.doc_id, l.i, l.line, l.bare <> '' AS word, w.n, g.n IS NOT NULL AS gone
  FROM l LEFT JOIN w ON l.doc_id = w.doc_id AND l.i = w.i LEFT JOIN g ON g.doc_id = w.doc_id AND g.n = w.n),
a AS (
  SELECT *,
    last_value(CASE WHEN word THEN gone END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    first_value(CASE WHEN word THEN gone END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
  FROM m),
t AS (
  SELECT doc_id, count(*) FILTER (WHERE word) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE CASE WHEN word THEN NOT gone ELSE NOT (coalesce(before, false) AND coalesce(after, false)) END), '') AS text
  FROM a GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN t.text END AS text
FROM documents d LEFT JOIN t USING (doc_id)
"""

# All orders spelled out; the masks' cells are summed per order and step, the last column over all orders.
AUDIT_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
m AS (
  SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
         count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT v.f || w.f || x.f || y.f || z.f AS filter_order
  FROM letters v, letters w, letters x, letters y, letters z WHERE v.bit | w.bit | x.bit | y.bit | z.bit = 31),
steps AS (
  SELECT filter_order, step, bit, coalesce(sum(bit) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS earlier
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders) JOIN letters ON f = filter_order[step]),
counts AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (bit | earlier) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit) AS shapley
FROM counts
"""


def _vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Every round is a common table of assignments and one of codebooks."""
    ctes = [
        f"""k AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""p AS MATERIALIZED (
  SELECT id, part, v[(part * len(v)) // {parts} + 1 : ((part + 1) * len(v)) // {parts}] AS x FROM k, range({parts}) r(part))""",
        f"""c0 AS MATERIALIZED (
  SELECT part, entry, x AS c FROM p JOIN (SELECT id, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM k) USING (id)
  WHERE entry < {entries})""",
    ]
    for i in range(rounds + 1):
        ctes.append(
            f"""a{i} AS MATERIALIZED (
  SELECT id, part, any_value(x) AS x, min(CAST(list_dot_product(x, x) + list_dot_product(c, c) - 2 * list_dot_product(x, c) AS BIGINT) * 256 + entry) AS best
  FROM p JOIN c{i} USING (part) GROUP BY id, part)"""
        )
        if i < rounds:
            ctes.append(
                f"""c{i + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m, c) AS c
  FROM c{i} LEFT JOIN (
    SELECT part, entry, list(q ORDER BY pos) AS m
    FROM (SELECT part, best % 256 AS entry, pos, floor(sum(y) / count(*)) AS q
          FROM (SELECT part, best, unnest(x) AS y, unnest(range(len(x))) AS pos FROM a{i}) GROUP BY ALL)
    GROUP BY part, entry) USING (part, entry))"""
            )
    return (
        "WITH "
        + ",\n".join(ctes)
        + f""",
r AS (
  SELECT k.id, vec_id, label, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error
  FROM k JOIN a{rounds} USING (id) GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos))
        FROM (SELECT part, entry, unnest(c) AS y, unnest(range(len(c))) AS pos FROM c{rounds})) AS codebooks_sha256
FROM r
"""
    )


# formatted_chars follows from the template: markers, doubled backslashes and one backslash per control string.
CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length(role) + length(text) + len(regexp_extract_all(role || chr(10) || text, '\\|<s>|</s>|\[INST\]|\[/INST\]')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(length('<s>') + sum(n + length('[INST][/INST]</s>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES: dict[str, str] = {
    "op2_quality_rules": QUALITY_SQL.strip(),
    "op4_line_dedup": LINES_SQL.strip(),
    "op11_filter_audit": AUDIT_SQL.strip(),
    "op12_vector_codes": _vector_codes_sql(),
    "op13_chat_formatting": CHAT_SQL.strip(),
}

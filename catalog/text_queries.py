"""Free-text answers. The words of whole texts are counted, in every language of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import filters, text

from .registry import query, sig, sig_sql, table, union_all


def words_sql(column: str) -> str:
    bare = rf"regexp_replace(regexp_replace({column}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\p{{Nd}}+', ' ', 'g')"
    stop = ", ".join(f"'{w}'" for w in text.KOREAN_STOP_WORDS)
    return rf"list_filter(regexp_split_to_array({bare}, '\s+'), lambda w: length(w) > 1 AND w NOT IN ({stop}))"


@query("tokenize", f"SELECT doc_id, len({words_sql('text')}) AS n_words, array_to_string({words_sql('text')}, ' ') AS words FROM documents")
def _(spark, sf):
    out = text.tokenize(table(spark, sf, "documents"), "text")
    return out.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.array_join("words", " ").alias("words"))


def _freq_sql(column: str, source: str, n: int) -> str:
    return f"""SELECT word, count(*) AS count FROM (SELECT unnest({words_sql(column)}) AS word FROM {source})
               GROUP BY word ORDER BY count DESC, word LIMIT {n}"""


@query("word_freq", _freq_sql("text", "documents", 30))
def _(spark, sf):
    return text.word_frequency(table(spark, sf, "documents"), "text")


@query("keywords", f"SELECT word FROM ({_freq_sql('text', 'conversations', 10)})")
def _(spark, sf):
    return text.keywords(table(spark, sf, "conversations"), "text")


@query("keywords_bar", _freq_sql("text", "conversations", 15))
def _(spark, sf):
    return text.word_frequency(table(spark, sf, "conversations"), "text", 15)


@query(
    "text_summary",
    union_all(
        [
            f"""SELECT '{c}' AS "column", count({c}) AS response_count, {sig_sql(f'avg(length({c}))')} AS avg_length FROM documents"""
            for c in ("text", "source")
        ]
    ),
)
def _(spark, sf):
    return text.text_summary(table(spark, sf, "documents"), ["text", "source"]).withColumn("avg_length", sig("avg_length"))


@query(
    "longest_texts",
    """SELECT 'text' AS "column", row_number() OVER (ORDER BY length(text) DESC, text)::INTEGER AS rank, length(text)::INTEGER AS length,
              CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS sample
       FROM (SELECT text FROM documents ORDER BY length(text) DESC, text LIMIT 5)""",
)
def _(spark, sf):
    return text.longest_texts(table(spark, sf, "documents"), "text")


@query(
    "text_analysis",
    union_all(
        [
            f"""SELECT '{c}' AS "column", row_number() OVER (ORDER BY count DESC, word)::INTEGER AS rank, word, count
                FROM ({_freq_sql(c, 'conversations', 30)})"""
            for c in ("role", "text")
        ]
    ),
)
def _(spark, sf):
    return text.text_analysis(table(spark, sf, "conversations"), ["role", "text"])["word_freq"]


_BLANKED = "(SELECT event_id, CASE event_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE event_type END AS note FROM events)"


@query("non_blank_text", f"SELECT event_id, note FROM {_BLANKED} WHERE trim(note) <> ''")
def _(spark, sf):
    key = F.col("event_id") % 3
    df = table(spark, sf, "events").select(
        "event_id", F.when(key == 0, F.lit("  ")).when(key == 2, F.col("event_type")).alias("note")
    )
    return filters.non_blank(df, "note")

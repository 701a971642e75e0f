"""Free-text answers: words, frequencies and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import col, known
from tallyframe.functions.columns import unpivot
from tallyframe.functions.words import KOREAN_STOP_WORDS, is_stop_word, shorten, tokens, words


def _text(df: DataFrame, column: str) -> Column:
    return col(column).cast("string")


def tokenize(
    df: DataFrame, column: str, output: str = "words", stop_words: Sequence[str] = KOREAN_STOP_WORDS
) -> DataFrame:
    """Add an array column with the words of a text column."""
    return df.withColumn(output, tokens(_text(df, column), stop_words))


def _answers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return unpivot(df, {c: _text(df, c) for c in columns})


def word_frequency(
    df: DataFrame, column: str, top_n: int = 30, stop_words: Sequence[str] = KOREAN_STOP_WORDS
) -> DataFrame:
    """``word, count``, most frequent first, equal counts by word."""
    found = df.select(F.explode(words(_text(df, column))).alias("word"))
    # Stop words go after the count, when each is one row.
    return (
        found.groupBy("word")
        .agg(F.count(F.lit(1)).alias("count"))
        .where(~is_stop_word(F.col("word"), stop_words))
        .orderBy(F.desc("count"), F.asc("word"))
        .limit(top_n)
    )


def keywords(
    df: DataFrame, column: str, top_n: int = 10, stop_words: Sequence[str] = KOREAN_STOP_WORDS
) -> DataFrame:
    return word_frequency(df, column, top_n, stop_words).select("word")


def longest_texts(df: DataFrame, columns: str | Sequence[str], top_n: int = 5, cut: int | None = 200) -> DataFrame:
    """``column, rank, length, sample``: the longest answers, equal lengths by text.

    Each column is a bounded top-k of its own, reading only that column; no
    text is sorted or moved unless it is among a task's longest.
    """
    tops = []
    for name in known(df, columns):
        text = _text(df, name)
        tops.append(
            df.select(F.lit(name).alias("column"), text.alias("value"), F.length(text).alias("length"))
            .where(F.col("value").isNotNull())
            .orderBy(F.desc("length"), F.asc("value"))
            .limit(top_n)
        )
    order = Window.partitionBy("column").orderBy(F.desc("length"), F.asc("value"))
    ranked = reduce(DataFrame.unionByName, tops).withColumn("rank", F.row_number().over(order))
    sample = F.col("value") if cut is None else shorten(F.col("value"), cut)
    return ranked.select("column", "rank", "length", sample.alias("sample"))


def text_summary(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """``column, response_count, avg_length`` per text column."""
    return (
        _answers(df, known(df, columns))
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("response_count"), F.avg(F.length("value")).alias("avg_length"))
    )


def ranked_words(
    df: DataFrame, columns: Sequence[str], top_n: int = 30, stop_words: Sequence[str] = KOREAN_STOP_WORDS
) -> DataFrame:
    """``column, rank, word, count`` for several text columns in one job."""
    found = _answers(df, known(df, columns)).select("column", F.explode(words(F.col("value"))).alias("word"))
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("word"))
    return (
        found.groupBy("column", "word")
        .agg(F.count(F.lit(1)).alias("count"))
        .where(~is_stop_word(F.col("word"), stop_words))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_n)
        .select("column", "rank", "word", "count")
    )


def text_analysis(
    df: DataFrame, columns: Sequence[str], top_n: int = 30, stop_words: Sequence[str] = KOREAN_STOP_WORDS
) -> dict[str, DataFrame]:
    """Summary, words, keywords and samples of all declared text columns, each one table."""
    ranked = ranked_words(df, columns, top_n, stop_words)
    return {
        "summary": text_summary(df, columns),
        "word_freq": ranked,
        "keywords": ranked.where(F.col("rank") <= 10).select("column", "rank", "word"),
        "samples": longest_texts(df, columns),
    }

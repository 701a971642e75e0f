"""Quality rules per document and per host, in DataFrame functions only.

A document's rule failures are counted up by host. A host's failure rate is
shrunk towards the corpus by a beta prior fitted to all hosts, so that a host
with three documents is not judged by three documents. The host's verdict then
goes back to its documents: on a rejected host the stricter limits hold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import scratch_path

WHITE = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
WHITE_RUN = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]"
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Limits of the rules, each on an ordinary host and, where there are two, on a rejected one."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_symbol_percent: tuple[int, int] = (10, 4)
    max_dup_line_percent: tuple[int, int] = (50, 20)
    max_mean_word_chars: tuple[int, int] = (25, 15)
    max_host_rate: float = 0.5


DEFAULT_RULES = Rules()


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def with_measures(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with the measures of each whole text (null counts as empty), as longs.

    n_words, word_chars, n_symbols, n_lines and n_dup_lines (lines with a word;
    those equal to an earlier one), n_repeat_words (words inside some window of
    eight words that the text has twice or more). Columns of the same name are
    replaced; ``prefix`` goes before each name.

    Windows are compared by a 64-bit hash within one text. Only texts that have
    a repeated window sort theirs. Each step below names the arrays it uses
    twice, so that the optimiser computes them once.
    """
    p = prefix
    t, words, codes, windows, tagged, starts, lines = (f"__{n}" for n in ("t", "words", "codes", "windows", "tagged", "starts", "lines"))
    width = F.lit(WINDOW)

    def window_hash(i: Column) -> Column:
        return F.xxhash64(F.slice(F.col(codes), i, width))

    def repeated(e: Column, j: Column) -> Column:
        before = F.get(F.col(tagged), j - 1)["h"]
        after = F.get(F.col(tagged), j + 1)["h"]
        return F.coalesce(before == e["h"], F.lit(False)) | F.coalesce(after == e["h"], F.lit(False))

    def cover(acc: Column, s: Column) -> Column:
        return F.struct(
            (acc["n"] + width - F.greatest(acc["end"] - s, F.lit(0))).alias("n"), (s + width).alias("end")
        )

    nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return (
        df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
        .withColumn(words, F.array_remove(F.split(t, WHITE_RUN), ""))
        .withColumn(lines, F.filter(F.split(t, "\n"), lambda line: line.rlike(NOT_WHITE)))
        .withColumn(f"{p}n_words", F.size(words).cast("long"))
        .withColumn(f"{p}word_chars", F.length(_without(F.col(t), WHITE)).cast("long"))
        .withColumn(f"{p}n_symbols", (F.length(t) - F.length(_without(F.col(t), SYMBOLS))).cast("long"))
        .withColumn(f"{p}n_lines", F.size(lines).cast("long"))
        .withColumn(f"{p}n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
        .withColumn(codes, F.transform(words, lambda w: F.xxhash64(w)))
        .withColumn(
            windows,
            F.when(F.size(codes) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(codes) - (WINDOW - 1)), window_hash)).otherwise(
                F.array().cast("array<bigint>")
            ),
        )
        .withColumn(
            tagged,
            F.when(
                F.size(F.array_distinct(windows)) < F.size(windows),
                F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            ),
        )
        .withColumn(starts, F.sort_array(F.transform(F.filter(tagged, repeated), lambda e: e["i"])))
        .withColumn(
            f"{p}n_repeat_words",
            F.coalesce(F.aggregate(starts, nothing, cover)["n"], F.lit(0)).cast("long"),
        )
        .drop(t, words, codes, windows, tagged, starts, lines)
    )


def with_failures(df: DataFrame, rules: Rules = DEFAULT_RULES, prefix: str = "") -> DataFrame:
    """Adds base_failed (boolean), and soft_failures and strict_failures (long): rules failed at either limit."""

    def m(name: str) -> Column:
        return F.col(f"{prefix}{name}")

    def failures(strict: int) -> Column:
        failed = [
            100 * m("n_symbols") > rules.max_symbol_percent[strict] * m("word_chars"),
            100 * m("n_dup_lines") > rules.max_dup_line_percent[strict] * m("n_lines"),
            m("word_chars") > rules.max_mean_word_chars[strict] * m("n_words"),
        ]
        return sum((f.cast("long") for f in failed), F.lit(0).cast("long"))

    base = (m("n_words") < rules.min_words) | (100 * m("n_repeat_words") > rules.max_repeat_percent * m("n_words"))
    return (
        df.withColumn(f"{prefix}base_failed", base)
        .withColumn(f"{prefix}soft_failures", failures(0))
        .withColumn(f"{prefix}strict_failures", failures(1))
    )


def host_verdicts(df: DataFrame, host: Column, rules: Rules = DEFAULT_RULES, prefix: str = "") -> DataFrame:
    """One row per host: ``host, n_documents, n_failed, host_rejected``; a null host is one host.

    The prior's mean is the corpus failure rate m and its strength s is fitted
    by moments: the variance v of host rates, weighted by documents, gives
    s = m(1-m)/v - 1, at least 1. Without variance every host has the corpus
    rate. A host is rejected if (failed + m s) / (documents + s) exceeds the
    limit. Only m and v, one row, come to the driver.
    """
    failed = (F.col(f"{prefix}base_failed") | (F.col(f"{prefix}soft_failures") > 0)).cast("long")
    hosts = df.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum(failed).alias("n_failed"))
    n, f = F.col("n_documents"), F.col("n_failed")
    fit = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff")).first()
    mean = fit["f"] / fit["n"] if fit["n"] else 0.0
    variance = fit["ff"] / fit["n"] - mean * mean if fit["n"] else 0.0
    if variance > 1e-12:
        strength = max(1.0, mean * (1 - mean) / variance - 1)
        rate = (f + F.lit(mean * strength)) / (n + F.lit(strength))
    else:
        rate = F.lit(mean)
    return hosts.select("host", n, f, (rate > rules.max_host_rate).alias("host_rejected"))


def judged(df: DataFrame, host: str = "source", text: str = "text", rules: Rules = DEFAULT_RULES, prefix: str = "__q_") -> DataFrame:
    """``df`` with measures, failures, ``host_rejected`` and ``kept``, each named after ``prefix``.

    kept: no base rule failed and none at the limits of the document's host. Repeated rows are judged alike; an empty table
    gives an empty one.

    The measured rows and the host table are written once to the shared folder.
    Spark reads the latter's size there and broadcasts it only below its own
    threshold; otherwise it is a sort-merge join whose hot hosts adaptive
    execution splits.
    """
    measured = with_failures(with_measures(df, text, prefix), rules, prefix)
    return _with_verdicts(measured, host, rules, prefix)


def _with_verdicts(measured: DataFrame, host: str, rules: Rules, p: str) -> DataFrame:
    spark = measured.sparkSession
    rows_path, hosts_path = scratch_path(spark, "quality-rows"), scratch_path(spark, "quality-hosts")
    key = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))
    keyed = measured.withColumn(f"{p}host", key)
    keyed.write.parquet(rows_path)
    rows = spark.read.schema(keyed.schema).parquet(rows_path)
    host_verdicts(rows, F.col(f"{p}host"), rules, p).select(
        F.col("host").alias(f"{p}host"), F.col("host_rejected").alias(f"{p}host_rejected")
    ).write.parquet(hosts_path)
    joined = rows.join(spark.read.parquet(hosts_path), f"{p}host")
    failures = F.when(F.col(f"{p}host_rejected"), F.col(f"{p}strict_failures")).otherwise(F.col(f"{p}soft_failures"))
    kept = ~F.col(f"{p}base_failed") & (failures == 0)
    return joined.withColumn(f"{p}kept", kept).drop(f"{p}host")


def kept_documents(docs: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return judged(docs, rules=rules).filter("__q_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_report(documents: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Per document its measures, failures and verdict. Texts are dropped before the measured rows are written."""
    measured = with_failures(with_measures(documents.select("doc_id", "source", "text")), rules).drop("text")
    return _with_verdicts(measured, "source", rules, "").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "soft_failures", "strict_failures", "host_rejected",
    )

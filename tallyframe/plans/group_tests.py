"""Do groups differ? Tests from sums that merge and from distributed ranks.

A group is one row of counts and centred sums per column, however many rows it
has; tests add these rows up per column. Nothing but the means of the columns
comes to the driver, and the number of groups is not bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe import limits
from tallyframe.functions import col, numeric_columns
from tallyframe.functions.columns import as_double, unpivot
from tallyframe.functions.distributions import chi_square_tail, f_tail

from .ranks import join_by_value, rank_values
from .statistics import base_facts
from .storage import checkpointed

# Up to so many groups a value's rows are counted per group in one row, and its rank need not look for them again.
FEW_GROUPS = 24

RESULT = ("column", "test", "groups", "n", "statistic", "df1", "df2", "p_value")


def group_tests(df: DataFrame, by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, test, groups, n, statistic, df1, df2, p_value``: three rows per numeric column.

    anova: F under equal variances. welch: Welch's F, for two groups the square
    of his t; null if a group has one value or no spread. kruskal: H over
    average ranks, corrected for ties, with df1 degrees of freedom. Rows with a missing
    group or value are left out. With fewer than two groups, or nothing that
    varies, the statistic is null.
    """
    names = [c for c in numeric_columns(df, columns) if c != by]
    if not names:
        raise ValueError("no numeric column to test")
    kept = df.where(col(by).isNotNull() & ~F.coalesce(col(by).cast("string") == "NaN", F.lit(False)))
    values = {c: as_double(kept, c) for c in names}
    facts = base_facts(kept, names)
    sums = _moment_sums(kept, by, {c: values[c] - F.lit(facts[c].mean).cast("double") for c in names})
    largest = max(f.count for f in facts.values())
    # Groups of these types come back from the driver as the same values.
    plain = isinstance(kept.schema[by].dataType, (T.StringType, T.BooleanType, T.IntegralType, T.DateType))
    found = [r["g"] for r in sums.select("g").distinct().limit(FEW_GROUPS + 1).collect()] if plain else []
    few = 0 < len(found) <= FEW_GROUPS
    ranks = _rank_sums_few(kept, by, values, largest, found) if few else _rank_sums(kept, by, values, largest)
    place = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i))])
    out = _anova(sums).unionByName(_welch(sums)).unionByName(_kruskal(ranks))
    statistic, df1 = F.col("statistic"), F.col("df1")
    tail = F.when(F.col("test") == "kruskal", chi_square_tail(statistic, df1)).otherwise(f_tail(statistic, df1, F.col("df2")))
    out = checkpointed(out).withColumn("p_value", F.when(statistic.isNotNull(), tail))  # a few rows per column
    return out.orderBy(place[F.col("column")], "test").select(*RESULT)


def _moment_sums(df: DataFrame, by: str, centred: dict[str, Column]) -> DataFrame:
    """``column, g, n, s, q``: per group the values, their sum and squared sum about the column's mean."""
    blocks, names, size = [], list(centred), limits.FUSED_COLUMNS
    for i in range(0, len(names), size):
        flat = df.select(col(by).alias("g"), *[centred[c].alias(f"v{k}") for k, c in enumerate(names[i : i + size])])
        each = [
            F.struct(F.lit(c).alias("column"), F.count(v := F.col(f"v{k}")).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
            for k, c in enumerate(names[i : i + size])
        ]
        blocks.append(flat.groupBy("g").agg(F.array(*each).alias("all")).select("g", F.inline("all")))
    out = blocks[0]
    for more in blocks[1:]:
        out = out.unionByName(more)
    return checkpointed(out.where("n > 0"))


def _result(rows: DataFrame, test: str, statistic: Column, df1: Column, df2: Column) -> DataFrame:
    return rows.select(
        "column",
        F.lit(test).alias("test"),
        F.col("k").alias("groups"),
        F.col("total").alias("n"),
        statistic.alias("statistic"),
        df1.cast("double").alias("df1"),
        df2.cast("double").alias("df2"),
    )


def _anova(sums: DataFrame) -> DataFrame:
    per = sums.groupBy("column").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("total"),
        (F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")).alias("between"),
        F.sum(F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))).alias("within"),
        F.sum("q").alias("q"),
    )
    k, n = F.col("k"), F.col("total")
    spread = (k > 1) & (n > k) & (F.col("within") > F.col("q") * 1e-14)
    return _result(per, "anova", F.when(spread, F.col("between") / (k - 1) / (F.col("within") / (n - k))), k - 1, n - k)


def _welch(sums: DataFrame) -> DataFrame:
    n, s = F.col("n"), F.col("s")
    within = F.col("q") - s * s / n
    variance = F.when((n > 1) & (within > F.col("q") * 1e-14), within / (n - 1))
    rows = sums.withColumn("m", s / n).withColumn("w", n / variance)
    w, m, f = F.col("w"), F.col("m"), F.col("n") - 1
    per = rows.groupBy("column").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("total"),
        F.count("w").alias("usable"),
        F.sum(w).alias("W"),
        F.sum(w * m).alias("wm"),
        F.sum(w * m * m).alias("wmm"),
        # The sum of (1 - w / W)^2 / (n - 1), in parts that add up before W is known.
        F.sum(F.when(f > 0, 1 / f)).alias("f0"),
        F.sum(F.when(f > 0, w / f)).alias("f1"),
        F.sum(F.when(f > 0, w * w / f)).alias("f2"),
    )
    k, total_w = F.col("k"), F.col("W")
    lack = F.col("f0") - 2 * F.col("f1") / total_w + F.col("f2") / (total_w * total_w)
    between = (F.col("wmm") - F.col("wm") * F.col("wm") / total_w) / (k - 1)
    usable = (k > 1) & (F.col("usable") == k)
    statistic = F.when(usable, F.greatest(between, F.lit(0.0)) / (1 + 2 * (k - 2) / (k * k - 1) * lack))
    return _result(per, "welch", statistic, k - 1, F.when(usable, (k * k - 1) / (3 * lack)))


def _rank_sums(df: DataFrame, by: str, values: dict[str, Column], largest: int) -> DataFrame:
    """``column, g, n, r, t``: per group the values and the sum of their average ranks; t adds up to the column's ties."""
    cells = unpivot(df, values, [by]).groupBy("column", col(by).alias("g"), "value").agg(F.count(F.lit(1)).alias("n"))
    cells = checkpointed(cells)
    counts = cells.groupBy("column", "value").agg(F.sum("n").alias("w"))
    ranks = checkpointed(rank_values(counts, ["column"], largest))
    total = ranks.count()  # decides whether the ranks are broadcast
    ranked = ranks.withColumn("rank", F.col("before") + (F.col("w") + 1) / 2).withColumn("whole", F.col("w"))
    placed = join_by_value(cells, ranked, [("column", "column"), ("value", "value")], {"rank": "rank", "whole": "whole"}, largest * len(values), total)
    n, w = F.col("n").cast("double"), F.col("whole").cast("double")
    # Each of the w equal values brings w^2 - 1, together w^3 - w.
    return placed.groupBy("column", "g").agg(F.sum("n").alias("n"), F.sum(n * F.col("rank")).alias("r"), F.sum(n * (w * w - 1)).alias("t"))


def _rank_sums_few(df: DataFrame, by: str, values: dict[str, Column], largest: int, groups: Sequence) -> DataFrame:
    """As ``_rank_sums``, with a column of counts per group next to each value."""
    kind = df.schema[by].dataType
    counts = (
        unpivot(df, values, [by])
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("w"), *[F.count(F.when(col(by) == F.lit(g).cast(kind), 1)).alias(f"n{k}") for k, g in enumerate(groups)])
    )
    rank, w = F.col("before") + (F.col("w") + 1) / 2, F.col("w").cast("double")
    each = []
    for k in range(len(groups)):
        n = F.col(f"n{k}").cast("double")
        each += [F.sum(f"n{k}").alias(f"n{k}"), F.sum(n * rank).alias(f"r{k}"), F.sum(n * (w * w - 1)).alias(f"t{k}")]
    sums = rank_values(counts, ["column"], largest).groupBy("column").agg(*each)
    rows = [F.struct(F.lit(g).cast(kind).alias("g"), *[F.col(f"{c}{k}").alias(c) for c in "nrt"]) for k, g in enumerate(groups)]
    return sums.select("column", F.inline(F.array(*rows))).where("n > 0")


def _kruskal(ranks: DataFrame) -> DataFrame:
    per = ranks.groupBy("column").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("rr"), F.sum("t").alias("t")
    )
    k, n = F.col("k"), F.col("total").cast("double")
    tied = 1 - F.col("t") / (n * n * n - n)
    h = F.when((k > 1) & (n > 1) & (tied > 1e-14), (12 / (n * (n + 1)) * F.col("rr") - 3 * (n + 1)) / tied)
    return _result(per, "kruskal", F.greatest(h, F.when(h.isNotNull(), F.lit(0.0))), k - 1, F.lit(None))


def crosstab(df: DataFrame, a: str, b: str, zeros: bool = False) -> DataFrame:
    """``a, b, n, row_total, column_total, total, expected, residual`` for each pair of values that some row has.

    Cells, both margins and the total come from one aggregate by grouping sets;
    missing values are left out. Long form, so the number of values is not
    bounded. ``zeros`` adds the pairs that no row has; the values of ``b`` must be
    within ``spark.sql.pivotMaxValues`` then. ``residual`` is (n - expected) / sqrt(expected).
    """
    cells, rows, columns, total = _margins(df, a, b)
    if zeros:
        most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        values = [r["_b"] for r in columns.select("_b").limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError(f"{b} has more than {most} values")
        every = F.explode(F.array(*[F.lit(v) for v in values])) if values else F.lit(None)
        cells = rows.select("_a", every.alias("_b")).join(cells, ["_a", "_b"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    met = cells.join(rows, "_a").join(columns, "_b")
    expected = F.col("row_total") * F.col("column_total") / F.lit(total)
    return met.select(
        F.col("_a").alias(a),
        F.col("_b").alias(b),
        "n",
        "row_total",
        "column_total",
        F.lit(total).cast("long").alias("total"),
        expected.alias("expected"),
        ((F.col("n") - expected) / F.sqrt(expected)).alias("residual"),
    )


def _margins(df: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Cells, rows and columns with their numbers, and the total."""
    flat = df.select(col(a).alias("_a"), col(b).alias("_b")).dropna()
    sets = flat.groupingSets([["_a", "_b"], ["_a"], ["_b"], []], "_a", "_b").agg(F.count(F.lit(1)).alias("n"), F.grouping_id("_a", "_b").alias("_level"))
    sets = checkpointed(sets)
    cells, rows, columns, total = (sets.where(F.col("_level") == level) for level in (0, 1, 2, 3))
    whole = total.first()
    return (
        cells.select("_a", "_b", "n"),
        rows.select("_a", F.col("n").alias("row_total")),
        columns.select("_b", F.col("n").alias("column_total")),
        whole["n"] if whole else 0,
    )


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """``column_a, column_b, n, statistic, df, p_value, cramers_v`` of the independence of two columns; one row.

    Cells without rows are never made: their share of the statistic is what the
    expected counts of the others leave of the total.
    """
    cells, rows, columns, total = _margins(df, a, b)
    r, c = rows.count(), columns.count()
    expected = F.col("row_total") * F.col("column_total") / F.lit(total)
    n, e = F.col("n"), F.col("e")
    met = cells.join(rows, "_a").join(columns, "_b").withColumn("e", expected)
    found = met.agg((F.sum((n - e) * (n - e) / e) + F.lit(total) - F.sum("e")).alias("x"))
    known = r > 1 and c > 1
    statistic = F.greatest("x", F.lit(0.0)) if known else F.lit(None).cast("double")
    with_statistic = found.select(statistic.alias("statistic"), F.lit(float((r - 1) * (c - 1)) if known else None).cast("double").alias("df"))
    return with_statistic.select(
        F.lit(a).alias("column_a"),
        F.lit(b).alias("column_b"),
        F.lit(total).cast("long").alias("n"),
        "statistic",
        "df",
        F.when(F.col("statistic").isNotNull(), chi_square_tail(F.col("statistic"), F.col("df"))).alias("p_value"),
        F.sqrt(F.col("statistic") / F.lit(total * max(min(r, c) - 1, 1) or 1)).alias("cramers_v"),
    )

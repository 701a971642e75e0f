"""Correlation of many columns: Pearson, Spearman and Kendall's tau-b.

Results are long, ``col_a, col_b, r``, and hold both halves of the matrix and
the diagonal. Pairs use the rows where both values are present.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe import limits
from tallyframe.functions import numeric_columns
from tallyframe.functions.columns import as_double, columns_of, known

from .rank_correlation import rank_correlation
from .statistics import base_facts

METHODS = ("pearson", "spearman", "kendall")

# What every method returns: positions of the two columns and their r.
PAIRS = "i int, j int, r double"


def correlation_matrix(
    df: DataFrame,
    method: str = "pearson",
    columns: Sequence[str] | None = None,
    min_corr: float = 0.0,
    one_task: int | None = None,
) -> DataFrame:
    """``col_a, col_b, r`` for all ordered pairs; r under ``min_corr`` becomes 0."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    names = numeric_columns(df, columns)
    if not names:
        raise ValueError("no numeric column to correlate")
    half = upper_triangle(df, names, method, one_task)
    both = half.select(
        F.inline(
            F.when(
                F.col("i") == F.col("j"), F.array(F.struct("i", "j", "r"))
            ).otherwise(
                F.array(
                    F.struct("i", "j", "r"),
                    F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "r"),
                )
            )
        )
    )
    labels = F.array(*[F.lit(n) for n in names])
    r = F.col("r")
    if min_corr > 0:
        r = F.when(F.abs(r) >= min_corr, r).otherwise(F.lit(0.0))
    return both.select(labels[F.col("i")].alias("col_a"), labels[F.col("j")].alias("col_b"), r.alias("r"))


def upper_triangle(
    df: DataFrame, names: Sequence[str], method: str, one_task: int | None = None
) -> DataFrame:
    """``i, j, r`` for i <= j by position in ``names``."""
    if method == "pearson":
        if len(names) <= limits.PAIRWISE_CORR_COLUMNS:
            return _pearson_fused(df, names)
        return _pearson_wide(df, names)
    return rank_correlation(df, names, method, one_task)


def _clamped(r: Column) -> Column:
    """Into [-1, 1]; greatest() and least() alone would turn a missing r into a bound."""
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _pearson_fused(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Centred sums and products, all in one aggregate of plain sums.

    A first pass finds the means and which columns have gaps. Sums of a
    column are shared by its pairs where neither has gaps.
    """
    facts = base_facts(df, names)
    whole = [facts[n].count == facts[n].row_count for n in names]
    rows = max((f.row_count for f in facts.values()), default=0)
    pairs = list(combinations(range(len(names)), 2))
    aggs: dict[str, str] = {}
    keys: dict[tuple[int, int], list[str]] = {}
    for i, j in pairs:
        if whole[i] and whole[j]:
            aggs |= {f"s{k}": f"sum(d{k})" for k in (i, j)} | {f"ss{k}": f"sum(d{k} * d{k})" for k in (i, j)}
            keys[i, j] = [f"s{i}", f"s{j}", f"ss{i}", f"ss{j}"]
        else:
            both = f"case when d{i} is not null and d{j} is not null then {{}} end"
            parts = {"n": "1", "x": f"d{i}", "y": f"d{j}", "xx": f"d{i} * d{i}", "yy": f"d{j} * d{j}"}
            aggs |= {f"{k}{i}_{j}": f"sum({both.format(e)})" for k, e in parts.items()}
            keys[i, j] = [f"{k}{i}_{j}" for k in parts if k != "n"]
        aggs[f"p{i}_{j}"] = f"sum(d{i} * d{j})"
    got = {}
    if aggs:
        centred = df.select(
            [(as_double(df, n) - F.lit(facts[n].mean).cast("double")).alias(f"d{i}") for i, n in enumerate(names)]
        )
        got = centred.selectExpr(*[f"{e} as {k}" for k, e in aggs.items()]).first().asDict()
    out = [(i, i, 1.0 if facts[n].varies else None) for i, n in enumerate(names)]
    for i, j in pairs:
        n = rows if whole[i] and whole[j] else got[f"n{i}_{j}"]
        out.append((i, j, _r_from_sums(n, *[got[k] for k in keys[i, j]], got[f"p{i}_{j}"])))
    return df.sparkSession.createDataFrame(out, PAIRS)


def _r_from_sums(n, x, y, xx, yy, xy) -> float | None:
    """r from sums of centred values; missing without spread beyond rounding."""
    if not n or n < 2 or xy is None:
        return None
    vx, vy = xx - x * x / n, yy - y * y / n
    if not (vx > xx * 1e-14 and vy > yy * 1e-14):
        return None
    return max(-1.0, min(1.0, (xy - x * y / n) / math.sqrt(vx) / math.sqrt(vy)))


def _pearson_wide(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Masked Gram sums per task for wide tables, centred beforehand for stability."""
    k = len(names)
    facts = base_facts(df, names)
    centers = np.array([facts[n].mean if facts[n].mean is not None else 0.0 for n in names])
    rows = df.select([as_double(df, n).alias(f"c{i}") for i, n in enumerate(names)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - centers
            gaps = np.isnan(x)
            if gaps.any():
                there = (~gaps).astype(float)
                x[gaps] = 0.0
                total[0] += there.T @ there
                total[1] += x.T @ there
                total[2] += (x * x).T @ there
            else:
                # Without gaps these sums are alike for every partner.
                total[0] += len(x)
                total[1] += x.sum(axis=0)[:, None]
                total[2] += (x * x).sum(axis=0)[:, None]
            total[3] += x.T @ x
        arrays = [pa.array(np.arange(k, dtype="int32")), *[pa.array(list(m)) for m in total]]
        yield pa.RecordBatch.from_arrays(arrays, ["i", "n", "s", "p", "q"])

    partial = rows.mapInArrow(sums, "i int, n array<double>, s array<double>, p array<double>, q array<double>")
    cells = partial.select("i", F.posexplode(F.arrays_zip("n", "s", "p", "q")).alias("j", "m")).select(
        "i", "j", "m.n", "m.s", "m.p", "m.q"
    )
    cells = cells.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in "nspq"])
    # Sums for j over the rows where i is present sit at the mirrored cell.
    mirror = cells.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("s").alias("sj"), F.col("p").alias("pj"))
    n = F.col("n")
    vx, vy = F.col("p") - F.col("s") * F.col("s") / n, F.col("pj") - F.col("sj") * F.col("sj") / n
    spread = (n > 1) & (vx > F.col("p") * 1e-14) & (vy > F.col("pj") * 1e-14)
    r = F.when(spread, _clamped((F.col("q") - F.col("s") * F.col("sj") / n) / F.sqrt(vx) / F.sqrt(vy)))
    return (
        cells.join(mirror, ["i", "j"])
        .where(F.col("i") <= F.col("j"))
        .select("i", "j", F.when(F.col("i") == F.col("j"), F.when(r.isNotNull(), F.lit(1.0))).otherwise(r).alias("r"))
    )


def strong_pairs(matrix: DataFrame, names: Sequence[str], threshold: float = 0.7, max_pairs: int | None = None) -> DataFrame:
    """Pairs of different columns with ``|r|`` at or over the threshold, strongest first."""
    place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    rows = (
        matrix.where(place[F.col("col_a")] < place[F.col("col_b")])
        .where(F.abs("r") >= threshold)
        .orderBy(F.abs("r").desc(), "col_a", "col_b")
    )
    return rows if max_pairs is None else rows.limit(max_pairs)


def strong_correlations(
    df: DataFrame,
    method: str = "pearson",
    threshold: float = 0.7,
    max_pairs: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    names = numeric_columns(df, columns)
    return strong_pairs(correlation_matrix(df, method, names), names, threshold, max_pairs)


def strong_matrix(
    df: DataFrame, method: str = "pearson", threshold: float = 0.7, columns: Sequence[str] | None = None
) -> DataFrame:
    """The part of the matrix between columns that have at least one strong partner."""
    matrix = correlation_matrix(df, method, columns)
    strong = matrix.where((F.col("col_a") != F.col("col_b")) & (F.abs("r") >= threshold))
    partners = strong.groupBy("col_a").agg(F.lit(1).alias("_one")).select(F.col("col_a").alias("_name"))
    kept = F.broadcast(partners)  # at most one row per column
    return matrix.join(kept, F.col("col_a") == F.col("_name"), "left_semi").join(
        kept, F.col("col_b") == F.col("_name"), "left_semi"
    )


def wide_matrix(matrix: DataFrame, names: Sequence[str], digits: int = 3) -> DataFrame:
    """One row per column, one r per partner, rounded."""
    cells = [F.round(F.max(F.when(F.col("col_b") == n, F.col("r"))), digits).alias(n) for n in names]
    return matrix.groupBy(F.col("col_a").alias("column")).agg(*cells)


def heatmap(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "pearson",
    min_corr: float = 0.0,
) -> DataFrame:
    """Lower triangle without the diagonal, over rows where every column is present."""
    allowed = columns_of(df, "integer", "float", "timedelta")
    names = allowed if columns is None else [c for c in known(df, columns) if c in allowed]
    whole = df.select([as_double(df, n).alias(n) for n in names]).dropna()
    matrix = correlation_matrix(whole, method, names, min_corr)
    place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    return matrix.where(place[F.col("col_a")] > place[F.col("col_b")])

"""Which columns are missing together.

A row's missing columns are a bitmap, and equal bitmaps are counted in the scan
tasks; from there on only distinct bitmaps matter. Patterns that hold *at
least* a set of columns are mined as closed sets: a set that no further column
could join without losing rows. They are grown by closure extension: each
closed set is reached from one other only, so no set of subsets is ever written
out, and each round is one pass over the distinct bitmaps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import is_missing, known

from .statistics import pct
from .storage import scratch_path

# Closed sets that one pass extends: their bitmaps travel with the task.
SETS_PER_PASS = 2_000

# Cells of the bitmaps x sets matrix that a task holds.
MATCH_CELLS = 20_000_000


def _bitmaps(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``bits, rows``: one character per column, 1 where it is missing, and the rows that have them."""
    bits = F.concat(*[F.when(is_missing(df, c), "1").otherwise("0") for c in names])
    return df.select(bits.alias("bits")).groupBy("bits").agg(F.count(F.lit(1)).alias("rows"))


def _names_of(bits: str, names: Sequence[str]):
    labels = F.array(*[F.lit(n) for n in names])
    return F.filter(labels, lambda _, i: F.substring(F.col(bits), i + 1, F.lit(1)) == "1")


def missing_patterns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``columns, missing_columns, rows, pct``: the columns that are missing in a row, and the rows that miss just these.

    Rows without gaps are the pattern of no columns. NaN counts as missing. An
    empty table has no patterns.
    """
    names = df.columns if columns is None else known(df, columns)
    if not names:
        raise ValueError("no column to look at")
    counted = _bitmaps(df, names)
    total = df.count()
    listed = counted.select(_names_of("bits", names).alias("columns"), "rows")
    return listed.select("columns", F.size("columns").cast("long").alias("missing_columns"), "rows", pct(F.col("rows"), F.lit(total)).alias("pct"))


def missing_together(df: DataFrame, columns: Sequence[str] | None = None, min_share: float = 0.01) -> DataFrame:
    """``columns, missing_columns, rows, pct``: closed sets of columns that are all missing in ``min_share`` of the rows or more.

    ``rows`` miss these columns and maybe others; no further column is missing
    in all of them. Sets of one column are included, the empty one is not.
    """
    if not 0 < min_share <= 1:
        raise ValueError("min_share must be over 0 and at most 1")
    names = df.columns if columns is None else known(df, columns)
    if not names:
        raise ValueError("no column to look at")
    spark = df.sparkSession
    path = scratch_path(spark, "missing-bitmaps")
    _bitmaps(df, names).write.parquet(path)
    bitmaps = spark.read.parquet(path)
    total = bitmaps.agg(F.sum("rows")).first()[0] or 0
    found: list[tuple[str, int]] = []
    # A set of no columns stands for all rows; what it is closed to is missing everywhere.
    open_sets = [("0" * len(names), -1)]
    first = True
    while open_sets:
        grown: list[tuple[str, int]] = []
        for i in range(0, len(open_sets), SETS_PER_PASS):
            for parent, column, bits, rows in _extensions(bitmaps, open_sets[i : i + SETS_PER_PASS], len(names), min_share * total, first):
                # Reached from this set only if nothing before the new column was added.
                if column < 0 or bits[:column] == parent[:column]:
                    grown.append((bits, column))
                    if "1" in bits:
                        found.append((bits, rows))
        # The first round only closes the set of all rows.
        open_sets, first = grown, False
    rows = spark.createDataFrame(found, "bits string, rows long")
    listed = rows.select(_names_of("bits", names).alias("columns"), "rows")
    return listed.select("columns", F.size("columns").cast("long").alias("missing_columns"), "rows", pct(F.col("rows"), F.lit(total)).alias("pct"))


def _extensions(
    bitmaps: DataFrame, sets: Sequence[tuple[str, int]], k: int, least: float, close_only: bool
) -> list[tuple[str, int, str, int]]:
    """``parent, column, closure, rows`` of every set grown by a column after its own, with ``least`` rows or more."""
    parents = np.array([[c == "1" for c in bits] for bits, _ in sets])
    cores = [core for _, core in sets]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closure: dict[tuple[int, int], np.ndarray] = {}
        rows: dict[tuple[int, int], int] = {}
        step = max(1, MATCH_CELLS // max(1, len(parents) * k))
        for batch in batches:
            bits = np.frombuffer("".join(batch.column(0).to_pylist()).encode(), dtype=np.uint8).reshape(-1, k) == 0x31
            weight = batch.column(1).to_numpy()
            for first in range(0, len(bits), step):
                part, w = bits[first : first + step], weight[first : first + step]
                # A set is in a bitmap if none of its columns is present there.
                within = (~part).astype(np.int32) @ parents.T.astype(np.int32) == 0
                for s, parent in enumerate(parents):
                    own = part[within[:, s]]
                    if not len(own):
                        continue
                    ow = w[within[:, s]]
                    for column in [-1] if close_only else np.flatnonzero(~parent & (np.arange(k) > cores[s]) & own.any(axis=0)).tolist():
                        having = own if column < 0 else own[own[:, column]]
                        key = (s, column)
                        both = having.all(axis=0)
                        closure[key] = closure[key] & both if key in closure else both
                        rows[key] = rows.get(key, 0) + int((ow if column < 0 else ow[own[:, column]]).sum())
        keys = list(closure)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([s for s, _ in keys], pa.int32()),
                pa.array([c for _, c in keys], pa.int32()),
                pa.array(["".join("1" if b else "0" for b in closure[key]) for key in keys], pa.string()),
                pa.array([rows[key] for key in keys], pa.int64()),
            ],
            names=["parent", "column", "bits", "rows"],
        )

    merged = bitmaps.mapInArrow(grow, "parent int, column int, bits string, rows long").groupBy("parent", "column").agg(
        F.sum("rows").alias("rows"), *[F.min(F.substring("bits", i + 1, 1)).alias(f"b{i}") for i in range(k)]
    )
    out = []
    for r in merged.where(F.col("rows") >= least).collect():  # as many as there are sets and columns
        out.append((sets[r["parent"]][0], r["column"], "".join(r[f"b{i}"] for i in range(k)), r["rows"]))
    return sorted(out)

"""Spearman and Kendall's tau-b over many columns with gaps, without a row per pair of columns.

A pair uses the rows where both columns are present, so a value's rank in one
column depends on the other. It depends only on *where* the other is present:
columns that are missing in the same rows form a class, and columns without
gaps are one class. Sorted once per column, its values carry one running counter
per class, and so get their ranks for every pair at once.

Spearman needs both ranks of a row side by side: each value takes the ranks of
its column along (one exchange by value) and goes back to its row (one by row).

Kendall needs no ranks. Each column's values are cut into blocks of bounded
size; a block comes to one task together with the other columns of its rows.
Two rows in the same block of the first column are compared there. Two rows
in different blocks of it but the same block of the second are compared in
that one. For all others the numbers of the blocks tell the order, and counts
per pair of blocks do.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe import limits
from tallyframe.functions.columns import as_double, unpivot
from tallyframe.shipping import ship_package

from .bins import balanced_cuts
from .ranks import join_by_value, rank_values
from .storage import checkpointed, scratch_path

PAIRS = "i int, j int, r double"

# Values that one task of a Kendall block may hold.
BLOCK_CELLS = 8_000_000

# A column of so many different values at most is cut at each of them.
FEW_VALUES = 256

# Of the table of numbered rows.
ROW_GROUP_BYTES = 8 << 20

# Block pairs are compared digit by digit: 16 values per digit.
DIGIT_BITS = 4


def rank_correlation(df: DataFrame, names: Sequence[str], method: str, one_task: int | None = None) -> DataFrame:
    """``i, j, r`` for i <= j by position in ``names``."""
    ship_package(df.sparkSession)
    one_task = limits.ONE_TASK_ROWS if one_task is None else one_task
    values = [as_double(df, n) for n in names]
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(v).alias(f"{k}{i}") for i, v in enumerate(values) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))],
    ).first()
    size, rows = len(values), facts["rows"]
    varies = [bool(facts[f"n{i}"]) and facts[f"lo{i}"] < facts[f"hi{i}"] for i in range(size)]
    diagonal = [(i, i, 1.0 if varies[i] else None) for i in range(size)]
    pairs = [(i, j) for i in range(size) for j in range(i + 1, size)]
    if not pairs or not rows:
        return df.sparkSession.createDataFrame(diagonal + [(i, j, None) for i, j in pairs], PAIRS)
    if method == "spearman":
        found = _spearman(df, values, [facts[f"n{i}"] for i in range(size)], rows, one_task)
    else:
        ranges = {i: (facts[f"lo{i}"], facts[f"hi{i}"]) for i in range(size) if facts[f"n{i}"]}
        found = _kendall(df, values, ranges, rows, one_task)
    return df.sparkSession.createDataFrame(diagonal + [(i, j, found.get((i, j))) for i, j in pairs], PAIRS)


# --- Spearman ----------------------------------------------------------------------------------


def presence_classes(df: DataFrame, values: Sequence[Column], present: Sequence[int], rows: int) -> list[int]:
    """The class of each column: equal exactly when the columns are missing in the same rows; 0 is without gaps.

    Only columns with as many values can be in one class; those are compared, each
    with the first of every class of that number.
    """
    classes = [0 if n == rows else -1 for n in present]
    heads: list[int] = []
    while -1 in classes:
        # The first open column of every number of values heads a class; the others of that number are held against it.
        new = {n: i for i, n in reversed(list(enumerate(present))) if classes[i] == -1}
        tests = [(i, new[n]) for i, n in enumerate(present) if classes[i] == -1 and new[n] != i]
        apart = df.agg(*[F.count(F.when(values[i].isNull() != values[h].isNull(), 1)).alias(f"c{k}") for k, (i, h) in enumerate(tests)]).first() if tests else []
        for h in new.values():
            heads.append(h)
            classes[h] = len(heads)
        for k, (i, h) in enumerate(tests):
            if not apart[k]:
                classes[i] = classes[h]
    return classes


def class_counts(wide: DataFrame, size: int, heads: Sequence[int]) -> DataFrame:
    """``column, value, w, p1, p2...``: the rows of the value, and those of them where each class but the first is present.

    ``heads`` has a column of every class but the first. Equal values are folded
    in the scan tasks, together with their counters.
    """
    flags = {f"p{c}": F.col(f"v{h}").isNotNull().cast("int") for c, h in enumerate(heads, start=1)}
    keyed = wide.select("*", *[f.alias(c) for c, f in flags.items()])
    return (
        unpivot(keyed, {str(i): F.col(f"v{i}") for i in range(size)}, list(flags))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("w"), *[F.sum(c).alias(c) for c in flags])
    )


def class_ranks(counts: DataFrame, classes: int, largest: int, one_task: int) -> DataFrame:
    """``column, value, w, ranks``: per class, the average rank of the value among the rows where the class is present."""
    flags = [f"p{c}" for c in range(1, classes)]
    ranked = rank_values(counts, ["column"], largest, one_task=one_task, also=flags)
    counters, before = ["w", *flags], ["before", *[f"before_{c}" for c in flags]]
    return ranked.select(
        F.col("column").cast("int").alias("column"),
        "value",
        "w",
        F.array(*[F.col(b) + (F.col(c) + 1) / 2 for b, c in zip(before, counters, strict=True)]).alias("ranks"),
    )


def _spearman(
    df: DataFrame, values: Sequence[Column], present: Sequence[int], rows: int, one_task: int
) -> dict[tuple[int, int], float | None]:
    size, spark = len(values), df.sparkSession
    classes = presence_classes(df, values, present, rows)
    heads = [classes.index(c) for c in range(1, max(classes) + 1)]
    wide = df.select([v.alias(f"v{i}") for i, v in enumerate(values)])
    counts = checkpointed(class_counts(wide, size, heads))
    kinds = [0] * size
    for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per column
        kinds[int(r["column"])] = r["n"]
    small = _small_columns(kinds, len(heads) + 1)
    large = [i for i in range(size) if i not in small]
    if large:
        # Row numbers have to stay the same for every later pass, so the rows are written with them.
        path = scratch_path(spark, "numbered-rows")
        # Small row groups, so that later passes split whatever the input's files were like.
        wide.select(F.monotonically_increasing_id().alias("row"), "*").write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        wide = spark.read.parquet(path)
    ranks = class_ranks(counts, len(heads) + 1, max(kinds), one_task)
    if large:
        ranks = checkpointed(ranks)
    tables = _lookup_tables(ranks.where(F.col("column").isin(small)) if large else ranks, small, len(heads) + 1)
    if large:
        long = unpivot(wide, {str(i): F.col(f"v{i}") for i in large}, ["row"]).withColumn("column", F.col("column").cast("int"))
        ranks = ranks.where(F.col("column").isin(large))
        entries = join_by_value(long, ranks, [("column", "column"), ("value", "value")], {"ranks": "ranks"}, rows * len(large), sum(kinds[i] for i in large))
        entries = entries.select("row", "column", "ranks")
        if small:
            plain = F.array(*[F.coalesce(F.col(f"v{i}"), F.lit(float("nan"))) for i in small])
            entries = entries.unionByName(wide.select("row", F.lit(-1).alias("column"), plain.alias("ranks")))
        partial = _sums_by_row(entries, tables, classes)
    else:
        partial = _sums_by_lookup(wide, tables, classes)
    sums = partial.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    found = {}
    for s in sums.collect():  # one row per pair of columns
        n = s["n"]
        xx, yy, xy = s["xx"] - s["x"] ** 2 / n, s["yy"] - s["y"] ** 2 / n, s["xy"] - s["x"] * s["y"] / n
        spread = xx > s["xx"] * 1e-14 and yy > s["yy"] * 1e-14
        found[s["i"], s["j"]] = max(-1.0, min(1.0, xy / math.sqrt(xx) / math.sqrt(yy))) if spread else None
    return found


_SUMS = "i int, j int, n long, x double, y double, xx double, yy double, xy double"


class _PairSums:
    """Sums over rows of the two ranks of every pair, from ranks per row, column and class (NaN where missing)."""

    def __init__(self, classes: Sequence[int]):
        self.classes = np.array(classes)
        self.members = [np.flatnonzero(self.classes == c) for c in range(max(classes) + 1)]
        k = len(classes)
        self.n, self.x, self.xx, self.xy = np.zeros((k, k), dtype=np.int64), np.zeros((k, k)), np.zeros((k, k)), np.zeros((k, k))
        # Rows at a time, so that rows x columns x classes stays bounded.
        self.step = max(1, 2_000_000 // (k * len(self.members)))

    def add(self, ranks: np.ndarray) -> None:
        """Of a pair i, j, column i takes its ranks among the rows where j's class is present: one product per class, or two."""
        for first in range(0, len(ranks), self.step):
            part = ranks[first : first + self.step]
            there = (~np.isnan(part[:, :, 0])).astype(float)
            known = np.where(there[:, :, None] > 0, part, 0.0)
            known = [np.ascontiguousarray(known[:, :, c]) for c in range(len(self.members))]
            self.n += (there.T @ there).astype(np.int64)
            for of_class, to in zip(known, self.members, strict=True):
                self.x[:, to] += of_class.T @ there[:, to]
                self.xx[:, to] += (of_class * of_class).T @ there[:, to]
                for other, own in zip(known, self.members, strict=True):
                    self.xy[np.ix_(own, to)] += of_class[:, own].T @ other[:, to]

    def batch(self) -> pa.RecordBatch:
        i, j = np.triu_indices(len(self.classes), 1)
        i, j = i[self.n[i, j] > 0], j[self.n[i, j] > 0]
        columns = [i.astype(np.int32), j.astype(np.int32), self.n[i, j], self.x[i, j], self.x[j, i], self.xx[i, j], self.xx[j, i], self.xy[i, j]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "n", "x", "y", "xx", "yy", "xy"])


def _small_columns(kinds: Sequence[int], classes: int) -> list[int]:
    """Columns of few distinct values, as long as the ranks of all of them may go to every task."""
    small, total = [], 0
    for n, i in sorted((n, i) for i, n in enumerate(kinds)):
        total += n * classes
        if total > limits.BROADCAST_ROWS:
            break
        small.append(i)
    return sorted(small)


# The sorted values of a column and their ranks per class.
Lookup = dict[int, tuple[np.ndarray, np.ndarray]]


def _lookup_tables(ranks: DataFrame, small: Sequence[int], classes: int) -> Lookup:
    if not small:
        return {}
    found = ranks.toArrow()
    column, value = (found.column(c).to_numpy() for c in ("column", "value"))
    matrix = np.array(found.column("ranks").to_pylist(), dtype=float).reshape(-1, classes)
    tables = {}
    for i in small:
        own = np.flatnonzero(column == i)
        own = own[np.argsort(value[own])]
        tables[i] = value[own], matrix[own]
    return tables


def _look_up(x: np.ndarray, table: tuple[np.ndarray, np.ndarray], classes: int) -> np.ndarray:
    known, ranks = table
    out = np.full((len(x), classes), np.nan)
    there = ~np.isnan(x)
    out[there] = ranks[np.searchsorted(known, x[there])]
    return out


def _sums_by_lookup(wide: DataFrame, tables: Lookup, classes: Sequence[int]) -> DataFrame:
    """Every column is in the lookup tables; rows stay where they are."""
    deep = max(classes) + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _PairSums(classes)
        for batch in batches:
            ranks = [_look_up(batch.column(i).to_numpy(zero_copy_only=False), tables[i], deep) for i in range(len(classes))]
            total.add(np.stack(ranks, axis=1))
        yield total.batch()

    return wide.mapInArrow(sums, _SUMS)


def _sums_by_row(entries: DataFrame, tables: Lookup, classes: Sequence[int]) -> DataFrame:
    """``row, column, ranks`` brought together by row: at most one entry per large column, and in column -1 the values of the small ones."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = _PairSums(classes), []
        for batch in batches:
            rows = batch.column(0).to_numpy()
            starts = np.flatnonzero(rows[1:] != rows[:-1]) + 1
            if held and rows[0] != held[-1].column(0)[-1].as_py():
                starts = np.concatenate([[0], starts])
            if len(starts):
                total.add(_rows_of([*held, batch.slice(0, starts[-1])], tables, classes))
                held, batch = [], batch.slice(starts[-1])
            held.append(batch)
        if held:
            total.add(_rows_of(held, tables, classes))
        yield total.batch()

    return entries.repartition("row").sortWithinPartitions("row").mapInArrow(sums, _SUMS)


def _rows_of(parts: list[pa.RecordBatch], tables: Lookup, classes: Sequence[int]) -> np.ndarray:
    """Ranks per row, column and class of whole rows."""
    deep = max(classes) + 1
    table = pa.Table.from_batches(parts)
    rows, columns = table.column(0).to_numpy(), table.column(1).to_numpy()
    at = np.cumsum(np.diff(rows, prepend=rows[:1]) != 0)
    out = np.full((at[-1] + 1 if len(at) else 0, len(classes), deep), np.nan)

    def lists(which: np.ndarray, width: int) -> np.ndarray:
        return table.column(2).filter(pa.array(which)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    ranked = columns >= 0
    out[at[ranked], columns[ranked]] = lists(ranked, deep)
    if tables:
        plain = lists(~ranked, len(tables))
        for k, i in enumerate(sorted(tables)):
            out[at[~ranked], i] = _look_up(plain[:, k], tables[i], deep)
    return out


# --- Kendall -----------------------------------------------------------------------------------


# Numbers of a run that are compared place by place.
_MERGED_FROM = 32


def inversions(order: np.ndarray) -> int:
    """Pairs in which a greater number stands before a smaller one. Numbers are not negative.

    Short runs are compared place by place; then sorted runs are put together
    in twos, with the lowest bit to tell the right one. The places of a right
    run's numbers tell how many of the left one stand before them.
    """
    if len(order) < 2:
        return 0
    top = int(order.max())
    kind = np.int32 if top < 2**30 - 1 else np.int64
    size = _MERGED_FROM
    x = np.full(-(-len(order) // size) * size, top + 1, dtype=kind)
    x[: len(order)] = order
    x = x.reshape(-1, size)
    found = sum(int(np.count_nonzero(x[:, :-s] > x[:, s:])) for s in range(1, size))
    x.sort(axis=1)
    while len(x) > 1:
        if len(x) % 2:
            x = np.concatenate([x, np.full((1, size), top + 1, dtype=kind)])
        both = x.reshape(-1, 2 * size) << 1
        both[:, size:] |= 1
        both.sort(axis=1)
        places = int((both & 1).sum(axis=0, dtype=np.int64) @ np.arange(2 * size))
        before = places - len(both) * (size * (size - 1) // 2)
        found += len(both) * size * size - before
        x, size = both >> 1, 2 * size
    return found


def _tied(counts: np.ndarray) -> float:
    counts = counts.astype(float)
    return float((counts * (counts - 1) / 2).sum())


def _owns(c: int, d: int, size: int) -> bool:
    """Each pair of columns is owned by one of the two, and each column owns as many pairs as the others, or one less."""
    ahead = (d - c) % size
    return 0 < ahead and (2 * ahead < size or (2 * ahead == size and c < d))


def block_of(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Even: strictly between two cuts. Odd: at a cut, so that all values of the block are equal. -1: missing."""
    place = np.searchsorted(cuts, values)
    at_cut = cuts[np.minimum(place, len(cuts) - 1)] == values if len(cuts) else np.zeros(len(values), dtype=bool)
    return np.where(np.isnan(values), -1, 2 * place + at_cut)


_SUMMED = ("n", "disc", "tie_i", "tie_j", "tie_both")


def _part_row(c: int, d: int, n: float, disc: float, tie_c: float, tie_both: float) -> tuple:
    return (c, d, n, disc, tie_c, 0.0, tie_both) if c < d else (d, c, n, disc, 0.0, tie_c, tie_both)


def _compare(a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Discordant pairs of two columns of whole numbers; ``b`` and number of the different pairs of values."""
    kinds_a, kinds_b = int(a.max()) + 1, int(b.max()) + 1
    if kinds_a * kinds_b <= 2 * len(a):
        table = np.bincount(a * kinds_b + b, minlength=kinds_a * kinds_b).reshape(kinds_a, kinds_b)
        smaller = np.cumsum(table, axis=0) - table  # rows of a smaller a, by b
        found = int((table * (smaller.sum(axis=1, keepdims=True) - np.cumsum(smaller, axis=1))).sum())
        places = np.flatnonzero(table)
        return found, places % kinds_b, table.ravel()[places]
    key = np.sort(a * kinds_b + b)
    firsts = np.flatnonzero(np.diff(key, prepend=-1))
    # The column of fewer values is the one to count in.
    found = inversions(np.sort(b * kinds_a + a) % kinds_a if kinds_a < kinds_b else key % kinds_b)
    return found, key[firsts] % kinds_b, np.diff(np.append(firsts, len(key)))


Cells = tuple[int, int, np.ndarray, np.ndarray, np.ndarray]


def _block_rows(c: int, p: int, x: list[np.ndarray], blocks: list[np.ndarray], cuts: list[np.ndarray]) -> tuple[list[tuple], list[Cells]]:
    """What block ``p`` of column ``c`` says about every pair with ``c``, and its counts by the other's blocks."""
    size = len(cuts)
    sums, cells = [], []
    # Any numbers in the order of the values will do; missing values are left out below.
    own = np.unique(x[c], return_inverse=True)[1]
    for d in range(size):
        there = np.flatnonzero(~np.isnan(x[d]))
        if d == c or not len(there):
            continue
        a, at = own[there], blocks[d][there]
        owner = _owns(c, d, size)
        if not owner and not len(cuts[c]):
            # One block: all is compared by the owner, but for the ties here.
            sums.append(_part_row(c, d, 0.0, 0.0, _tied(np.bincount(a)), 0.0))
            continue
        # Rows in one block of the owner were compared there. Of the others, the blocks tell all.
        disc, kinds, equal = _compare(a, np.unique(x[d][there], return_inverse=True)[1] if owner else at)
        # Equal rows are counted by the owner, or here where they are at a cut of the other column and not of this one.
        both = _tied(equal if owner else equal[kinds % 2 == 1])
        sums.append(_part_row(c, d, float(len(a)) if owner else 0.0, float(disc), _tied(np.bincount(a)), both))
        if owner and len(cuts[c]):
            places, counts = np.unique(at, return_counts=True)
            cells.append((c, d, np.full(len(places), p), places, counts))
    return sums, cells


# Rows that a task counts at a time, and cells that it keeps before it hands them over.
_COUNTED_ROWS = 1 << 18
_KEPT_CELLS = 1 << 21


class _PointCells:
    """Rows per pair of blocks of two columns, of which the first is a single value."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts = cuts
        self.kinds = [2 * len(k) + 1 for k in cuts]
        self.parts: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        self.kept = 0

    def add(self, columns: list[np.ndarray]) -> None:
        blocks = [block_of(x, k) for x, k in zip(columns, self.cuts, strict=True)]
        for c, at in enumerate(blocks):
            single = np.flatnonzero((at >= 0) & (at % 2 == 1))
            if not len(single):
                continue
            for d, other in enumerate(blocks):
                if d == c:
                    continue
                p, q = at[single], other[single]
                key = (p * self.kinds[d] + q)[q >= 0]
                if len(key):
                    self.parts.setdefault((c, d), []).append(_counted(key, None, self.kinds[c] * self.kinds[d]))
                    self.kept += len(self.parts[c, d][-1][0])

    def fold(self) -> None:
        for (c, d), parts in self.parts.items():
            if len(parts) > 1:
                keys, counts = (np.concatenate([part[k] for part in parts]) for k in (0, 1))
                self.parts[c, d] = [_counted(keys, counts, self.kinds[c] * self.kinds[d])]
        self.kept = sum(len(part[0][0]) for part in self.parts.values())

    def take(self) -> list[Cells]:
        self.fold()
        found = [(c, d, *np.divmod(keys, self.kinds[d]), counts) for (c, d), [(keys, counts)] in self.parts.items()]
        self.parts, self.kept = {}, 0
        return found


def _counted(keys: np.ndarray, counts: np.ndarray | None, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys and the sums of their counts."""
    if kinds <= _COUNTED_ROWS:
        total = np.bincount(keys, counts, kinds)
        places = np.flatnonzero(total)
        return places, total[places].astype(np.int64)
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    firsts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[firsts], np.add.reduceat(counts[order], firsts)


def few_values(df: DataFrame, values: dict[int, Column]) -> dict[int, np.ndarray]:
    """The sorted values of the columns that have ``FEW_VALUES`` at most; a task looks no further once it has seen more."""
    names = list(values)
    flat, most = df.select([v.alias(f"v{i}") for i, v in values.items()]), FEW_VALUES

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {k: np.zeros(0) for k in range(len(names))}
        over: list[int] = []
        for batch in batches:
            for k in list(kept):
                x = batch.column(k).drop_null().to_numpy(zero_copy_only=False)
                kept[k] = np.unique(np.concatenate([kept[k], x[~np.isnan(x)] + 0.0]))
                if len(kept[k]) > most:
                    del kept[k]
                    over.append(k)
        rows = [(k, float(x)) for k, found in kept.items() for x in found] + [(k, None) for k in over]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64())], names=["k", "value"])

    found: dict[int, set] = {k: set() for k in range(len(names))}
    rows = flat.mapInArrow(seen, "k int, value double").distinct().groupBy("k")
    # A column that some task has found too many values in, or all tasks together, sends none.
    sets = rows.agg(F.collect_set("value").alias("values"), F.max(F.col("value").isNull()).alias("over"), F.count(F.lit(1)).alias("n"))
    for r in sets.select("k", F.when(~F.col("over") & (F.col("n") <= most), F.col("values")).alias("values")).collect():
        found[r["k"]] = r["values"]
    return {names[k]: np.array(sorted(v), dtype=float) for k, v in found.items() if v}


_BLOCK = "i int, j int, " + ", ".join(f"{f} double" for f in _SUMMED) + ", owner int, p int, q int, w long"


def _kendall(
    df: DataFrame, values: Sequence[Column], ranges: dict[int, tuple[float, float]], rows: int, one_task: int
) -> dict[tuple[int, int], float | None]:
    size, spark = len(values), df.sparkSession
    per_block = max(2, min(one_task, BLOCK_CELLS // size))
    cuts = [np.zeros(0)] * size
    if rows > per_block:
        most = float(np.finfo(float).max)
        few = few_values(df, {i: values[i] for i in ranges})
        for i, found in few.items():  # every value is a cut: none of their rows has to move
            cuts[i] = found
        finite = {str(i): (max(low, -most), min(high, most)) for i, (low, high) in ranges.items() if i not in few}
        for i, found in balanced_cuts(df, {i: values[int(i)] for i in finite}, finite, per_block).items():
            cuts[int(i)] = found
    wide = df.select([v.alias(f"v{i}") for i, v in enumerate(values)])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row once per column that is present and not at a cut, with that column's block."""
        for batch in batches:
            x = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for c in range(size):
                block = block_of(x[c], cuts[c])
                keep = np.flatnonzero((block >= 0) & (block % 2 == 0))
                if len(keep):
                    columns = [pa.array(v[keep], from_pandas=True) for v in x]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keep), c, dtype=np.int32)), pa.array(block[keep].astype(np.int32)), *columns],
                        names=["c", "block", *[f"v{i}" for i in range(size)]],
                    )

    def compared(key: tuple, table: pa.Table) -> pa.Table:
        c, p = key[0].as_py(), key[1].as_py()
        x = [table.column(f"v{i}").to_numpy().astype(float, copy=False) for i in range(size)]
        return pa.Table.from_batches(list(_batches(*_block_rows(c, p, x, [block_of(v, k) for v, k in zip(x, cuts, strict=True)], cuts))))

    def at_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task, the pairs of blocks whose first is a single value, and their rows."""
        cells, held, n = _PointCells(cuts), [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False).astype(float, copy=False) for c in batch.columns])
            n += batch.num_rows
            if n >= _COUNTED_ROWS:
                cells.add([np.concatenate(v) for v in zip(*held, strict=True)])
                held, n = [], 0
                if cells.kept > _KEPT_CELLS:
                    cells.fold()
                if cells.kept > _KEPT_CELLS // 2:
                    yield from _batches([], cells.take())
        if held:
            cells.add([np.concatenate(v) for v in zip(*held, strict=True)])
        yield from _batches([], cells.take())

    deal_schema = "c int, block int, " + ", ".join(f"v{i} double" for i in range(size))
    local = wide.mapInArrow(dealt, deal_schema).groupBy("c", "block").applyInArrow(compared, _BLOCK)
    cells = None
    if any(len(k) for k in cuts):
        path = scratch_path(spark, "kendall-blocks")
        local.write.parquet(path)
        local = spark.read.schema(_BLOCK).parquet(path)
        points = wide.mapInArrow(at_cuts, _BLOCK).groupBy("i", "j", "owner", "p", "q").agg(F.sum("w").alias("w"))
        cells = checkpointed(
            local.where("w IS NOT NULL").select("i", "j", "owner", "p", "q", "w").unionByName(points)
        )
    parts = [local.where("w IS NULL").select("i", "j", *_SUMMED)]
    if cells is not None:
        parts += _cell_parts(cells, size, max(map(len, cuts)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return {(r["i"], r["j"]): _tau_b(*r[2:]) for r in out.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMMED]).collect()}


_KINDS = [pa.int32(), pa.int32(), *[pa.float64()] * 5, pa.int32(), pa.int32(), pa.int32(), pa.int64()]
_NAMES = ["i", "j", *_SUMMED, "owner", "p", "q", "w"]


def _batches(sums: list[tuple], cells: Iterable[Cells]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_BLOCK``: sums have no cell, cells no sums."""
    given = list(zip(*sums, strict=True)) or [[]] * 7
    columns = [*given, *[[None] * len(sums)] * 4]
    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, _KINDS, strict=True)], names=_NAMES)
    for c, d, p, q, w in cells:
        n = len(w)
        fixed = [min(c, d), max(c, d), *[0.0] * 5, c]
        columns = [pa.array(np.full(n, v), k) for v, k in zip(fixed, _KINDS, strict=False)]
        columns += [pa.array(v.astype(t)) for v, t in ((p, np.int32), (q, np.int32), (w, np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _cell_parts(cells: DataFrame, size: int, most_cuts: int) -> list[DataFrame]:
    """What the counts per pair of blocks add: rows at cuts, ties of those, and pairs of rows apart in both columns.

    ``owner, p`` is the column whose block ``p`` was counted, which owns the pair if ``p`` is even.
    """
    c = F.col("owner")
    d = F.when(c == F.col("i"), F.col("j")).otherwise(F.col("i"))
    ahead = F.pmod(d - c, F.lit(size))
    owns = (2 * ahead < size) | ((2 * ahead == size) & (c < d))
    single, other_single = F.col("p") % 2 == 1, F.col("q") % 2 == 1
    w = F.col("w").cast("double")
    tied = lambda x: x * (x - 1) / 2
    none = F.lit(0.0)
    fields = lambda **given: [given.get(f, none).alias(f) for f in _SUMMED]

    rows = cells.where(single & owns).select("i", "j", *fields(n=w, tie_both=F.when(other_single, tied(w)).otherwise(none)))
    by_value = cells.where(single).groupBy("i", "j", "owner", "p").agg(F.sum(w).alias("x"))
    of = lambda side: F.when(c == F.col(side), tied(F.col("x"))).otherwise(none)
    ties = by_value.select("i", "j", *fields(tie_i=of("i"), tie_j=of("j")))
    disc = _discordant_cells(cells.where(owns), 2 * most_cuts + 1).select("i", "j", *fields(disc=F.col("disc")))
    return [rows, ties, disc]


def _discordant_cells(cells: DataFrame, largest: int) -> DataFrame:
    """``i, j, disc``: pairs of rows whose blocks differ in both columns, in opposite directions.

    Two numbers first differ at some hexadecimal digit. For each digit place,
    blocks q that share all higher digits form a group; inside it, walking up
    in p, a cell with digit d is discordant with every earlier row of a greater
    digit. A group has at most one folded row per block of the owner.
    """
    base = 1 << DIGIT_BITS
    levels = max(1, math.ceil(largest.bit_length() / DIGIT_BITS))
    group = "i, j, level, prefix"

    def listed(template: str, digits: Iterable[int] = range(base)) -> str:
        return ", ".join(template.format(d=d) for d in digits)

    terms = " + ".join(f"cast(d{d} AS double) * ({' + '.join(f'e{g}' for g in range(d + 1, base))})" for d in range(base - 1))
    return cells.sparkSession.sql(
        f"""
        WITH leveled AS (
            SELECT i, j, w, p, level, shiftright(q, level * {DIGIT_BITS}) & {base - 1} AS digit, shiftright(q, (level + 1) * {DIGIT_BITS}) AS prefix
            FROM {{cells}} LATERAL VIEW explode(sequence(0, {levels - 1})) AS level),
        folded AS (
            SELECT {group}, p, {listed("sum(CASE WHEN digit = {d} THEN w ELSE 0 END) AS d{d}")} FROM leveled GROUP BY {group}, p),
        walked AS (
            SELECT {group}, {listed("d{d}")}, {listed("coalesce(sum(d{d}) OVER walk, 0) AS e{d}", range(1, base))} FROM folded
            WINDOW walk AS (PARTITION BY {group} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT i, j, sum({terms}) AS disc FROM walked GROUP BY i, j
        """,
        cells=cells,
    )


def _tau_b(n: float, disc: float, tie_i: float, tie_j: float, tie_both: float) -> float | None:
    total = n * (n - 1) / 2
    if not (total > tie_i and total > tie_j):
        return None
    tau = (total - tie_i - tie_j + tie_both - 2 * disc) / (math.sqrt(total - tie_i) * math.sqrt(total - tie_j))
    return max(-1.0, min(1.0, tau))

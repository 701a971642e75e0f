"""Counting the values of many columns in bins, as vectors that tasks sum up.

One pass serves all columns and all ranges of them: a task sorts each batch of a
column, reads off how many values fall into each bin and the least and greatest
of them, and gives out one vector per column. Vectors are added up per column,
so what moves is one row per task and column, whatever the rows hold, and what
comes to the driver is one vector per column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.shipping import ship_package

#: Bins of one range.
BINS = 2_048

#: Narrowing rounds at most; what is left after them is ranked value by value, or stays one block.
ROUNDS = 12

Range = tuple[float, float]

_VECTORS = "column int, counts array<long>, least array<double>, most array<double>"


@dataclass
class Bins:
    """Per bin the number of values, the least and the greatest. First and last: below and above all ranges."""

    counts: np.ndarray
    least: np.ndarray
    most: np.ndarray

    @classmethod
    def empty(cls, ranges: int) -> Bins:
        n = ranges * BINS + 2
        return cls(np.zeros(n, dtype=np.int64), np.full(n, np.inf), np.full(n, -np.inf))

    def add(self, counts: np.ndarray, least: np.ndarray, most: np.ndarray) -> None:
        self.counts += counts
        np.minimum(self.least, least, out=self.least)
        np.maximum(self.most, most, out=self.most)

    def take(self, values: np.ndarray, ranges: list[Range]) -> None:
        """Count values, which are not NaN. A bin's place grows with the value, so bins of sorted values are runs."""
        values = np.sort(values)
        self._run(values[: np.searchsorted(values, ranges[0][0], side="left")], np.zeros(0), 0)
        self._run(values[np.searchsorted(values, ranges[-1][1], side="right") :], np.zeros(0), len(self.counts) - 1)
        for k, (low, high) in enumerate(ranges):
            inside = values[np.searchsorted(values, low, side="left") : np.searchsorted(values, high, side="right")]
            # Halves keep a range over all doubles from overflowing.
            width = high / 2 - low / 2
            place = (inside / 2 - low / 2) / width * BINS if width > 0 else np.zeros(len(inside))
            self._run(inside, np.minimum(place.astype(np.int64), BINS - 1), 1 + k * BINS)

    def _run(self, values: np.ndarray, place: np.ndarray, first: int) -> None:
        if not len(values):
            return
        place = place if len(place) else np.zeros(len(values), dtype=np.int64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        ends = np.concatenate([starts[1:], [len(values)]])
        at = first + place[starts]
        self.counts[at] += ends - starts
        self.least[at] = np.minimum(self.least[at], values[starts])
        self.most[at] = np.maximum(self.most[at], values[ends - 1])


def bin_counts(df: DataFrame, values: dict[str, Column], ranges: dict[str, list[Range]]) -> dict[str, Bins]:
    """Bins of the named columns over their ranges, which are sorted and apart. Missing values are not counted."""
    names = [n for n in ranges if ranges[n]]
    if not names:
        return {}
    ship_package(df.sparkSession)
    wanted = [[(float(a), float(b)) for a, b in ranges[n]] for n in names]
    flat = df.select([values[n].alias(f"v{i}") for i, n in enumerate(names)])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = [Bins.empty(len(r)) for r in wanted]
        for batch in batches:
            for b, r, column in zip(bins, wanted, batch.columns, strict=True):
                column = column.drop_null().to_numpy(zero_copy_only=False)
                b.take(column[~np.isnan(column)], r)
        yield _vectors(dict(enumerate(bins)))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Bins] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                i = batch.column(0)[row].as_py()
                total.setdefault(i, Bins.empty(len(wanted[i]))).add(*[batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in (1, 2, 3)])
        yield _vectors(total)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = flat.mapInArrow(counted, _VECTORS)
    rows = vectors.repartition(min(parts, len(names)), "column").mapInArrow(summed, _VECTORS).toArrow()
    found = {names[row["column"]]: row for row in rows.to_pylist()}
    return {n: Bins(np.array(r["counts"]), np.array(r["least"]), np.array(r["most"])) for n, r in found.items()}


def _vectors(bins: dict[int, Bins]) -> pa.RecordBatch:
    def lists(part: str) -> pa.Array:
        arrays = [getattr(b, part) for b in bins.values()]
        edges = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
        kind = np.int64 if part == "counts" else np.float64
        return pa.ListArray.from_arrays(edges, pa.array(np.concatenate(arrays) if arrays else np.zeros(0), pa.from_numpy_dtype(kind)))

    return pa.RecordBatch.from_arrays(
        [pa.array(list(bins), pa.int32()), lists("counts"), lists("least"), lists("most")],
        names=["column", "counts", "least", "most"],
    )


@dataclass
class Target:
    """A wanted position among a column's sorted values, and the range it is known to lie in."""

    position: float
    low: float
    high: float
    below: int  # values before the range
    inside: int
    found: tuple[float, float] | None = None  # the values at floor and ceil of the position

    def narrow(self, bins: Bins, place: int, first: bool) -> None:
        """To the bin of the position, or to the two values beside it where they are apart."""
        span = slice(0, len(bins.counts)) if first else slice(1 + place * BINS, 1 + (place + 1) * BINS)
        counts, least, most = bins.counts[span], bins.least[span], bins.most[span]
        upto = np.cumsum(counts)
        lower, upper = (int(np.searchsorted(upto, k - self.below, side="right")) for k in (np.floor(self.position), np.ceil(self.position)))
        if lower != upper or least[lower] == most[lower]:
            self.found = float(most[lower]), float(least[upper])
            return
        self.below += int(upto[lower] - counts[lower])
        self.low, self.high, self.inside = float(least[lower]), float(most[lower]), int(counts[lower])

    def value(self) -> float:
        part = self.position - np.floor(self.position)
        low, high = self.found
        return low if part == 0 else float(low * (1 - part) + high * part)


def narrowed(df: DataFrame, values: dict[str, Column], targets: dict[str, list[Target]], one_task: int) -> None:
    """Narrow all targets until each is found or at most ``one_task`` values are left in its range."""
    for turn in range(ROUNDS):
        still = {n: [t for t in ts if t.found is None and (turn == 0 or t.inside > one_task)] for n, ts in targets.items()}
        ranges = {n: sorted({(t.low, t.high) for t in ts}) for n, ts in still.items() if ts}
        if not ranges:
            return
        bins = bin_counts(df, values, ranges)
        for name, spans in ranges.items():
            for t in still[name]:
                t.narrow(bins[name], spans.index((t.low, t.high)), turn == 0)


def balanced_cuts(df: DataFrame, values: dict[str, Column], ranges: dict[str, Range], size: int) -> dict[str, np.ndarray]:
    """Per column sorted values that cut it so that at most ``size`` values lie strictly between two neighbours.

    Each cut is a value of the column. A range of bins that holds too many is
    cut into bins again, so only a single value can be held by more rows.
    """
    cuts: dict[str, set[float]] = {n: set() for n in values}
    open_ranges = {n: [r] for n, r in ranges.items()}
    for turn in range(ROUNDS):
        bins = bin_counts(df, values, open_ranges)
        open_ranges = {}
        for name, b in bins.items():
            full = 0
            if turn:  # what lies outside these ranges was counted before
                b.counts[[0, -1]] = 0
            for i in np.flatnonzero(b.counts):
                n, least, most = int(b.counts[i]), float(b.least[i]), float(b.most[i])
                if n > size:
                    cuts[name] |= {least, most}
                    if least < most and np.isfinite(least) and np.isfinite(most):
                        open_ranges.setdefault(name, []).append((least, most))
                    full = 0
                elif full + n > size:
                    cuts[name].add(least)
                    full = n
                else:
                    full += n
        if not open_ranges:
            break
    return {n: np.array(sorted(c)) for n, c in cuts.items()}

"""Outliers: rules are fitted on the whole table, then applied row by row.

Fitted rules are a few numbers per column. Applying them is a plain
projection and filter: it needs no shuffle and takes streaming tables too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import numeric_columns
from tallyframe.functions.columns import as_double, present, with_values
from tallyframe.plans.quantiles import table_quantiles
from tallyframe.plans.statistics import few_rows, per_column

METHODS = ("iqr", "zscore", "percentile")
STRATEGIES = ("remove", "clip", "replace_mean", "replace_median")


@dataclass(frozen=True)
class OutlierRule:
    """Values under ``lower`` or over ``upper`` are outliers of this column."""

    column: str
    lower: float | None
    upper: float | None
    clip_lower: float | None = None
    clip_upper: float | None = None
    replacement: float | None = None


@dataclass(frozen=True)
class OutlierRules:
    strategy: str
    rules: list[OutlierRule] = field(default_factory=list)

    SCHEMA = (
        "strategy string, `column` string, lower double, upper double, "
        "clip_lower double, clip_upper double, replacement double"
    )

    def is_outlier(self, df: DataFrame, rule: OutlierRule) -> Column:
        v = as_double(df, rule.column)
        if rule.lower is None or rule.upper is None:
            return F.lit(False)
        return F.coalesce((v < rule.lower) | (v > rule.upper), F.lit(False))

    def apply(self, df: DataFrame) -> DataFrame:
        active = [r for r in self.rules if r.lower is not None]
        if self.strategy == "remove":
            return reduce(lambda d, r: d.where(~self.is_outlier(df, r)), active, df)
        return with_values(df, {r.column: self._repaired(df, r) for r in active})

    def _repaired(self, df: DataFrame, rule: OutlierRule) -> Column:
        v = present(df, rule.column)
        if self.strategy == "clip":
            # Explicit tests: greatest() would turn a missing value into a bound.
            return (
                F.when(v < rule.clip_lower, F.lit(rule.clip_lower))
                .when(v > rule.clip_upper, F.lit(rule.clip_upper))
                .otherwise(v)
            )
        return F.when(self.is_outlier(df, rule), F.lit(rule.replacement)).otherwise(v)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (self.strategy, r.column, r.lower, r.upper, r.clip_lower, r.clip_upper, r.replacement) for r in self.rules
        ]
        return spark.createDataFrame(rows, self.SCHEMA)

    @staticmethod
    def from_frame(df: DataFrame) -> OutlierRules:
        rows = df.collect()  # one row per column
        rules = [
            OutlierRule(r["column"], r["lower"], r["upper"], r["clip_lower"], r["clip_upper"], r["replacement"])
            for r in rows
        ]
        return OutlierRules(rows[0]["strategy"] if rows else "remove", rules)


def _bounds(
    df: DataFrame, columns: Sequence[str], method: str, threshold: float, exact: bool
) -> dict[str, tuple[float | None, float | None, float | None, float | None]]:
    """Detection and clipping bounds per column."""
    if method in ("iqr", "percentile"):
        probs = [0.25, 0.75] if method == "iqr" else [threshold / 100, 1 - threshold / 100]
        found = table_quantiles(df, columns, probs, exact=exact)
        out = {}
        for c in columns:
            lo, hi = found[c][probs[0]], found[c][probs[1]]
            if lo is not None and method == "iqr":
                lo, hi = lo - threshold * (hi - lo), hi + threshold * (hi - lo)
            out[c] = (lo, hi, lo, hi)
        return out
    rows = per_column(
        df,
        columns,
        lambda c: {
            "mean": F.avg(as_double(df, c)),
            "pop": F.stddev_pop(as_double(df, c)),
            "samp": F.stddev_samp(as_double(df, c)),
        },
    ).collect()
    out = {}
    for r in rows:
        m, pop, samp = r["mean"], r["pop"], r["samp"]
        # No spread, no score: nothing is an outlier then.
        lo, hi = (m - threshold * pop, m + threshold * pop) if pop else (None, None)
        clip = (m - threshold * samp, m + threshold * samp) if samp else (None, None)
        out[r["column"]] = (lo, hi, *clip)
    return out


def fit_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "iqr",
    threshold: float = 1.5,
    strategy: str = "remove",
    sequential: bool = False,
    exact: bool = True,
) -> OutlierRules:
    """Work out bounds (and replacements) for numeric columns.

    With ``sequential`` each column's bounds are taken from the rows the
    columns before it have kept, which costs one pass per column; it only
    matters when rows are removed. Otherwise all bounds come from the input.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    names = numeric_columns(df, columns)
    if sequential and strategy == "remove":
        rules: list[OutlierRule] = []
        for c in names:
            kept = OutlierRules("remove", rules).apply(df)
            rules = [*rules, OutlierRule(c, *_bounds(kept, [c], method, threshold, exact)[c])]
        return OutlierRules(strategy, rules)

    bounds = _bounds(df, names, method, threshold, exact) if names else {}
    rules = [OutlierRule(c, *bounds[c]) for c in names]
    if strategy in ("replace_mean", "replace_median"):
        found = OutlierRules(strategy, rules)
        inliers = {r.column: F.when(~found.is_outlier(df, r), as_double(df, r.column)) for r in rules}
        if strategy == "replace_mean":
            got = per_column(df, names, lambda c: {"fill": F.avg(inliers[c])}).collect() if names else []
            fills = {r["column"]: r["fill"] for r in got}
        else:
            medians = table_quantiles(df, names, [0.5], exact=exact, values=inliers) if names else {}
            fills = {c: q[0.5] for c, q in medians.items()}
        rules = [OutlierRule(r.column, r.lower, r.upper, r.clip_lower, r.clip_upper, fills[r.column]) for r in rules]
    return OutlierRules(strategy, rules)


def handle_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "iqr",
    threshold: float = 1.5,
    strategy: str = "remove",
    sequential: bool = False,
    exact: bool = True,
) -> DataFrame:
    return fit_outliers(df, columns, method, threshold, strategy, sequential, exact).apply(df)


def outlier_counts(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 1.5, exact: bool = True
) -> DataFrame:
    """``column, q1, q3, outlier_count`` by the interquartile rule: one pass after the bounds."""
    names = numeric_columns(df, columns)
    quartiles = table_quantiles(df, names, [0.25, 0.75], exact=exact)
    rules = fit_from_quartiles(quartiles, threshold)
    counted = per_column(
        df, names, lambda c: {"outlier_count": F.count(F.when(rules.is_outlier(df, _rule(rules, c)), 1))}
    )
    bounds = few_rows(df, [(c, quartiles[c][0.25], quartiles[c][0.75]) for c in names], "`column` string, q1 double, q3 double")
    return counted.join(bounds, "column").orderBy("position").select("column", "q1", "q3", "outlier_count")


def fit_from_quartiles(quartiles: dict[str, dict[float, float | None]], threshold: float) -> OutlierRules:
    rules = []
    for c, q in quartiles.items():
        lo, hi = q[0.25], q[0.75]
        if lo is None:
            rules.append(OutlierRule(c, None, None))
        else:
            rules.append(OutlierRule(c, lo - threshold * (hi - lo), hi + threshold * (hi - lo)))
    return OutlierRules("remove", rules)


def _rule(rules: OutlierRules, column: str) -> OutlierRule:
    return next(r for r in rules.rules if r.column == column)

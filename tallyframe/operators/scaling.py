"""Scaling: a few fitted numbers per column, applied as plain arithmetic."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import numeric_columns
from tallyframe.functions.columns import as_double, with_values
from tallyframe.plans.quantiles import table_quantiles
from tallyframe.plans.statistics import per_column

METHODS = ("minmax", "zscore", "robust", "log")


@dataclass(frozen=True)
class ScalingRule:
    """``(x - center) / width * stretch + base``, or ``ln(x + shift)`` for the log method."""

    column: str
    center: float = 0.0
    width: float = 1.0
    stretch: float = 1.0
    base: float = 0.0
    shift: float = 0.0


@dataclass(frozen=True)
class ScalingRules:
    method: str
    rules: list[ScalingRule] = field(default_factory=list)

    SCHEMA = (
        "method string, `column` string, center double, width double, stretch double, base double, shift double"
    )

    def apply(self, df: DataFrame) -> DataFrame:
        def scaled(r: ScalingRule):
            v = as_double(df, r.column)
            if self.method == "log":
                return F.ln(v + F.lit(r.shift)) if r.shift else F.ln(v)
            out = (v - F.lit(r.center)) / F.lit(r.width)
            if self.method == "minmax":
                out = out * F.lit(r.stretch) + F.lit(r.base)
            return out

        return with_values(df, {r.column: scaled(r) for r in self.rules})

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.method, r.column, r.center, r.width, r.stretch, r.base, r.shift) for r in self.rules]
        return spark.createDataFrame(rows, self.SCHEMA)

    @staticmethod
    def from_frame(df: DataFrame) -> ScalingRules:
        rows = df.collect()  # one row per column
        rules = [
            ScalingRule(r["column"], r["center"], r["width"], r["stretch"], r["base"], r["shift"]) for r in rows
        ]
        return ScalingRules(rows[0]["method"] if rows else "minmax", rules)


def fit_scaling(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "minmax",
    custom_range: tuple[float, float] | None = None,
    exact: bool = True,
) -> ScalingRules:
    """Fit all columns in one pass. A column without spread is divided by 1."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    names = numeric_columns(df, columns)
    if not names:
        return ScalingRules(method)
    if method == "robust":
        found = table_quantiles(df, names, [0.25, 0.5, 0.75], exact=exact)
        return ScalingRules(
            method,
            [
                ScalingRule(c, found[c][0.5], (found[c][0.75] - found[c][0.25]) or 1.0)
                for c in names
                if found[c][0.5] is not None
            ],
        )
    rows = per_column(
        df,
        names,
        lambda c: {
            "lo": F.min(as_double(df, c)),
            "hi": F.max(as_double(df, c)),
            "mean": F.avg(as_double(df, c)),
            "pop": F.stddev_pop(as_double(df, c)),
        },
    ).collect()
    base, top = custom_range or (0.0, 1.0)
    rules = []
    for r in sorted(rows, key=lambda r: r["position"]):
        c, lo, hi = r["column"], r["lo"], r["hi"]
        if lo is None:
            continue
        if method == "minmax":
            rules.append(ScalingRule(c, lo, (hi - lo) or 1.0, float(top - base), float(base)))
        elif method == "zscore":
            rules.append(ScalingRule(c, r["mean"], r["pop"] if hi > lo else 1.0))
        else:
            rules.append(ScalingRule(c, shift=abs(lo) + 1 if lo <= 0 else 0.0))
    return ScalingRules(method, rules)


def normalize_data(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "minmax",
    custom_range: tuple[float, float] | None = None,
    exact: bool = True,
) -> DataFrame:
    return fit_scaling(df, columns, method, custom_range, exact).apply(df)

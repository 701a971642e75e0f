"""Calendar period ends used as labels by the resampler."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Period codes and the step between two periods.
PERIOD_STEPS = {
    "D": "interval 1 day",
    "W": "interval 7 days",
    "ME": "interval 1 month",
    "QE": "interval 3 months",
    "YE": "interval 1 year",
}

# Older spellings of the same periods.
PERIOD_ALIASES = {"M": "ME", "Q": "QE", "Y": "YE", "A": "YE"}


def period_end(day: Column, freq: str) -> Column:
    """Last day of the period holding ``day``; weeks end on Sunday."""
    if freq == "D":
        return day
    if freq == "W":
        return F.next_day(F.date_sub(day, 1), "SUN")
    if freq == "ME":
        return F.last_day(day)
    if freq == "QE":
        return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    if freq == "YE":
        return F.last_day(F.add_months(F.trunc(day, "year"), 11))
    raise ValueError(f"unknown period {freq!r}; use one of {sorted(PERIOD_STEPS)}")


def period_spine(first: Column, last: Column, freq: str) -> Column:
    """Array of every period end from ``first`` to ``last``.

    Stepping from a month's last day would drift (31 -> 30 -> 30), so the
    steps are taken from the first of the month and closed afterwards.
    """
    step = F.expr(PERIOD_STEPS[freq])
    if freq in ("D", "W"):
        return F.sequence(first, last, step)
    starts = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), step)
    return F.transform(starts, lambda d: F.last_day(d))

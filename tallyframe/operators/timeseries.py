"""Resampling a value over calendar periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import col, family
from tallyframe.functions.columns import as_double
from tallyframe.functions.parsing import to_moment
from tallyframe.functions.periods import PERIOD_ALIASES, PERIOD_STEPS, period_end, period_spine
from tallyframe.plans.storage import checkpointed

_AGGREGATES = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def resample(
    df: DataFrame, date_column: str, value_column: str, freq: str = "ME", agg_func: str = "mean"
) -> DataFrame:
    """``date, value`` per period from the first to the last, empty periods included.

    Periods: D, W (ending Sunday), ME, QE, YE. An empty period has sum and
    count 0 and no mean, minimum or maximum. Unknown functions mean the mean.
    Rows missing the date or the value are left out; text dates are parsed.
    """
    freq = PERIOD_ALIASES.get(freq, freq)
    if freq not in PERIOD_STEPS:
        raise ValueError(f"unknown period {freq!r}; use one of {sorted(PERIOD_STEPS)}")
    when = col(date_column)
    if family(df.schema[date_column].dataType) != "datetime":
        when = to_moment(when)
    points = df.select(when.cast("date").alias("_day"), as_double(df, value_column).alias("_value")).where(
        F.col("_day").isNotNull() & F.col("_value").isNotNull()
    )
    pick = _AGGREGATES.get(agg_func, F.avg)
    # Days first, combined map-side: the aggregate has one row per period.
    periods = points.groupBy(period_end(F.col("_day"), freq).alias("date")).agg(pick("_value").alias("value"))
    return fill_periods(periods, freq, agg_func in ("sum", "count"))


def fill_periods(periods: DataFrame, freq: str, zero: bool) -> DataFrame:
    """``date, value`` with a row for every period from the first to the last; new ones hold 0 or nothing."""
    # One row per period: fetched bounds keep the source from being read a second time for the spine.
    periods = checkpointed(periods)
    ends = periods.agg(F.min("date"), F.max("date")).first()
    spine = periods.sparkSession.range(1).select(F.explode(period_spine(F.lit(ends[0]).cast("date"), F.lit(ends[1]).cast("date"), freq)).alias("date"))
    value = F.col("value")
    if zero:
        value = F.coalesce(value, F.lit(0).cast(periods.schema["value"].dataType))
    return spine.join(periods, "date", "left").select("date", value.alias("value")).orderBy("date")

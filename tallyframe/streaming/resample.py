"""Resampling a stream: days are kept as mergeable states, periods are made of them whenever they are asked for.

A day's state (rows, sum, least, greatest) is closed, and written once, when the
watermark has passed it; until then it lies in the state store, from where it
can be read at any time. So a result needs no end of the stream, and any period
and aggregate comes from the same states.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import col, family
from tallyframe.functions.columns import as_double
from tallyframe.functions.parsing import to_moment
from tallyframe.functions.periods import PERIOD_ALIASES, PERIOD_STEPS, period_end
from tallyframe.operators.timeseries import fill_periods

_STATES = "day date, n long, total double, least double, most double"

# Batches of one run whose row counts are remembered.
_PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"
_BATCHES = 100_000


@dataclass(frozen=True)
class DayStates:
    """Where the closed days (``output``) and the open ones (``state``, a checkpoint folder) of a stream are."""

    spark: SparkSession
    output: str
    state: str

    def days(self) -> DataFrame:
        """``day, n, total, least, most``, one row per day with values, closed or open."""
        return self._closed().unionByName(self._open())

    def _closed(self) -> DataFrame:
        return self.spark.read.schema(_STATES).parquet(self.output)

    def _open(self) -> DataFrame:
        stored = self.spark.read.format("statestore").load(self.state)
        # The store keeps the buffers of the aggregates in their order.
        buffers = [F.col(f"value.`{f.name}`") for f in stored.schema["value"].dataType.fields]
        named = [b.cast(kind).alias(name) for b, (name, kind) in zip(buffers, (("n", "long"), ("total", "double"), ("least", "double"), ("most", "double")), strict=True)]
        return stored.select(F.col("key").getField(stored.schema["key"].dataType.fields[0].name).cast("date").alias("day"), *named)

    def kept(self) -> int:
        """Rows that are in some day."""
        return self.days().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def resampled(self, freq: str = "ME", agg_func: str = "mean") -> DataFrame:
        """``date, value`` per period, as ``operators.resample`` gives it for the same rows at rest."""
        freq = PERIOD_ALIASES.get(freq, freq)
        if freq not in PERIOD_STEPS:
            raise ValueError(f"unknown period {freq!r}; use one of {sorted(PERIOD_STEPS)}")
        merged = {"sum": F.sum("total"), "count": F.sum("n"), "min": F.min("least"), "max": F.max("most")}
        pick = merged.get(agg_func, F.sum("total") / F.sum("n"))
        periods = self.days().groupBy(period_end(F.col("day"), freq).alias("date")).agg(pick.alias("value"))
        return fill_periods(periods, freq, agg_func in ("sum", "count"))


def resample_stream(
    stream: DataFrame, date_column: str, value_column: str, output: str, state: str, lateness: str = "7 days"
) -> tuple[DayStates, int]:
    """Take in all that the stream has now; the states so far, and the rows of this run that came too late.

    A day takes rows until one that is ``lateness`` later was seen in an earlier batch;
    rows for closed days are dropped and counted. Rows missing the date or
    the value are left out and not counted. Run again with the same folders, it goes on
    where it stopped: what was taken in is never taken in twice.
    """
    spark = stream.sparkSession
    when = col(date_column)
    if family(stream.schema[date_column].dataType) != "datetime":
        when = to_moment(when)
    points = stream.select(when.cast("date").cast("timestamp").alias("_day"), as_double(stream, value_column).alias("_value"))
    points = points.where(F.col("_day").isNotNull() & F.col("_value").isNotNull())
    v = F.col("_value")
    days = (
        points.observe("points", F.count(F.lit(1)).alias("seen"))
        .withWatermark("_day", lateness)
        .groupBy("_day")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"))
        .select(F.col("_day").cast("date").alias("day"), "n", "total", "least", "most")
    )
    states = DayStates(spark, output, state)
    before = states.kept() if _has_run(spark, state) else 0
    remembered = spark.conf.get(_PROGRESS)
    spark.conf.set(_PROGRESS, str(_BATCHES))
    try:
        run = days.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(output)
        run.awaitTermination()
        seen = sum(p.observedMetrics["points"]["seen"] for p in run.recentProgress if "points" in p.observedMetrics)
    finally:
        spark.conf.set(_PROGRESS, remembered)
    return states, int(seen) - (states.kept() - before)


def _has_run(spark: SparkSession, state: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/commits")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)

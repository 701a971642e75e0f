"""A resampled stream against the same rows at rest."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tallyframe.operators import resample
from tallyframe.streaming import micro_batched_files, resample_stream

SCHEMA = "ts timestamp_ntz, v double, other string"


def write(spark, folder, name, rows):
    spark.createDataFrame([(t, v, "x") for t, v in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder):
    return micro_batched_files(spark, f"{folder}/*", spark.createDataFrame([], SCHEMA).schema)


def days_ago(n, hour=5):
    return dt.datetime(2024, 3, 31, hour) - dt.timedelta(days=n)


@pytest.mark.parametrize("freq, agg", [("D", "mean"), ("W", "sum"), ("ME", "count"), ("QE", "min"), ("YE", "max")])
def test_equals_the_table_at_rest(spark, tmp_path_factory, freq, agg, taken):
    states, late, rows = taken
    want = resample(rows, "ts", "v", freq, agg).collect()
    got = states.resampled(freq, agg).collect()
    assert [r["date"] for r in got] == [r["date"] for r in want]
    assert [r["value"] for r in got] == pytest.approx([r["value"] for r in want])
    assert late == 0


@pytest.fixture(scope="module")
def taken(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stream")
    rng = random.Random(4)
    rows = [(days_ago(rng.choice([0, 1, 2, 30, 31, 60, 200, 399]), rng.randrange(24)), rng.choice([None, float("nan"), rng.random()])) for _ in range(300)]
    rows += [(None, 1.0)]
    for i in range(4):
        write(spark, folder / "in", f"f{i}", rows[i::4])
    states, late = resample_stream(stream(spark, folder / "in"), "ts", "v", str(folder / "out"), str(folder / "state"), lateness="1000 days")
    return states, late, spark.createDataFrame([(t, v, "x") for t, v in rows], SCHEMA)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    """Five days open, then a step ahead closes all but the last; rows for closed days come too late."""
    write(spark, tmp_path / "in", "a", [(days_ago(n), 1.0) for n in (4, 3, 2, 1, 0)])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    states, late = resample_stream(stream(spark, tmp_path / "in"), "ts", "v", out, state, lateness="2 days")
    assert late == 0 and states.kept() == 5
    write(spark, tmp_path / "in", "b", [(days_ago(4), 9.0), (days_ago(4, 7), 9.0), (days_ago(3), 9.0), (days_ago(0), 1.0), (days_ago(-1), 1.0)])
    states, late = resample_stream(stream(spark, tmp_path / "in"), "ts", "v", out, state, lateness="2 days")
    assert late == 3 and states.kept() == 7
    assert [r["value"] for r in states.resampled("D", "sum").collect()] == [1.0, 1.0, 1.0, 1.0, 2.0, 1.0]
    again, late = resample_stream(stream(spark, tmp_path / "in"), "ts", "v", out, state, lateness="2 days")
    assert late == 0 and again.kept() == 7  # nothing is taken in twice

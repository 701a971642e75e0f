"""User functions over rows, columns and groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import col, known
from tallyframe.plans.storage import checkpointed


def apply_rows(
    df: DataFrame,
    func: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Apply a function to batches of rows and return what it returns.

    ``func`` gets a pandas frame with some of the rows and must treat each
    row on its own. ``columns`` names the ones it reads, so that only these
    are scanned and sent to Python.
    """
    rows = df.select([col(c) for c in known(df, columns)]) if columns else df

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield func(frame)

    return rows.mapInPandas(batches, schema)


def apply_columns(
    df: DataFrame, func: Callable[[Column], Column], columns: Sequence[str] | None = None
) -> DataFrame:
    """Apply a function to every column.

    ``func`` maps a Column to a Column. Returning an aggregate gives one row
    with a value per column, anything else a table of the same length.
    """
    names = known(df, columns) if columns else df.columns
    return df.select([func(col(n)).alias(n) for n in names])


# States from which a task merges what it has, and beyond which it hands them over; tasks from which groups merge in parts.
_FOLD_FROM = 20_000
_HAND_OVER = 100_000
_MANY_TASKS = 2_000
_PARTS = 64

#: Rows of a group from which on its states are made where its rows are. The rows of smaller groups are brought together.
LARGE_GROUP = 50_000


def merge_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    partial: Callable[[pd.DataFrame], dict[str, object]],
    state_schema: str,
    merge: Callable[[pd.DataFrame], dict[str, object]],
    finish: Callable[[pd.DataFrame], pd.DataFrame],
    result_schema: str,
) -> DataFrame:
    """A user's own aggregate, without bringing a whole group to one task.

    ``partial`` turns some rows of one group into a small state, ``merge``
    turns several states of a group (one per row) into one, and ``finish``
    turns a frame of merged states into result columns, row by row. The rows of
    a group over ``LARGE_GROUP`` rows never move: each task sends one state per
    group it met. Smaller groups, of which there may be many, come to one task
    each, so that ``partial`` runs once per group and not once per group and batch.
    """
    names = known(df, list(keys))
    key_schema = T.StructType([df.schema[k] for k in names])
    states = T.StructType(key_schema.fields + T._parse_datatype_string(state_schema).fields)
    results = T.StructType(key_schema.fields + T._parse_datatype_string(result_schema).fields)
    state_columns = [f.name for f in states.fields]
    result_columns = [f.name for f in results.fields]

    def fold(frame: pd.DataFrame, step: Callable[[pd.DataFrame], dict[str, object]]) -> pd.DataFrame:
        rows = [
            dict(zip(names, key, strict=True)) | step(group)
            for key, group in frame.groupby(names, dropna=False, sort=False)
        ]
        return pd.DataFrame(rows, columns=state_columns)

    def per_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # States are merged when their number has doubled, so that each takes part in few merges.
        waiting: list[pd.DataFrame] = []
        size, settled = 0, 0
        for frame in frames:
            if frame.empty:
                continue
            waiting.append(fold(frame, partial))
            size += len(waiting[-1])
            if len(waiting) > 1 and size >= max(_FOLD_FROM, 2 * settled):
                waiting = [fold(pd.concat(waiting, ignore_index=True), merge)]
                size = settled = len(waiting[0])
            if size > _HAND_OVER:  # many groups: the merge below is exact anyway
                yield from waiting
                waiting, size, settled = [], 0, 0
        if waiting:
            yield waiting[0] if len(waiting) == 1 else fold(pd.concat(waiting, ignore_index=True), merge)

    def finished(merged: pd.DataFrame) -> pd.DataFrame:
        done = finish(merged)
        return pd.concat([merged[names].reset_index(drop=True), done.reset_index(drop=True)], axis=1)[result_columns]

    def per_group(frame: pd.DataFrame) -> pd.DataFrame:
        return finished(fold(frame, merge))

    def whole_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by group; the last group of a frame may go on in the next one.
        held: list[pd.DataFrame] = []
        for frame in frames:
            if frame.empty:
                continue
            same = (frame[names] == frame[names].iloc[-1]).all(axis=1).to_numpy()
            begin = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            goes_on = held and (held[-1][names].iloc[-1] == frame[names].iloc[0]).all()
            if held and (begin or not goes_on):
                yield finished(fold(pd.concat([*held, frame.iloc[:begin]], ignore_index=True), partial))
                held = []
            elif begin:
                yield finished(fold(frame.iloc[:begin], partial))
            held.append(frame.iloc[begin:])
        if held:
            yield finished(fold(pd.concat(held, ignore_index=True), partial))

    rows = df.dropna(subset=names).select([col(c) for c in dict.fromkeys([*names, *columns])])
    keyed = [col(k) for k in names]
    # At most one group per LARGE_GROUP rows. Kept, so that both sides see the same ones.
    large = checkpointed(rows.groupBy(*keyed).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > LARGE_GROUP).select(*keyed))
    shuffle_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = rows.join(F.broadcast(large), names, "left_anti").select(*[col(c) for c in rows.columns])
    out = small.repartition(shuffle_parts, *keyed).sortWithinPartitions(*keyed).mapInPandas(whole_groups, results)
    if large.isEmpty():
        return out
    rows = rows.join(F.broadcast(large), names, "left_semi").select(*[col(c) for c in rows.columns])
    sent = rows.mapInPandas(per_task, states)
    if rows.rdd.getNumPartitions() > _MANY_TASKS:
        # A group has a state per task: they are merged in parts first, so that no task gets them all.
        part = F.pmod(F.spark_partition_id(), F.lit(_PARTS)).alias("_part")
        parted = sent.select("*", part)
        merge_part = lambda frame: fold(frame.drop(columns="_part"), merge)
        sent = parted.groupBy(*keyed, "_part").applyInPandas(merge_part, states)
    return out.unionByName(sent.groupBy(*keyed).applyInPandas(per_group, results))

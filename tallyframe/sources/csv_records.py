"""Records of CSV files whose fields hold line breaks, read in as many tasks as the files have splits.

Whether a line begins a record depends on all lines before it, but only through
one bit: inside quotes or not. A line maps that bit to the next line's, a split
of a file maps it to the next split's, and such maps can be put together in any
grouping. So one pass finds each split's map, their running composition gives
the bit that each split begins with, and a second pass puts lines together.
Records that go over a split's end come as fragments, at most two per split,
and are joined up on their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe import limits
from tallyframe.functions import col
from tallyframe.plans.storage import scratch_path
from tallyframe.shipping import ship_package

# Of the table of records, so that reading it splits.
ROW_GROUP_BYTES = 16 << 20

# A quote opens a field only at its beginning; inside, two quotes are one. The quantifiers never give back what they took.
_INSIDE = r'(?:[^"]|"")*+'
_FIELD = rf'(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|)'
_OPENS = re.compile(rf'(?:{_FIELD},)*+"{_INSIDE}\Z', re.DOTALL)
_CLOSES = re.compile(rf'{_INSIDE}"[^,]*+(?:,|\Z)', re.DOTALL)

# How a piece of text relates to its record: all of it, its end, its begin, or neither.
WHOLE, END, BEGIN, MIDDLE = range(4)


def inside_after(line: str, inside: bool) -> bool:
    """Whether the text after this line stands inside quotes."""
    at = 0
    if inside:
        closing = _CLOSES.match(line)
        if closing is None:
            return True
        at = closing.end()
        if not closing.group().endswith(","):
            return False
    return _OPENS.match(line, at) is not None


def _lines(spark: SparkSession, names: str | Sequence[str], base: str | None) -> DataFrame:
    """``_file, _block, _at, value`` and the columns that folders give; a line stays with its own line feed cut off only."""
    reader = spark.read.option("lineSep", "\n")
    if base:
        reader = reader.option("basePath", base)
    text = reader.text(names if isinstance(names, str) else list(names))
    folders = [col(c) for c in text.columns if c != "value"]
    return text.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        "value",
        *folders,
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The batch cut where the split changes."""
    files = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    blocks = batch.column(1).to_numpy()
    edges = [0, *(np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1).tolist(), batch.num_rows]
    for first, last in zip(edges[:-1], edges[1:], strict=True):
        if last > first:
            yield batch.column(0)[first].as_py(), int(blocks[first]), batch.slice(first, last - first)


def _quoted(values: pa.Array) -> np.ndarray:
    """Places of the lines that have a quote; no other line changes whether text is inside one."""
    return np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))


def _split_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split, whether it ends inside quotes if it began outside, and if it began inside."""
    maps: dict[tuple[str, int], list[bool]] = {}
    for batch in batches:
        for file, block, rows in _runs(batch):
            ends = maps.setdefault((file, block), [False, True])
            values = rows.column(2)
            for k in _quoted(values).tolist():
                line = values[k].as_py()
                after = {inside: inside_after(line, inside) for inside in set(ends)}
                ends[:] = [after[e] for e in ends]
    out = [(f, b, *ends) for (f, b), ends in maps.items()]
    columns = list(zip(*out, strict=True)) or [[]] * 4
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_file", "_block", "from_outside", "from_inside"])


def split_states(lines: DataFrame) -> DataFrame:
    """``_file, _block, inside``: whether the split begins inside quotes. One row per split.

    The maps of a file's earlier splits are composed: constant ones forget what
    was before, so the last constant map decides, and the swaps after it.
    """
    maps = lines.select("_file", "_block", "value").mapInArrow(
        _split_maps, "_file string, _block long, from_outside boolean, from_inside boolean"
    )
    constant = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside"))
    swap = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum(swap).over(before), F.lit(0))
    counted = maps.select("_file", "_block", constant.alias("constant"), swaps.alias("swaps"), swap.alias("swap"))
    # Swaps up to and with the last constant map do not count; the file begins outside.
    last = F.last(F.when(F.col("constant").isNotNull(), F.struct("constant", (F.col("swaps") + F.col("swap")).alias("upto"))), ignorenulls=True).over(before)
    start = F.coalesce(last["constant"].cast("int"), F.lit(0)) + F.col("swaps") - F.coalesce(last["upto"], F.lit(0))
    return counted.select("_file", "_block", (start % 2 == 1).alias("inside"))


class _Assembler:
    """Lines of one split after another to records; the record that is open at a split's end comes out as a fragment."""

    def __init__(self):
        self.split = None
        self.inside = False
        self.held: list[str] = []
        self.whole = True  # whether the held lines begin in this split
        self.number = 0
        self.out: list[tuple[str, int, int, int, str]] = []

    def begin(self, file: str, block: int, inside: bool) -> None:
        if self.split != (file, block):
            self.finish()
            self.split, self.inside, self.whole, self.number = (file, block), inside, not inside, 0

    def put(self, kind: int, record: str) -> None:
        self.out.append((*self.split, self.number, kind, record))
        self.number += 1
        self.whole = True

    def lines(self, values: pa.Array) -> None:
        """Runs of lines without quotes are taken as they are: records of their own outside, a part of one inside."""
        first = 0
        for k in [*_quoted(values).tolist(), len(values)]:
            plain = values.slice(first, k - first).to_pylist()
            if self.inside:
                self.held += plain
            else:
                for line in plain:
                    self.put(WHOLE, line)
            if k < len(values):
                line = values[k].as_py()
                self.held.append(line)
                self.inside = inside_after(line, self.inside)
                if not self.inside:
                    self.put(WHOLE if self.whole else END, "\n".join(self.held))
                    self.held = []
            first = k + 1

    def finish(self) -> None:
        if self.held:
            self.put(BEGIN if self.whole else MIDDLE, "\n".join(self.held))
            self.held = []


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    assembler = _Assembler()
    names = ["_file", "_block", "_number", "_kind", "record"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def batch_out() -> pa.RecordBatch:
        columns = list(zip(*assembler.out, strict=True)) or [[]] * len(names)
        assembler.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for file, block, rows in _runs(batch):
            assembler.begin(file, block, rows.column(3)[0].as_py())
            assembler.lines(rows.column(2))
        yield batch_out()
    assembler.finish()
    yield batch_out()


def records(spark: SparkSession, names: str | Sequence[str], base: str | None = None) -> DataFrame:
    """``record`` and the columns that folders give, without the files' first records (their headers) and empty lines.

    The records are written once to the shared folder: types are found out, and
    values parsed, from there. Splits are counted before their states are
    broadcast; more than ``limits.BROADCAST_ROWS`` of them are joined by a shuffle,
    and their lines put in order again.
    """
    ship_package(spark)
    lines = _lines(spark, names, base)
    folders = [c for c in lines.columns if c not in ("_file", "_block", "_at", "value")]
    states_path, path = scratch_path(spark, "csv-splits"), scratch_path(spark, "csv-records")
    split_states(lines).write.parquet(states_path)
    states = spark.read.parquet(states_path)
    if states.count() <= limits.BROADCAST_ROWS:
        begun = lines.join(F.broadcast(states), ["_file", "_block"])
    else:
        begun = lines.join(states, ["_file", "_block"]).repartition("_file", "_block").sortWithinPartitions("_file", "_block", "_at")
    pieces = begun.select("_file", "_block", "value", "inside").mapInArrow(
        _assembled, "_file string, _block long, _number long, _kind int, record string"
    )
    pieces.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    pieces = spark.read.parquet(path)

    place = F.struct("_block", "_number")
    upto = Window.partitionBy("_file").orderBy("_block", "_number")
    fragments = pieces.where(F.col("_kind") != WHOLE).withColumn("_record", F.sum((F.col("_kind") == BEGIN).cast("int")).over(upto))
    joined = fragments.groupBy("_file", "_record").agg(
        F.min(place).alias("_place"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_number", "record"))), lambda p: p["record"]), "\n").alias("record"),
    )
    every = pieces.where(F.col("_kind") == WHOLE).select("_file", place.alias("_place"), "record").unionByName(joined.select("_file", "_place", "record"))
    kept = every.where(~((F.col("_place._block") == 0) & (F.col("_place._number") == 0))).withColumn("record", F.regexp_replace("record", "\r$", ""))
    kept = kept.where(F.trim("record") != "")
    if not folders:
        return kept.select("record")
    # One row per file, and only for tables in folders.
    of_file = lines.groupBy("_file").agg(*[F.first(col(c)).alias(c) for c in folders])
    return kept.join(of_file, "_file").select("record", *[col(c) for c in folders])

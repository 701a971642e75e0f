"""Row-local operators and fitted rules on streaming tables.

Statistics are fitted on a stored table; what runs on the stream is only
projection and filtering, so there is no state and no watermark to keep.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Fitted(Protocol):
    def apply(self, df: DataFrame) -> DataFrame: ...


def apply_fitted(stream: DataFrame, rules: Sequence[Fitted]) -> DataFrame:
    """Apply outlier or scaling rules, in order, to a streaming (or stored) table."""
    out = stream
    for r in rules:
        out = r.apply(out)
    return out


def micro_batched_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    format: str = "parquet",
    files_per_batch: int = 1,
    pattern: str | None = None,
) -> DataFrame:
    """A folder read a few files at a time: input that does not have to be taken in one go."""
    reader = spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if format == "csv":
        reader = reader.option("header", True).option("escape", '"')
    return reader.load(folder)

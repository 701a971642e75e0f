"""Writing results: CSV with a header, JSON lines, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame

FORMATS = ("csv", "json", "parquet")


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> str:
    """Write one part file per task below ``path``. CSV carries no byte order mark."""
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    writer = df.write.mode(mode)
    if format == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif format == "json":
        # Keys stay in every record, as in a saved list of records.
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.parquet(path)
    return path

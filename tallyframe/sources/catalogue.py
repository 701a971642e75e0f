"""Which files there are, and what was loaded from them."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import is_missing


def list_files(spark: SparkSession, folder: str, pattern: str = "*.xlsx") -> DataFrame:
    """``path, name, size, modified`` of files matching a glob; editors' lock files (``~$``) are left out.

    A folder that matches, as Spark writes a table, is one entry: the size of
    all its files, and the latest of their times. The content column is not
    selected, so no file is opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        found = files.load(f"{folder.rstrip('/')}/{pattern}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = files.option("pathGlobFilter", pattern).load(folder)  # nothing matches
    # The entry is the path up to the first name below the folder; the folder may be given with a scheme or without.
    inside = "/" + re.sub(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "", folder).removeprefix("./").strip("/") + "/"
    start = F.instr("path", re.sub("/+", "/", inside)) + len(re.sub("/+", "/", inside))
    name = F.substring_index(F.substr("path", start), "/", 1)
    entry = F.concat(F.substr("path", F.lit(1), start - 1), name)
    return (
        found.select(entry.alias("path"), name.alias("name"), "length", "modificationTime")
        .where(~F.col("name").startswith("~$") & ~F.col("name").startswith("_"))
        .groupBy("path", "name")
        .agg(F.sum("length").alias("size"), F.max("modificationTime").alias("modified"))
    )


def load_info(df: DataFrame) -> DataFrame:
    """Per source file of a loaded table: ``path, name, size, size_mb, modified, row_count, column_count, missing_count``."""
    missing = sum((is_missing(df, c).cast("long") for c in df.columns), F.lit(0).cast("bigint"))
    return (
        df.select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_name").alias("name"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_modification_time").alias("modified"),
            missing.alias("_missing"),
        )
        .groupBy("path", "name", "size", "modified")
        .agg(F.count(F.lit(1)).alias("row_count"), F.sum("_missing").alias("missing_count"))
        .select(
            "path",
            "name",
            "size",
            F.round(F.col("size") / 1024 / 1024, 2).alias("size_mb"),
            "modified",
            "row_count",
            F.lit(len(df.columns)).cast("bigint").alias("column_count"),
            "missing_count",
        )
    )

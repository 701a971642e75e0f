"""Load, clean, profile, chart and write in one call."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tallyframe.operators.types import coerce_numeric
from tallyframe.sources.csv import read_csv
from tallyframe.sources.sinks import write_table

from .charts import chart_bundle
from .cleaning import Step, clean_with, default_steps
from .profile import full_profile
from .report import before_after, report_tables
from .storage import checkpointed, scratch_path


def typed_and_cleaned(
    df: DataFrame, steps: Sequence[Step] | None = None, exact: bool = True
) -> tuple[DataFrame, DataFrame]:
    path = scratch_path(df.sparkSession, "typed")
    coerce_numeric(df).write.parquet(path)
    typed = df.sparkSession.read.parquet(path)
    return typed, clean_with(typed, default_steps(typed, exact=exact) if steps is None else steps)


def result_tables(
    original: DataFrame,
    cleaned: DataFrame,
    free_text: Sequence[str] = (),
    charts: bool = True,
    exact: bool = True,
) -> dict[str, DataFrame]:
    """Profile, report and chart tables of one run, by name."""
    out = {f"profile_{k}": t for k, t in full_profile(cleaned, free_text, exact).items()}
    out |= {f"report_{k}": t for k, t in report_tables({"original": original, "processed": cleaned}, exact).items()}
    out["report_before_after"] = before_after(original, cleaned)
    if charts:
        out["charts"] = chart_bundle(cleaned)
    return out


def run_batch(
    df: DataFrame,
    output: str,
    steps: Sequence[Step] | None = None,
    free_text: Sequence[str] = (),
    charts: bool = True,
    format: str = "parquet",
    exact: bool = True,
) -> dict[str, str]:
    """Write every table below ``output`` and return the paths.

    The typed table and the cleaned one are written first; all that follows
    reads the written ones, so that the source is parsed and cleaned once and
    a lost executor never repeats it.
    """
    spark = df.sparkSession
    base = output.rstrip("/")
    original, cleaned = typed_and_cleaned(df, steps, exact)
    paths = {"cleaned": write_table(cleaned, f"{base}/cleaned", format)}
    stored = (
        spark.read.parquet(paths["cleaned"]) if format == "parquet" else checkpointed(cleaned)
    )
    for name, table in result_tables(original, stored, free_text, charts, exact).items():
        paths[name] = write_table(table, f"{base}/{name}", format)
    return paths


def main(arguments: Sequence[str]) -> None:
    """``spark-submit`` entry: input path, output path, further words name free-text columns."""
    source, output, *free_text = arguments
    spark = SparkSession.builder.appName("tallyframe").getOrCreate()
    df = spark.read.parquet(source) if source.rstrip("/").endswith(".parquet") else read_csv(spark, source)
    run_batch(df, output, free_text=free_text)


if __name__ == "__main__":
    main(sys.argv[1:])

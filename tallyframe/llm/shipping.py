"""Preparing a session for Python workers: this package on their path, and batches that fit beside others."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python files, once per application.

    Arrow batches are limited to ``BATCH_BYTES`` where the session has no
    smaller limit: texts are long, and a worker holds a batch several times.
    """
    context = spark.sparkContext
    if _bytes(spark.conf.get(_BATCH_BYTES)) > BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def _bytes(size: str) -> int:
    """A size as Spark writes it: 67108864b, 64m, 1gb."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]?)[a-z]*", size.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit or "b")

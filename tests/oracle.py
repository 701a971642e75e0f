"""Compare every registered query with its SQL: ``python tests/oracle.py [sf folder] [names...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from catalog import ORACLES, QUERIES  # noqa: E402
from tallyframe.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(value):
    """One spelling per value; everything else must be equal as it is."""
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return repr(float(value)) if abs(value) < 2**53 else str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(normal(r[i]) for i in order) for r in rows), key=lambda t: tuple(str(x) for x in t)
    )


def check(spark, con, name: str, sf_dir: str) -> str:
    """Empty when equal, else the difference."""
    frame = QUERIES[name](spark, sf_dir)
    got_columns, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in ORACLES:
        return "" if got else "no rows"
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    want_columns, want = rows_of(columns, result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not want:
        return "both empty"
    differing = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(differing)} rows differ, first {differing[0]}" if differing else ""


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = check(spark, con, name, sf_dir)
        except Exception:
            problem = traceback.format_exc()[-1500:]
        bad += bool(problem)
        print(f"{'BAD ' if problem else 'ok  '} {time.time() - start:6.2f}s {name} {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()

"""Registering queries, and the small helpers they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, the statement to compare with."""

    def keep(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists already")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Floating results are compared after rounding: sums depend on their order.


def fix(c: Column | str, digits: int = 6) -> Column:
    """Rounded to decimals, without negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def sig(c: Column | str) -> Column:
    """Rounded to nine significant digits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.format_string("%.8e", c.cast("double")).cast("double"))


def fix_sql(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0.0)"


def sig_sql(expression: str) -> str:
    return f"CAST(printf('%.8e', CAST({expression} AS DOUBLE)) AS DOUBLE)"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# The driver's tables have no gaps; these views make some, alike in both dialects.

EVENTS_WITH_GAPS = """(
  SELECT event_id, ts, user_id,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value
  FROM events)"""


def events_with_gaps(spark: SparkSession, sf_dir: str, nan: bool = True) -> DataFrame:
    """Every other gap in ``value`` is a NaN, which must count as missing too."""
    gap = F.when(F.col("event_id") % 14 == 0, F.lit(float("nan"))) if nan else None
    value = (
        gap.when(F.col("event_id") % 7 != 0, F.col("value"))
        if gap is not None
        else F.when(F.col("event_id") % 7 != 0, F.col("value"))
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
        value.alias("value"),
    )


ORDERS_WITH_GAPS = """(
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
         CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus
  FROM orders)"""


def orders_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.when(key % 3 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(key % 2 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(key % 10 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
    )

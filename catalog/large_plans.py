"""Queries with exact quantiles once more, by the plan for groups that no single task may hold."""

from __future__ import annotations

from tallyframe import limits

from .registry import ORACLES, QUERIES, query

#: Rows of a group from which on the large plan is taken here; the tables are too small for the usual bound.
SMALL_TASK = 1_000

NAMES = [
    "impute_median", "outlier_iqr_remove", "outlier_iqr_one_pass", "outlier_pct_remove", "outlier_median", "outlier_counts", "scale_robust",
    "group_analysis", "numeric_profile", "describe", "column_analysis", "box_stats",
]


def _by_large_plan(name: str):
    def run(spark, sf):
        usual = limits.ONE_TASK_ROWS
        limits.ONE_TASK_ROWS = SMALL_TASK
        try:
            return QUERIES[name](spark, sf)
        finally:
            limits.ONE_TASK_ROWS = usual

    return run


for _name in NAMES:
    if _name in QUERIES:
        query(f"{_name}_large_plan", ORACLES.get(_name))(_by_large_plan(_name))

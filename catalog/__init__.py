"""Queries over the driver's tables, one per operator, each with the SQL it must agree with."""

from . import analysis, chart_queries, cleaning_queries, group_queries, querying, sources_queries, text_queries, whole_jobs  # noqa: F401
from . import large_plans  # noqa: F401, E402, I001  after the queries it repeats
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Registered queries: each operator on the given tables, with the SQL that must agree."""

from salesprism.workload import charts, cleaning, files, learning, market, models, pages  # noqa: F401
from salesprism.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

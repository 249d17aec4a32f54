"""End-to-end compositions of the operators over the given tables."""

from evlake.plans import evidence_queries, lake_queries, record_queries, search_queries  # noqa: F401
from evlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

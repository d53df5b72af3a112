"""All registered queries of the core."""

from __future__ import annotations

from sparkloom.plans import analyzer_queries, evidence_queries, graph_queries, more_queries, recipe_queries, search_queries, source_queries, upkeep_queries, usage_queries  # noqa: F401
from sparkloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

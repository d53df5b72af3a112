"""Where queries are registered with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.operators import graph as G
from sparkloom.operators import usage as U
from sparkloom.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, folder) under a name, with SQL of the same result if there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def add(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(fn)


def graph(spark: SparkSession, d: str) -> G.Graph:
    return G.load(table(spark, d, "nodes"), table(spark, d, "edges"))


def usage(spark: SparkSession, d: str) -> DataFrame:
    return U.intake(table(spark, d, "usage_rows"))


_TEXTS = ", ".join(f"coalesce({c}, '') AS {c}" for c in G.NODE_TEXTS)
#: Normalised nodes (n, of them live: l), edges (e) and analyzer edges (g).
GRAPH_SQL = f"""
n AS (SELECT id, {_TEXTS}, coalesce(start_line, 0) AS start_line, coalesce(end_line, 0) AS end_line, metadata,
             coalesce(created_at, 0) AS created_at, coalesce(updated_at, 0) AS updated_at, coalesce(tombstoned_at, 0) AS tombstoned_at,
             coalesce(is_exported, false) AS is_exported, coalesce(is_test, false) AS is_test
      FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, tombstoned_at DESC) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1),
l AS (SELECT * FROM n WHERE tombstoned_at = 0),
e AS (SELECT DISTINCT from_id, to_id, coalesce(type, '') AS type, coalesce(weight, 0.0) AS weight, coalesce(confidence, 0.0) AS confidence,
             coalesce(method, '') AS method, coalesce(evidence, '') AS evidence, coalesce(last_validated, 0) AS last_validated
      FROM edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL),
g AS (SELECT from_id AS src, to_id AS dst, max(CASE WHEN weight = 0 THEN 1.0 ELSE weight END) AS weight FROM e
      WHERE from_id <> to_id AND from_id IN (SELECT id FROM l) AND to_id IN (SELECT id FROM l) GROUP BY 1, 2)"""

_RFC = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"
_z = lambda cs, v: ", ".join(f"coalesce({c}, {v}) AS {c}" for c in cs)
#: Usage rows after intake (u), with us, ms, trust, call.
USAGE_SQL = f"""
u AS (SELECT *, us // 1000 AS ms, (duration_ms BETWEEN 1 AND {U.TRUST_MS} AND NOT interrupted) AS trust, (tool_name = '' AND (output_tokens > 0 OR input_tokens > 0)) AS call FROM (
  SELECT {_z("source session_id project git_branch record_ts record_type model tool_name cli_version uuid parent_uuid tool_use_id agent_id subagent_type tool_input_hash tool_input_preview service_tier stop_reason mcp_server mcp_tool skill".split(), "''")},
         {_z(U._LONGS, 0)}, {_z(U._BOOLS, "false")},
         epoch_us(try_cast(CASE WHEN regexp_matches(record_ts, '{_RFC}') THEN upper(record_ts) END AS TIMESTAMPTZ)) AS us
  FROM usage_rows) WHERE model <> '{U.SYNTHETIC}' AND NOT is_meta),
h AS (SELECT tool_name, CASE WHEN duration_ms < 2 THEN 0 ELSE least(length(bin(duration_ms)) - 1, 31) END AS b, count(*) AS n FROM u WHERE tool_name <> '' AND trust GROUP BY 1, 2),
hc AS (SELECT tool_name, b, sum(n) OVER (PARTITION BY tool_name ORDER BY b) AS cum, sum(n) OVER (PARTITION BY tool_name) AS total FROM h)"""

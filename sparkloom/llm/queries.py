"""Registered queries of the training-data operators; each runs over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import components, conversations, leakage, neighbours, packing, sentences, sourcefiles, topics
from sparkloom.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sourcefiles.file_kinds(table(spark, d, "nodes"), table(spark, d, "discovery_runs")).select("node_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "usage_rows")).select("session_id", "agent_id", "turn_no", "uuid")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    return conversations.paths(table(spark, d, "usage_rows"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return topics.topics(table(spark, d, "search_docs")).select("node_id", "topic_key")


def p3_topics(spark: SparkSession, d: str) -> DataFrame:
    return topics.topic_report(table(spark, d, "search_docs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return components.match_groups(table(spark, d, "link_candidates"), table(spark, d, "similarity_reports"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "code_vectors"), dim=64, k=5, floor=0.8)


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    specs = table(spark, d, "pack_specs")
    return packing.fill_report(packing.pack(table(spark, d, "documents"), specs), specs)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_paths": p2_paths, "p3_found": p3_found, "p3_topics": p3_topics, "p4_found": p4_found, "p5_found": p5_found, "p6_packing": p6_packing, "p6_fill": p6_fill, "p7_found": p7_found, "p8_found": p8_found}
P2_WITH = r"""
WITH RECURSIVE r0 AS (
  SELECT session_id, agent_id, uuid, x.parent AS parent, x.role AS role, x.us AS us FROM (
    SELECT session_id, agent_id, uuid, max({'message': role IS NOT NULL, 'some': us IS NOT NULL, 'us': us, 'some_role': role IS NOT NULL, 'role': role, 'parent': parent}) AS x FROM (
      SELECT session_id, coalesce(trim(agent_id), '') AS agent_id, coalesce(trim(uuid), '') AS uuid, coalesce(trim(parent_uuid), '') AS parent,
        CASE WHEN coalesce(trim(tool_name), '') = '' AND NOT coalesce(is_meta, false) AND NOT coalesce(is_api_error, false) AND coalesce(trim(model), '') <> '<synthetic>'
          THEN CASE WHEN lower(trim(record_type)) IN ('user', 'human', 'user_message') THEN 'user' WHEN lower(trim(record_type)) IN ('assistant', 'agent_message') THEN 'assistant' END END AS role,
        epoch_us(try_cast(CASE WHEN regexp_matches(trim(record_ts), '^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$') THEN upper(trim(record_ts)) END AS TIMESTAMPTZ)) AS us
      FROM usage_rows WHERE coalesce(trim(session_id), '') <> '')
    GROUP BY session_id, agent_id, uuid, CASE WHEN uuid = '' THEN parent END)),
bad AS (SELECT DISTINCT session_id, agent_id FROM r0 WHERE (role IS NOT NULL AND us IS NULL) OR (parent <> '' AND NOT EXISTS (SELECT 1 FROM r0 q WHERE q.session_id = r0.session_id AND q.agent_id = r0.agent_id AND q.uuid = r0.parent))),
m AS (SELECT * FROM r0 WHERE role IS NOT NULL AND us IS NOT NULL AND uuid <> '' AND (session_id, agent_id) NOT IN (SELECT (session_id, agent_id) FROM bad)),
d AS (SELECT session_id, agent_id, uuid, 0 AS depth FROM r0 WHERE parent = ''
  UNION ALL SELECT r0.session_id, r0.agent_id, r0.uuid, depth + 1 FROM d JOIN r0 ON r0.session_id = d.session_id AND r0.agent_id = d.agent_id AND r0.parent = d.uuid WHERE d.uuid <> ''),
o AS (SELECT m.*, depth, row_number() OVER w AS turn_no, lead(role) OVER w AS follower FROM m LEFT JOIN d USING (session_id, agent_id, uuid) WINDOW w AS (PARTITION BY session_id, agent_id ORDER BY us, coalesce(depth, -1), uuid)),
k AS (SELECT session_id, agent_id FROM o GROUP BY 1, 2 HAVING max((turn_no = 1 AND role <> 'user')::INT) = 0 AND max((role = 'user' AND coalesce(follower, 'user') = 'user')::INT) = 0)"""
P2_SQL = P2_WITH + """
SELECT session_id, agent_id, turn_no::INT AS turn_no, uuid FROM o JOIN k USING (session_id, agent_id)"""
P2_PATHS_SQL = P2_WITH + """,
t AS (SELECT session_id, agent_id, uuid, role, depth FROM o JOIN k USING (session_id, agent_id) WHERE depth IS NOT NULL),
up AS (SELECT session_id, agent_id, uuid AS leaf, uuid, depth FROM t
  UNION ALL SELECT up.session_id, up.agent_id, up.leaf, r0.parent, up.depth - 1 FROM up JOIN r0 USING (session_id, agent_id, uuid) WHERE r0.parent <> ''),
j AS (SELECT up.session_id, up.agent_id, leaf, up.depth, up.uuid, t.role FROM up JOIN t USING (session_id, agent_id, uuid))
SELECT * FROM j WHERE (session_id, agent_id, leaf) NOT IN (SELECT (session_id, agent_id, uuid) FROM j WHERE uuid <> leaf)"""
P4_SQL = r"""
WITH RECURSIVE c AS (SELECT report_id, lower(trim(medoid_a, E' \t\n\r')) AS a, lower(trim(medoid_b, E' \t\n\r')) AS b, score FROM link_candidates),
l AS (SELECT DISTINCT a, b FROM c JOIN similarity_reports USING (report_id) WHERE score IS NOT NULL AND NOT isnan(score) AND score >= merge_threshold AND a <> '' AND b <> '' AND a <> b),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS node, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.node WHERE r.m < e.b)
SELECT node AS node_id, min(m) AS group_id FROM r GROUP BY 1"""
ORACLE_SQL: dict[str, str] = {"p2_found": P2_SQL, "p2_paths": P2_PATHS_SQL, "p4_found": P4_SQL}

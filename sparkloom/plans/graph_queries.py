"""Queries of the relational graph layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import scalars as S
from sparkloom.operators import evidence as V
from sparkloom.operators import graph as G
from sparkloom.plans.registry import GRAPH_SQL, add, graph

W = "WITH" + GRAPH_SQL
WR = "WITH RECURSIVE" + GRAPH_SQL
CODE = ["CALLS", "USES_TYPE", "REFERENCES"]
THOUGHT = ["relates-to", "supports", "contradicts", "informed-by"]
NOW = 1_785_000_000_000_000_000
M = "coalesce(element_at(metadata, '{k}')[1], '')".format


def code(s, d):
    g = graph(s, d)
    return g


add("browse_type_status", lambda s, d: G.browse(graph(s, d), ["thought", "thought_session"], statuses=["active", "open"], limit=0).select("id", "type", "status", "symbol_name"),
    f"{W} SELECT id, type, status, symbol_name FROM l WHERE type IN ('thought', 'thought_session') AND status IN ('active', 'open')")
add("browse_metadata", lambda s, d: G.browse(graph(s, d), ["thought", "charge", "file"], metadata={"cluster_id": "*"}, limit=0).select("id", S.meta("cluster_id").alias("cluster")), f"{W} SELECT id, {M(k='cluster_id')} AS cluster FROM l WHERE type IN ('thought', 'charge', 'file') AND list_contains(map_keys(metadata), 'cluster_id')")
add("browse_fields", lambda s, d: G.browse(graph(s, d), ["function", "method"], fields=[("summary", "EXISTS", None), ("updated_at", "GTE", 1_770_000_000_000_000_000), ("is_test", "EQ", False)], limit=0).select("id", "symbol_name"), f"{W} SELECT id, symbol_name FROM l WHERE type IN ('function', 'method') AND summary <> '' AND updated_at >= 1770000000000000000 AND NOT is_test")
add("browse_page_limit", lambda s, d: G.browse(graph(s, d), ["file"], limit=25, offset=50).select("id", "file_path"), f"{W} SELECT id, file_path FROM l WHERE type = 'file' ORDER BY id LIMIT 25 OFFSET 50")
add("projection", lambda s, d: G.project(graph(s, d).live, ["id", "type", "symbol_name", "start_line", "language"]), f"{W} SELECT id, type, symbol_name, start_line, language FROM l")
add("by_ids_with_tombstones", lambda s, d: G.by_ids(graph(s, d), graph(s, d).edges.select(F.col("to_id").alias("id")), True).select("id", "type", "tombstoned_at"), f"{W} SELECT id, type, tombstoned_at FROM n WHERE id IN (SELECT to_id FROM e)")
add("keyset_page", lambda s, d: G.keyset_page(graph(s, d).live.select("id", "type"), "8", 100), f"{W} SELECT id, type FROM l WHERE id > '8' ORDER BY id LIMIT 100")
add("pivot_edges", lambda s, d: G.pivot_edges(graph(s, d), graph(s, d).live.where("type = 'method'")), f"{W}, i AS (SELECT id FROM l WHERE type = 'method') SELECT * FROM e WHERE from_id IN (SELECT id FROM i) OR to_id IN (SELECT id FROM i)")
add("banded_edges", lambda s, d: G.banded_edges(graph(s, d), ["charged-by"], 8), f"{W} SELECT * FROM e WHERE type = 'charged-by'")
add("graph_totals", lambda s, d: G.totals(graph(s, d)), f"{W} SELECT 'nodes' AS kind, count(*) AS n FROM l UNION ALL SELECT 'edges', count(*) FROM e")
add("graph_instances", lambda s, d: G.graph_counts(graph(s, d)), f"{W} SELECT CASE WHEN type IN ('file', 'function', 'method', 'type') THEN 'code' ELSE 'knowledge' END AS family, source AS instance, count(*) AS nodes FROM l GROUP BY 1, 2")
add("graph_stats", lambda s, d: G.graph_stats(graph(s, d)), f"{W} SELECT 'node' AS kind, type, count(*) AS n, coalesce(min(CASE WHEN symbol_name <> '' THEN symbol_name END), '') AS sample FROM l GROUP BY 2 UNION ALL SELECT 'edge', type, count(*), '' FROM e GROUP BY 2")
add("metadata_stats", lambda s, d: G.metadata_stats(graph(s, d)), f"""{W}, x AS (SELECT unnest(map_keys(metadata)) AS key, unnest(map_values(metadata)) AS value FROM l), v AS (SELECT key, value, count(*) AS c FROM x GROUP BY 1, 2),
r AS (SELECT key, count(*) AS distinct_values, sum(c)::BIGINT AS writes, list_sort(list(c))[count(*) // 2 + 1] AS median_nodes FROM v GROUP BY 1)
SELECT *, CASE WHEN median_nodes >= 5 AND distinct_values <= 1000 AND distinct_values > 1 THEN 'promote' ELSE 'keep' END AS advice FROM r""")
add("pivot_language_type", lambda s, d: G.pivot_matrix(graph(s, d).live, F.lower("language"), F.col("type")), f"{W} SELECT r, c, count(*) AS n FROM (SELECT lower(language) AS r, type AS c FROM l) WHERE r <> '' AND c <> '' GROUP BY CUBE (r, c)")
add("edge_symmetric_difference", lambda s, d: G.edge_changes(G.steps(graph(s, d).edges, "out", ["CALLS"]), G.steps(graph(s, d).edges, "out", ["REFERENCES"])), f"""{W}, o AS (SELECT DISTINCT from_id AS a, to_id AS b FROM e WHERE type = 'CALLS'), w AS (SELECT DISTINCT from_id AS a, to_id AS b FROM e WHERE type = 'REFERENCES')
SELECT a, b, 'add' AS change FROM (SELECT * FROM w EXCEPT SELECT * FROM o) UNION ALL SELECT a, b, 'remove' FROM (SELECT * FROM o EXCEPT SELECT * FROM w)""")
add("edge_type_resolution", lambda s, d: graph(s, d).edges.where(F.col("type").isin(*G.resolve_edge_types(graph(s, d).edges, ["calls", "uses_type"]))).groupBy("type").agg(F.count(F.lit(1)).alias("n")), f"{W} SELECT type, count(*) AS n FROM e WHERE type IN ('CALLS', 'USES_TYPE') GROUP BY 1")
add("analyzer_edges", lambda s, d: G.analyzer_edges(graph(s, d)), f"{W} SELECT * FROM g")
add("edge_hydrate", lambda s, d: G.hydrate_edges(graph(s, d)).select("from_id", "to_id", "type", "from_name", "to_name", "from_type", "to_type"), f"{W} SELECT e.from_id, e.to_id, e.type, coalesce(nullif(a.symbol_name, ''), e.from_id) AS from_name, coalesce(nullif(b.symbol_name, ''), e.to_id) AS to_name, coalesce(a.type, '') AS from_type, coalesce(b.type, '') AS to_type FROM e LEFT JOIN l a ON a.id = e.from_id LEFT JOIN l b ON b.id = e.to_id")
add("correlations_top", lambda s, d: G.correlations(graph(s, d), THOUGHT).select("from_id", "to_id", "type", "confidence"), f"{W} SELECT from_id, to_id, type, confidence FROM e WHERE type IN ('relates-to', 'supports', 'contradicts', 'informed-by') ORDER BY confidence DESC, from_id, to_id, type, evidence, weight LIMIT 100")
add("candidate_groups", lambda s, d: G.candidate_groups(graph(s, d)), f"""{W}, c AS (SELECT *, CASE WHEN evidence = '' THEN to_id || chr(0) || type ELSE evidence END AS k FROM e WHERE method IN ('ambiguous-name', 'dynamic', 'heuristic')),
r AS (SELECT from_id, k, count(*) AS members, max(confidence) AS confidence, min(method) AS method, max(evidence = '') AS single FROM c GROUP BY 1, 2)
SELECT from_id, CASE WHEN single THEN '' ELSE k END AS evidence, members, confidence, CASE WHEN confidence > 0 THEN round(1 / confidence) ELSE 0 END::BIGINT AS declared, method = 'ambiguous-name' AS closed, members = CASE WHEN confidence > 0 THEN round(1 / confidence) ELSE 0 END::BIGINT AS complete FROM r""")
add("has_edge", lambda s, d: G.has_edge(graph(s, d), graph(s, d).live.where("type = 'thought'").select("id"), "charged-by", "out"), f"{W} SELECT id FROM l WHERE type = 'thought' AND id IN (SELECT from_id FROM e WHERE type = 'charged-by')")
KHOP = """{w}, st AS ({starts}), s AS ({steps}), r AS (SELECT id, 0 AS distance FROM st WHERE id IN (SELECT id FROM l) UNION SELECT s.b, r.distance + 1 FROM r JOIN s ON s.a = r.id JOIN l ON l.id = s.b WHERE r.distance < {k}) SELECT id, min(distance) AS distance FROM r GROUP BY 1"""
add("k_hop_out", lambda s, d: G.k_hop(graph(s, d), graph(s, d).live.where("type = 'type'").select("id"), "out", ["CALLS"], 3), KHOP.format(w=WR, starts="SELECT id FROM l WHERE type = 'type'", steps="SELECT DISTINCT from_id AS a, to_id AS b FROM e WHERE type = 'CALLS'", k=3))
add("k_hop_both", lambda s, d: G.k_hop(graph(s, d), graph(s, d).live.where("type = 'method'").select("id"), "both", ["USES_TYPE", "REFERENCES"], 2), KHOP.format(w=WR, starts="SELECT id FROM l WHERE type = 'method'", steps="SELECT from_id AS a, to_id AS b FROM e WHERE type IN ('USES_TYPE', 'REFERENCES') UNION SELECT to_id, from_id FROM e WHERE type IN ('USES_TYPE', 'REFERENCES')", k=2))
add("closure_informed_by", lambda s, d: G.closure(G.steps(graph(s, d).edges, "out", ["informed-by"]), 6), f"{WR}, s AS (SELECT DISTINCT from_id AS a, to_id AS b FROM e WHERE type = 'informed-by'), r AS (SELECT a, b, 1 AS distance FROM s UNION SELECT r.a, s.b, r.distance + 1 FROM r JOIN s ON s.a = r.b WHERE r.distance < 6) SELECT a, b, min(distance) AS distance FROM r GROUP BY 1, 2")
add("dead_code", lambda s, d: G.unreachable(graph(s, d), graph(s, d).live.where("is_exported or is_test").select("id"), ["CALLS", "REFERENCES", "USES_TYPE"], ["function", "method"]).select("id", "symbol_name"),
    f"{WR}, s AS (SELECT DISTINCT from_id AS a, to_id AS b FROM e WHERE type IN ('CALLS', 'REFERENCES', 'USES_TYPE')), r AS (SELECT id FROM l WHERE is_exported OR is_test UNION SELECT s.b FROM r JOIN s ON s.a = r.id JOIN l ON l.id = s.b) SELECT id, symbol_name FROM l WHERE type IN ('function', 'method') AND id NOT IN (SELECT id FROM r)")
add("dead_code_positions", lambda s, d: G.by_position(G.unreachable(graph(s, d), graph(s, d).live.where("is_exported").select("id"), ["CALLS"], ["function"]), graph(s, d).live.where("type = 'function'").select(F.col("file_path").alias("path"), F.col("start_line").alias("line"), F.col("id").alias("at_id"))).select("id", "at_id"),
    f"{WR}, s AS (SELECT DISTINCT from_id AS a, to_id AS b FROM e WHERE type = 'CALLS'), r AS (SELECT id FROM l WHERE is_exported UNION SELECT s.b FROM r JOIN s ON s.a = r.id JOIN l ON l.id = s.b), dd AS (SELECT * FROM l WHERE type = 'function' AND id NOT IN (SELECT id FROM r)) SELECT dd.id, f.id AS at_id FROM dd JOIN l f ON f.type = 'function' AND f.file_path = dd.file_path AND f.start_line = dd.start_line")
add("overlay_shadowing", lambda s, d: G.overlay(graph(s, d).live.select("id", "type", "status"), graph(s, d).live.where("type = 'thought'").select("id", "type", F.lit("branch").alias("status"))), f"{W} SELECT id, type, CASE WHEN type = 'thought' THEN 'branch' ELSE status END AS status FROM l")
add("shared_session_groups", lambda s, d: G.shared_artifact_groups(graph(s, d).edges.where("type = 'contains'").select(F.col("from_id").alias("artifact"), F.col("to_id").alias("thought")), graph(s, d).edges.where(F.col("type").isin(*THOUGHT))),
    f"""{W}, m AS (SELECT DISTINCT from_id AS artifact, to_id AS thought FROM e WHERE type = 'contains'), x AS (SELECT from_id AS a, to_id AS b FROM e WHERE type IN ('relates-to', 'supports', 'contradicts', 'informed-by') AND from_id <> to_id UNION SELECT to_id, from_id FROM e WHERE type IN ('relates-to', 'supports', 'contradicts', 'informed-by') AND from_id <> to_id),
k AS (SELECT artifact, count(*) AS members FROM m GROUP BY 1), j AS (SELECT p.artifact, p.thought, count(*) AS joined FROM m p JOIN x ON x.a = p.thought JOIN m q ON q.artifact = p.artifact AND q.thought = x.b GROUP BY 1, 2)
SELECT artifact, thought, members, members - 1 - coalesce(joined, 0) AS links FROM m JOIN k USING (artifact) LEFT JOIN j USING (artifact, thought)""")


def _alerts(s, d):
    f = graph(s, d).live.where("type = 'function'")
    findings = f.where("is_test").select(F.lit("tests").alias("check"), F.col("file_path").alias("path"), F.col("start_line").alias("line")).unionByName(f.where("is_exported").select(F.lit("exported"), F.col("file_path"), F.col("start_line")).toDF("check", "path", "line"))
    return findings, f.where("start_line % 5 = 0").select(F.lower("language").alias("rule"), F.col("file_path").alias("path"), F.col("start_line").alias("line"))


_AL = f"{W}, f AS (SELECT DISTINCT 'tests' AS \"check\", file_path AS path, start_line AS line FROM l WHERE type = 'function' AND is_test UNION SELECT 'exported', file_path, start_line FROM l WHERE type = 'function' AND is_exported), a AS (SELECT DISTINCT lower(language) AS rule, file_path AS path, start_line AS line FROM l WHERE type = 'function' AND start_line % 5 = 0)"
add("calibration_precision", lambda s, d: G.score_alerts(*_alerts(s, d)), f"{_AL} SELECT \"check\", count(*) AS findings, round(avg(((path, line) IN (SELECT (path, line) FROM a))::INT), 6) AS precision_line, round(avg((path IN (SELECT path FROM a))::INT), 6) AS precision_file FROM f GROUP BY 1")
add("calibration_recall", lambda s, d: G.recall_alerts(*_alerts(s, d)), f"{_AL} SELECT rule, count(*) AS alerts, round(avg(((path, line) IN (SELECT (path, line) FROM f))::INT), 6) AS recall_line, round(avg((path IN (SELECT path FROM f))::INT), 6) AS recall_file FROM a GROUP BY 1")
add("structural_conformance", lambda s, d: G.conformance(graph(s, d).edges.where("type = 'USES_TYPE'").select(F.col("from_id").alias("type_id"), F.col("to_id").alias("sig")), graph(s, d).edges.where("type = 'REFERENCES'").select(F.col("from_id").alias("interface_id"), F.col("to_id").alias("sig"))),
    f"{W}, m AS (SELECT DISTINCT from_id AS type_id, to_id AS sig FROM e WHERE type = 'USES_TYPE'), i AS (SELECT DISTINCT from_id AS interface_id, to_id AS sig FROM e WHERE type = 'REFERENCES'), k AS (SELECT interface_id, count(*) AS need FROM i GROUP BY 1) SELECT m.type_id, i.interface_id, k.need AS methods FROM m JOIN i USING (sig) JOIN k ON k.interface_id = i.interface_id GROUP BY ALL HAVING count(*) = k.need")
_DECL = lambda s, d: graph(s, d).live.where("type in ('function', 'method')").select(F.col("id").alias("decl_id"), F.left("symbol_name", F.lit(3)).alias("name"), F.col("file_path").alias("file"), F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("package"))
add("reference_resolution", lambda s, d: G.resolution_ladder(graph(s, d).live.where("type = 'type'").select(F.col("id").alias("ref_id"), F.left("symbol_name", F.lit(3)).alias("name"), F.col("file_path").alias("file"), F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("package")), _DECL(s, d)),
    f"""{W}, dc AS (SELECT id AS decl_id, left(symbol_name, 3) AS name, file_path AS file, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS package FROM l WHERE type IN ('function', 'method')), rf AS (SELECT id AS ref_id, left(symbol_name, 3) AS name, file_path AS file, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS package FROM l WHERE type = 'type'),
c AS (SELECT ref_id, decl_id, CASE WHEN rf.file = dc.file THEN 0 WHEN rf.package = dc.package THEN 1 ELSE 2 END AS rung FROM rf JOIN dc USING (name)), b AS (SELECT *, min(rung) OVER (PARTITION BY ref_id) AS best FROM c), k AS (SELECT ref_id, decl_id, rung, count(*) OVER (PARTITION BY ref_id) AS candidates FROM b WHERE rung = best)
SELECT *, round(1.0 / candidates, 6) AS confidence, CASE WHEN candidates > 1 THEN 'ambiguous-name' ELSE 'static' END AS method FROM k""")
DEG = "dg AS (SELECT l.id, (SELECT count(*) FROM g WHERE dst = l.id) AS fan_in, (SELECT count(*) FROM g WHERE src = l.id) AS fan_out FROM l)"
add("degrees", lambda s, d: G.degrees(G.analyzer_edges(graph(s, d)), graph(s, d).live), f"{W}, {DEG} SELECT id, fan_in, fan_out, fan_in + fan_out AS total FROM dg")
add("degree_by_type", lambda s, d: G.degree_by_type(graph(s, d)), f"""{W}, x AS (SELECT from_id AS id, type, 0 AS i FROM e WHERE from_id <> to_id UNION ALL SELECT to_id, type, 1 FROM e WHERE from_id <> to_id), t AS (SELECT id, type, sum(i) AS i, sum(1 - i) AS o FROM x GROUP BY 1, 2)
SELECT id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out, string_agg(type || '=' || (i + o)::BIGINT, ';' ORDER BY type || '=' || (i + o)::BIGINT) AS by_type FROM t WHERE id IN (SELECT id FROM l) GROUP BY 1""")
_BK = "CASE WHEN v >= 1001 THEN '1001+' WHEN v >= 101 THEN '101-1000' WHEN v >= 26 THEN '26-100' WHEN v >= 11 THEN '11-25' WHEN v >= 6 THEN '6-10' WHEN v >= 3 THEN '3-5' ELSE v::VARCHAR END"
add("degree_histogram", lambda s, d: G.degree_histogram(G.degrees(G.analyzer_edges(graph(s, d)), graph(s, d).live)), f"""{W}, {DEG}, v AS (SELECT 'fan_in' AS measure, fan_in AS v FROM dg UNION ALL SELECT 'fan_out', fan_out FROM dg UNION ALL SELECT 'total', fan_in + fan_out FROM dg), b AS (SELECT measure, {_BK} AS bucket, count(*) AS n FROM v GROUP BY 1, 2),
dm AS (SELECT * FROM (VALUES ('fan_in'), ('fan_out'), ('total')) a(measure), (VALUES ('0'), ('1'), ('2'), ('3-5'), ('6-10'), ('11-25'), ('26-100'), ('101-1000'), ('1001+')) b(bucket)) SELECT measure, bucket, coalesce(n, 0) AS n FROM dm LEFT JOIN b USING (measure, bucket)""")
add("content_type_ratio", lambda s, d: G.content_ratio(graph(s, d)), f"{W} SELECT type, count(*) AS n, round(count(*) / (SELECT count(*) FROM l), 6) AS ratio FROM l GROUP BY 1")
add("subtree_ratio", lambda s, d: G.subtree_ratio(graph(s, d), ["thought_session"], "contains", 4), f"{WR}, s AS (SELECT DISTINCT from_id AS a, to_id AS b FROM e WHERE type = 'contains'), r AS (SELECT a, b, 1 AS k FROM s WHERE a IN (SELECT id FROM l WHERE type = 'thought_session') UNION SELECT r.a, s.b, k + 1 FROM r JOIN s ON s.a = r.b WHERE k < 4), x AS (SELECT DISTINCT a, b FROM r), t AS (SELECT a AS root, type, count(*) AS n FROM x JOIN l ON l.id = x.b GROUP BY 1, 2) SELECT root, type, n, round(n / sum(n) OVER (PARTITION BY root), 6) AS ratio FROM t")
add("keyword_density", lambda s, d: G.keyword_density(graph(s, d).live, r"(?i)cache|index", "summary"), f"{W} SELECT sum(regexp_matches(summary, '(?i)cache|index')::INT)::BIGINT AS hits, count(*) AS n, round(avg(regexp_matches(summary, '(?i)cache|index')::INT), 6) AS density FROM l WHERE summary <> ''")
add("title_shape", lambda s, d: G.title_shape(graph(s, d), "thought"), f"{W} SELECT sum(regexp_matches(symbol_name, '^[A-Z][^?]*\\(')::INT)::BIGINT AS hits, count(*) AS n, round(avg(regexp_matches(symbol_name, '^[A-Z][^?]*\\(')::INT), 6) AS density FROM l WHERE type = 'thought' AND symbol_name <> ''")
add("package_matrix", lambda s, d: G.package_matrix(graph(s, d), CODE), f"{W}, p AS (SELECT id, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS pkg, file_path FROM l WHERE file_path <> '') SELECT a.pkg AS from_pkg, b.pkg AS to_pkg, count(*) AS n, min(a.file_path) AS rep FROM e JOIN p a ON a.id = from_id JOIN p b ON b.id = to_id WHERE e.type IN ('CALLS', 'USES_TYPE', 'REFERENCES') AND a.pkg <> b.pkg GROUP BY 1, 2")
CK = f"""{W}, c AS (SELECT id FROM l WHERE type IN ('file', 'type')), x AS (SELECT * FROM e WHERE from_id <> to_id), m AS (SELECT DISTINCT from_id AS id, to_id AS m FROM x WHERE type = 'CONTAINS' AND to_id IN (SELECT id FROM l WHERE type IN ('method', 'function'))),
a AS (SELECT from_id AS id, count(DISTINCT to_id) AS cbo FROM x WHERE type IN ('USES_TYPE', 'CALLS') GROUP BY 1), w AS (SELECT id, count(*) AS wmc FROM m GROUP BY 1), r AS (SELECT id, count(*) AS rfc FROM (SELECT id, m AS x FROM m UNION SELECT m.id, to_id FROM m JOIN x ON x.from_id = m.m WHERE x.type = 'CALLS') GROUP BY 1), f AS (SELECT to_id AS id, count(DISTINCT from_id) AS fan_in FROM x GROUP BY 1),
ck AS (SELECT c.id, coalesce(cbo, 0) AS cbo, coalesce(rfc, 0) AS rfc, coalesce(wmc, 0) AS wmc, coalesce(fan_in, 0) AS fan_in FROM c LEFT JOIN a USING (id) LEFT JOIN r USING (id) LEFT JOIN w USING (id) LEFT JOIN f USING (id))"""
add("ck_metrics", lambda s, d: G.ck_metrics(graph(s, d), ["file", "type"]), f"{CK} SELECT * FROM ck")
_PR = lambda c: f"100.0 * (rank() OVER (ORDER BY {c}) - 1) / count(*) OVER ()"
add("god_objects", lambda s, d: G.god_objects(G.ck_metrics(graph(s, d), ["file", "type"])), f"{CK}, s AS (SELECT *, ({_PR('cbo')} + {_PR('rfc')} + {_PR('wmc')} + {_PR('fan_in')}) / 4 AS q FROM ck) SELECT id, cbo, rfc, wmc, fan_in, round(q, 6) AS score, CASE WHEN q >= 99 THEN 'critical' WHEN q >= 95 THEN 'warning' WHEN q >= 80 THEN 'notice' ELSE 'info' END AS severity FROM s")
add("percentile_rank", lambda s, d: G.percent_rank_below(graph(s, d).live.where("type = 'function'").select("id", "start_line"), "start_line", "p").select("id", F.round("p", 6).alias("p")), f"{W} SELECT id, round({_PR('start_line')}, 6) AS p FROM l WHERE type = 'function'")
add("composition_census", lambda s, d: G.composition(graph(s, d)), f"{W} SELECT type, CASE WHEN status = '' THEN 'unset' ELSE status END AS class, count(*) AS n FROM l GROUP BY 1, 2")
add("proxy_breakdown", lambda s, d: G.proxy_breakdown(graph(s, d)), f"{W} SELECT {M(k='repo')} AS foreign_graph, count(*) AS n FROM l WHERE list_contains(map_keys(metadata), 'repo') GROUP BY 1")
add("proxy_resolution", lambda s, d: G.resolve_proxies(graph(s, d), G.Graph(graph(s, d).live.where("type = 'file'").withColumn("id", S.meta("repo")).dropDuplicates(["id"]), graph(s, d).edges), "repo").select("proxy_id", "id"), f"{W} SELECT id AS proxy_id, {M(k='repo')} AS id FROM l WHERE {M(k='repo')} <> '' AND {M(k='repo')} IN (SELECT {M(k='repo')} FROM l WHERE type = 'file')")
add("rollup_cascade", lambda s, d: G.rollup(graph(s, d), graph(s, d).live.where("type = 'thought_session' and status = 'open'").select("id"), "contains", "completed", ["thought"], "charge"), f"""{W}, rt AS (SELECT id FROM l WHERE type = 'thought_session' AND status = 'open'), ch AS (SELECT DISTINCT to_id AS id FROM e WHERE type = 'contains' AND from_id IN (SELECT id FROM rt) AND to_id IN (SELECT id FROM l) AND to_id NOT IN (SELECT id FROM rt)), cr AS (SELECT DISTINCT from_id AS id FROM e WHERE type = 'contains' AND to_id IN (SELECT id FROM l WHERE type = 'charge' AND status IN ('', 'open', 'active', 'pending', 'in_progress')))
SELECT id, 'cascade' AS action FROM rt UNION ALL SELECT ch.id, CASE WHEN l.type <> 'thought' THEN 'list' WHEN l.status NOT IN ('', 'open', 'active', 'pending', 'in_progress') THEN 'settled' WHEN ch.id IN (SELECT id FROM cr) THEN 'hold' ELSE 'cascade' END FROM ch JOIN l USING (id)""")
add("timeline", lambda s, d: G.timeline(graph(s, d).live.where("type = 'thought'"), G.instant_of("created_at")).select("id", "name", "offset_us"), f"{W}, x AS (SELECT id, symbol_name AS name, created_at // 1000 AS us FROM l WHERE type = 'thought' AND created_at > 0) SELECT id, name, us - min(us) OVER () AS offset_us FROM x ORDER BY us, id LIMIT 500")
add("timeline_buckets", lambda s, d: G.tumbling(graph(s, d).live.where("type = 'thought' and created_at > 0").select("id", F.col("symbol_name").alias("name"), F.expr("created_at div 1000").alias("us")), "us", 86400).select("bucket", "n"), f"{W}, x AS (SELECT created_at // 1000 AS us FROM l WHERE type = 'thought' AND created_at > 0), y AS (SELECT (us - min(us) OVER ()) // 86400000000 AS bucket FROM x) SELECT bucket, count(*) AS n FROM y GROUP BY 1")
add("recent_browse", lambda s, d: G.recent(graph(s, d), NOW, ["thought"], 50), f"{W} SELECT id, type, round(1 + CASE WHEN updated_at = 0 THEN 0.5 ELSE pow(0.5, greatest(0, ({NOW} - updated_at) / 86400000000000.0) / 30) END, 9) AS score FROM l WHERE type = 'thought' ORDER BY 1 + CASE WHEN updated_at = 0 THEN 0.5 ELSE pow(0.5, greatest(0, ({NOW} - updated_at) / 86400000000000.0) / 30) END DESC, id LIMIT 50")
add("ordered_children", lambda s, d: G.ordered_children(graph(s, d), "contains"), f"{W}, c AS (SELECT from_id AS parent, to_id AS id, min(try_cast(evidence->>'$.position' AS BIGINT)) AS position FROM e WHERE type = 'contains' AND to_id IN (SELECT id FROM l) GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY parent ORDER BY position NULLS LAST, id) AS no FROM c".replace("evidence->>'$.position'", "CASE WHEN evidence LIKE '{{%' THEN json_extract_string(evidence, '$.position') END".replace("{{", "{")))
_A = lambda s, d: graph(s, d).edges.where("type = 'CALLS'").agg(F.min("from_id").alias("x")).first().x or ""
add("analyze_node", lambda s, d: G.analyze_node(graph(s, d), _A(s, d)), f"{W}, x AS (SELECT min(from_id) AS x FROM e WHERE type = 'CALLS'), y AS (SELECT 'callee' AS role, to_id AS id, confidence FROM e, x WHERE type = 'CALLS' AND from_id = x UNION ALL SELECT 'caller', from_id, confidence FROM e, x WHERE type = 'CALLS' AND to_id = x) SELECT role, id, max(confidence) AS confidence, count(*) AS edges, any_value(symbol_name) AS symbol_name, any_value(l.type) AS type FROM y JOIN l USING (id) GROUP BY 1, 2")
add("explain_node", lambda s, d: G.explain(graph(s, d), _A(s, d)).select("from_id", "to_id", "type", "from_name", "to_name"), f"{W}, x AS (SELECT min(from_id) AS x FROM e WHERE type = 'CALLS') SELECT e.from_id, e.to_id, e.type, coalesce(nullif(a.symbol_name, ''), e.from_id) AS from_name, coalesce(nullif(b.symbol_name, ''), e.to_id) AS to_name FROM x, e LEFT JOIN l a ON a.id = e.from_id LEFT JOIN l b ON b.id = e.to_id WHERE e.from_id = x OR e.to_id = x")
add("file_symbols", lambda s, d: G.file_symbols(graph(s, d), graph(s, d).live.where("type = 'file'").select(F.regexp_replace("file_path", "^[^/]*/", "").alias("path")).distinct()), f"""{W}, a AS (SELECT DISTINCT regexp_replace(file_path, '^[^/]*/', '') AS asked FROM l WHERE type = 'file'), dc AS (SELECT id, symbol_name, type, file_path, start_line FROM l WHERE type IN ('function', 'method', 'type')), x AS (SELECT asked, dc.* FROM a JOIN dc ON asked = file_path)
SELECT * FROM x UNION ALL SELECT asked, dc.* FROM a JOIN dc ON (len(file_path) > len(asked) AND right(file_path, len(asked) + 1) = '/' || asked) WHERE asked NOT IN (SELECT asked FROM x)""")
add("module_listing", lambda s, d: G.module_listing(graph(s, d), "src"), f"{W} SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS module, count(*) AS files FROM l WHERE type = 'file' AND starts_with(file_path, 'src') GROUP BY 1")
add("adjacency_snapshot", lambda s, d: G.adjacency(graph(s, d), THOUGHT), f"{W}, s AS (SELECT from_id AS a, to_id AS b FROM e WHERE type IN ('relates-to', 'supports', 'contradicts', 'informed-by') UNION SELECT to_id, from_id FROM e WHERE type IN ('relates-to', 'supports', 'contradicts', 'informed-by')) SELECT a AS id, count(*) AS degree, string_agg(b, ',' ORDER BY b) AS neighbours FROM s WHERE a <> b AND a IN (SELECT id FROM l) AND b IN (SELECT id FROM l) GROUP BY 1")
add("stable_ids", lambda s, d: graph(s, d).live.select("id", S.stable_id(F.lit("practice"), F.col("source"), F.col("type"), F.col("symbol_name")).alias("sid")), f"{W} SELECT id, left(sha256('practice' || chr(0) || source || chr(0) || type || chr(0) || symbol_name), 16) AS sid FROM l")
add("ordered_compare", lambda s, d: graph(s, d).live.where((F.col("type") == "file") & (S.meta("size") != "") & S.compare("gte", S.meta("size"), 2000)).select("id"), f"{W} SELECT id FROM l WHERE type = 'file' AND {M(k='size')} <> '' AND {M(k='size')}::DOUBLE >= 2000")
add("code_result_filters", lambda s, d: G.code_results(graph(s, d), ""), f"{W} SELECT id, file_path FROM l WHERE type IN ('function', 'method', 'type') AND lower(test_kind) = '' AND NOT is_test")
add("genre_exclusion", lambda s, d: V.human_thoughts(graph(s, d)), f"{W} SELECT id FROM l WHERE type = 'thought' AND NOT starts_with(source, 'machine') AND NOT regexp_matches(lower(symbol_name), '^(auto|exported)')")
add("rule_query", lambda s, d: G.rule_scope(s.read.parquet(f"{d}/discovery_runs.parquet").select(F.col("discovery_path").alias("id"), "repo", F.coalesce("package_prefixes", F.array().cast("array<string>")).alias("prefixes")), "savrix-tools", "src/a.go").select("repo"), "SELECT DISTINCT repo FROM (SELECT repo, package_prefixes, unnest(CASE WHEN package_prefixes IS NULL OR len(package_prefixes) = 0 THEN [''] ELSE package_prefixes END) AS p FROM discovery_runs WHERE repo = 'savrix-tools') WHERE p = '' OR rtrim(p, '/') = 'src/a.go' OR starts_with('src/a.go', rtrim(p, '/') || '/')")
add("discovery_census", lambda s, d: s.read.parquet(f"{d}/discovery_runs.parquet").select(F.explode("excluded_by_rule").alias("rule", "n")).groupBy("rule").agg(F.sum("n").alias("excluded"), F.count(F.lit(1)).alias("repos")), "SELECT rule, sum(n)::BIGINT AS excluded, count(*) AS repos FROM (SELECT unnest(map_keys(excluded_by_rule)) AS rule, unnest(map_values(excluded_by_rule)) AS n FROM discovery_runs) GROUP BY 1")

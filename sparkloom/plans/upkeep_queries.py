"""Queries of sinks, logs, stored checks, plug-ins, pacing and other upkeep."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from sparkloom.functions import scalars as S
from sparkloom.operators import analyzers as A
from sparkloom.operators import graph as G
from sparkloom.operators import mutations as M
from sparkloom.operators import usage as U
from sparkloom.plans.analyzer_queries import CHECKS, code
from sparkloom.plans.recipe import Program, extract
from sparkloom.plans.recipe_queries import EMIT
from sparkloom.plans.registry import GRAPH_SQL, ORACLE_SQL, add, graph
from sparkloom.plans.source_queries import NOW, files
from sparkloom.runtime import shared_dir, table
from sparkloom.sources import documents as D
from sparkloom.sources import external, pdf, sessions

W = "WITH" + GRAPH_SQL
WR = "WITH RECURSIVE" + GRAPH_SQL


def _dir(s, name):
    return f"{shared_dir(s)}/sparkloom-{s.sparkContext.applicationId}/{name}-{os.urandom(4).hex()}"


# --- session rows
def _sink(s, d):
    path = _dir(s, "sessions")
    sessions.sink(table(s, d, "usage_rows").where("source is not null and source <> ''"), path)
    return path


add("session_sink", lambda s, d: s.read.parquet(_sink(s, d)).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("uuid").alias("uuids"), F.sum("duration_ms").alias("ms")), "SELECT source, count(*) AS n, count(DISTINCT uuid) AS uuids, sum(duration_ms)::BIGINT AS ms FROM usage_rows WHERE source <> '' GROUP BY 1")
add("transcript_listing", lambda s, d: sessions.enumerate_files(s, written=_sink(s, d)).where(F.col("path").endswith(".parquet")).select(F.regexp_extract("path", r"/source=([^/]*)/", 1).alias("source"), "size").groupBy("source").agg((F.min("size") > 0).alias("filled")), "SELECT DISTINCT source, true AS filled FROM usage_rows WHERE source <> ''")


def _log(s, d):
    """A layered log of the token rows and calls: a head line per session, then its rows."""
    r = table(s, d, "usage_rows").where("session_id <> ''").select("session_id", "uuid", "model", "record_ts", "input_tokens", "output_tokens", "cache_read_tokens", "tool_name", F.monotonically_increasing_id().alias("no"))
    payload = lambda kind, *c: F.to_json(F.struct(F.lit(kind).alias("type"), F.col("record_ts").alias("timestamp"), F.struct(*c).alias("payload")))
    usage = F.struct((F.coalesce("input_tokens", F.lit(0)) + F.coalesce("cache_read_tokens", F.lit(0))).alias("input_tokens"), F.coalesce("cache_read_tokens", F.lit(0)).alias("cached_input_tokens"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"), F.lit(3).alias("reasoning_output_tokens"))
    head = r.select("session_id").distinct().select("session_id", F.lit(-1).cast("long").alias("no"), F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.col("session_id").alias("id"), F.lit("/w").alias("cwd"), F.lit("1.0").alias("cli_version")).alias("payload"))).alias("value"))
    tokens = r.select("session_id", "no", payload("event_msg", F.lit("token_count").alias("type"), F.struct(usage.alias("last_token_usage")).alias("info")).alias("value"))
    calls = r.where("tool_name <> ''").select("session_id", (F.col("no") + 1).alias("no"), payload("response_item", F.lit("function_call").alias("type"), F.col("uuid").alias("call_id"), F.col("tool_name").alias("name")).alias("value"))
    noise = head.select("session_id", "no", F.lit("no json").alias("value"))
    return head.unionByName(tokens).unionByName(calls).unionByName(noise).select(F.col("session_id").alias("file"), F.col("no").alias("line_no"), "value")


add("layered_log", lambda s, d: sessions.parse_layered_log(_log(s, d)).groupBy("session_id", "project", "cli_version").agg(F.sum((F.col("record_type") == "token_count").cast("int")).alias("tokens"), F.sum((F.col("tool_name") != "").cast("int")).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cache_read_tokens").alias("cached")),
    "SELECT session_id, '/w' AS project, '1.0' AS cli_version, count(*) AS tokens, sum((coalesce(tool_name, '') <> '')::INT)::BIGINT AS calls, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(output_tokens, 0) + 3)::BIGINT AS output_tokens, sum(coalesce(cache_read_tokens, 0))::BIGINT AS cached FROM usage_rows WHERE session_id <> '' GROUP BY 1")


def _results(s, d):
    t = table(s, d, "documents").where("text is not null")
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    listed = F.to_json(F.array(part("text", F.col("text")), part("image", F.lit("")), part("text", F.lit("end"))))
    return t.select("doc_id", sessions.result_size(F.when(F.col("doc_id") % 3 == 0, listed).when(F.col("doc_id") % 3 == 1, F.col("title")).otherwise(F.lit("Output too large (1.5 KB) saved"))).alias("r")).select("doc_id", "r.bytes", "r.images", "r.spilled")


add("result_sizes", _results, "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN strlen(text) + 3 WHEN 1 THEN strlen(coalesce(title, '')) ELSE 1536 END AS bytes, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS images, doc_id % 3 = 2 AS spilled FROM documents WHERE text IS NOT NULL")
add("usage_scope_single", lambda s, d: U.intake(table(s, d, "usage_rows"), scope="single", session_id=_busiest(s, d), agent_id="").groupBy("record_type").agg(F.count(F.lit(1)).alias("n")),
    "WITH b AS (SELECT session_id AS x FROM usage_rows WHERE session_id <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT coalesce(record_type, '') AS record_type, count(*) AS n FROM usage_rows, b WHERE session_id = x AND coalesce(agent_id, '') = '' AND coalesce(model, '') <> '<synthetic>' AND NOT coalesce(is_meta, false) GROUP BY 1")
add("usage_scope_time_range", lambda s, d: U.intake(table(s, d, "usage_rows"), scope="time_range", since="2026-01-10T00:00:00Z", until="2026-01-20T00:00:00Z").groupBy("project").agg(F.count(F.lit(1)).alias("n")),
    r"WITH x AS (SELECT coalesce(project, '') AS project, try_cast(CASE WHEN regexp_matches(record_ts, '^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$') THEN upper(record_ts) END AS TIMESTAMPTZ) AS t FROM usage_rows WHERE coalesce(model, '') <> '<synthetic>' AND NOT coalesce(is_meta, false)) SELECT project, count(*) AS n FROM x WHERE t >= '2026-01-10T00:00:00Z'::TIMESTAMPTZ AND t < '2026-01-20T00:00:00Z'::TIMESTAMPTZ GROUP BY 1")


def _busiest(s, d):
    r = table(s, d, "usage_rows").where("session_id <> ''").groupBy("session_id").count().orderBy(F.desc("count"), "session_id").first()
    return r.session_id if r else ""


# --- scalars
add("durations", lambda s, d: table(s, d, "usage_rows").select("uuid", F.concat((F.coalesce("duration_ms", F.lit(0)) % 50).cast("string"), F.lit("h"), (F.coalesce("output_tokens", F.lit(0)) % 60).cast("string"), F.lit("m1.5s")).alias("text")).select("uuid", F.round(S.duration_seconds(F.col("text")), 3).alias("seconds"), S.duration_seconds(F.concat("text", F.lit("x"))).isNull().alias("refused")),
    "SELECT uuid, round((coalesce(duration_ms, 0) % 50) * 3600 + (coalesce(output_tokens, 0) % 60) * 60 + 1.5, 3)::DOUBLE AS seconds, true AS refused FROM usage_rows")
add("truncated_texts", lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", F.length(S.clamp(F.col("text"))).alias("kept"), F.md5(F.encode(S.clamp(F.col("text"), 40), "UTF-8")).alias("head")), "SELECT doc_id, length(left(text, 500)) AS kept, md5(left(text, 40)) AS head FROM documents WHERE text IS NOT NULL")
add("registered_function", lambda s, d: _with_builtin(s, d), f"{W} SELECT 'r-' || reverse(id) AS name FROM l WHERE type = 'thought_session'")


def _with_builtin(s, d):
    if "reversed" not in S.BUILTINS:
        S.register_builtin("reversed", F.reverse)
    return Program('select thought_session\nemit note {\n name := concat("r-", reversed(node.id))\n}', graph(s, d)).run()["nodes"].select("name")


# --- mutations
_NEW = lambda s, d: table(s, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.lit("document").alias("type"), F.coalesce("title", F.lit("")).alias("symbol_name"))
add("create_batch", lambda s, d: M.create(graph(s, d).live, _NEW(s, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")), f"{W} SELECT type, count(*) AS n, min(id) AS first FROM l GROUP BY 1 UNION ALL SELECT 'document', count(*), min('doc-' || doc_id) FROM documents")
add("link_batch", lambda s, d: M.link(graph(s, d).edges, graph(s, d).edges.limit(50)).groupBy("type").agg(F.count(F.lit(1)).alias("n")), f"{W} SELECT type, count(*) AS n FROM e GROUP BY 1")
add("collection_epochs", lambda s, d: M.drop_stale_epochs(files(s, d).select("id", F.lit(1).alias("epoch")).unionByName(files(s, d).where("substr(id, 1, 1) < '8'").select("id", F.lit(2).alias("epoch")))), f"{W} SELECT id, CASE WHEN left(id, 1) < '8' THEN 2 ELSE 1 END AS epoch FROM l WHERE type = 'file'")
add("cache_reconciliation", lambda s, d: _cache(s, d), f"{W}, h AS (SELECT median(updated_at)::BIGINT AS h FROM l), x AS (SELECT count(*) AS rows, max(updated_at) AS cursor FROM l, h WHERE updated_at <= h) SELECT rows, cursor, true AS holds FROM x")


def _cache(s, d):
    live = graph(s, d).live.select("updated_at")
    h = int(live.agg(F.floor(F.median("updated_at"))).first()[0] or 0)
    p = live.where(F.col("updated_at") <= h).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("updated_at"), F.lit(0)).alias("m")).first()
    return M.cache_state(live, p.n, h, p.m)


_MARK = 1_770_000_000_000_000_000
add("progress_watermark", lambda s, d: M.progress_mark(table(s, d, "search_docs"), _MARK, grace=86_400_000_000_000), f"WITH t AS (SELECT greatest({_MARK}, max(updated_at) - 86400000000000) AS safe FROM search_docs) SELECT {_MARK} AS mark, count(*) AS pending, coalesce(max(updated_at), {_MARK}) AS next_mark FROM search_docs, t WHERE updated_at > {_MARK} AND updated_at <= safe")
_JIT = "('0x' || left(sha256(uuid || ':' || a), 8))::BIGINT / 4294967296.0::DOUBLE / 2"
add("retry_backoff", lambda s, d: table(s, d, "usage_rows").where("uuid is not null").select("uuid", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("a")).select("uuid", "a", M.backoff_ms(F.col("a"), F.col("uuid")).alias("ms")).distinct(),
    f"SELECT DISTINCT uuid, a::INT AS a, floor(least(60000.0::DOUBLE, 1000.0::DOUBLE * pow(2, a - 1)) * (1 - {_JIT}))::BIGINT AS ms FROM (SELECT DISTINCT uuid FROM usage_rows WHERE uuid IS NOT NULL), (SELECT unnest(range(1, 9)) AS a)")
add("rate_gate", lambda s, d: M.pace(files(s, d).select("id", F.col("source").alias("axis")), 600), f"{W}, r AS (SELECT id, source AS axis, row_number() OVER (PARTITION BY source ORDER BY left(sha256(id), 3), id) - 1 AS k FROM l WHERE type = 'file') SELECT id, axis, floor(k * 100.0)::BIGINT AS send_ms FROM r")

# --- programs
add("recipe_extract_page", lambda s, d: extract(Program(EMIT, graph(s, d)).run()["nodes"].select("id", "type", "name"), offset=5, max_rows=7)[0], ORACLE_SQL["recipe_emit"] + " ORDER BY id LIMIT 7 OFFSET 5")
add("recipe_extract_total", lambda s, d: extract(Program(EMIT, graph(s, d)).run()["nodes"].select("id", "type", "name"))[1], f"SELECT count(*) AS total FROM ({ORACLE_SQL['recipe_emit']})")

# --- analyzers
add("finding_lines", lambda s, d: A.render(A.findings(G.degrees(G.analyzer_edges(graph(s, d)), graph(s, d).live), "degree", "fan_in", 15)).select("rank", "line"),
    f"""{W}, k AS (SELECT DISTINCT from_id AS a, to_id AS b FROM e WHERE from_id <> to_id AND from_id IN (SELECT id FROM l) AND to_id IN (SELECT id FROM l)), dg AS (SELECT l.id, count(k.a) AS v FROM l LEFT JOIN k ON k.b = l.id GROUP BY 1), p AS (SELECT id, v, 100.0 * (rank() OVER (ORDER BY v) - 1) / count(*) OVER () AS pc, row_number() OVER (ORDER BY v DESC, id) AS rank FROM dg)
SELECT rank::INT AS rank, '{{"algorithm":"degree","rank":' || rank || ',"id":"' || id || '","severity":"' || CASE WHEN pc >= 99 THEN 'critical' WHEN pc >= 95 THEN 'warning' WHEN pc >= 80 THEN 'notice' ELSE 'info' END || '","title":"degree #' || rank || '"}}' AS line FROM p WHERE rank <= 15""")
add("registered_analyzer", lambda s, d: _with_analyzer(s, d), f"{W} SELECT to_id AS id, count(DISTINCT from_id) AS callers FROM e WHERE type = 'CALLS' AND from_id <> to_id AND from_id IN (SELECT id FROM l) AND to_id IN (SELECT id FROM l) GROUP BY 1")


def _with_analyzer(s, d):
    if "callers" not in A.REGISTRY:
        A.analyzer("callers")(lambda nodes, edges: edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers")))
    return A.run("callers", *code(s, d, ["CALLS"]))


def _with_redundancy(s, d):
    if "doubled" not in A.REDUNDANCY:
        A.register_redundancy("doubled", lambda n: F.when(n > 2, 2 / n).otherwise(F.lit(1.0)))
    n, e = code(s, d, ["CALLS"])
    n = n.select("id", F.create_map(F.lit("resource_type"), F.when(F.left("id", F.lit(1)) < "8", F.lit("doubled")).otherwise(F.lit("other")), F.lit("replicas"), F.lit("8")).alias("metadata"))
    return A.run("blast_radius", n, e, seeds=n.select("id"), depth=2).select("seed", "impacted", F.round("score", 6).alias("score"))


add("blast_radius_redundant", _with_redundancy, f"{WR}, k AS (SELECT DISTINCT to_id AS a, from_id AS b FROM e WHERE type = 'CALLS' AND from_id <> to_id AND from_id IN (SELECT id FROM l) AND to_id IN (SELECT id FROM l)), v AS (SELECT id FROM l WHERE type IN ('function', 'method', 'type')), r AS (SELECT id AS seed, id, 0 AS d FROM v UNION SELECT seed, k.b, d + 1 FROM r JOIN k ON k.a = r.id WHERE d < 2), m AS (SELECT seed, id, min(d) AS d FROM r GROUP BY 1, 2) SELECT seed, count(*) AS impacted, round(sum(CASE WHEN left(m.id, 1) < '8' THEN 0.25 ELSE 1 END::DOUBLE / d), 6) AS score FROM m JOIN v ON v.id = m.id WHERE d > 0 GROUP BY 1")


def _stored_checks(s, d):
    g, store = graph(s, d), None
    for c in CHECKS:
        # a graph in which the check finds something, and the empty one in which it does not
        bad = g if "max" in c else G.Graph(g.nodes, g.edges.limit(0))
        store = A.create_check(store, c, bad, G.Graph(g.nodes.limit(0), g.edges.limit(0)))
    return store


add("checks_listing", lambda s, d: A.list_checks(_stored_checks(s, d)).select("name", "node_type", "edge_type", "direction"), "SELECT * FROM (VALUES ('called', 'function', 'CALLS', 'in'), ('fan', 'type', 'CALLS', 'out'), ('held', 'method', 'CONTAINS', 'in')) t(name, node_type, edge_type, direction)")
add("checks_run", lambda s, d: A.run_checks(_stored_checks(s, d), graph(s, d)), ORACLE_SQL["corpus_scan"])

# --- sources
add("flow_reach", lambda s, d: D.flow_matches(files(s, d).where("lower(language) = 'python'"), "x", "total"))


def _pdfs(s, d):
    """One page for every document title, with its letters and digits as the text at a known place."""
    title = F.regexp_replace(F.coalesce("title", F.lit("")), r"[^A-Za-z0-9 ]", "")
    body = F.concat(F.lit("BT /F1 12 Tf 72 700 Td ("), title, F.lit(") Tj ET"))
    text = F.concat(F.lit("%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R] /Count 1>> endobj\n3 0 obj <</Type /Page /MediaBox [0 0 612 792] /Contents 4 0 R /Resources <</Font <</F1 5 0 R>>>>>> endobj\n4 0 obj <</Length "),
                    F.length(body).cast("string"), F.lit(">> stream\n"), body, F.lit("\nendstream endobj\n5 0 obj <</Type /Font /BaseFont /Serif>> endobj\ntrailer <</Root 1 0 R>>\n%%EOF"))
    return table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(text, "UTF-8").alias("content"), title.alias("t")).where("trim(t) <> ''")


add("pdf_runs", lambda s, d: pdf.runs_of(_pdfs(s, d)).select("doc", "page", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round("size", 2).alias("size"), "font", F.trim("text").alias("text")),
    "WITH x AS (SELECT doc_id::VARCHAR AS doc, regexp_replace(coalesce(title, ''), '[^A-Za-z0-9 ]', '', 'g') AS t FROM documents) SELECT doc, 0 AS page, 72.0::DOUBLE AS x, 92.0::DOUBLE AS y, 12.0::DOUBLE AS size, 'Serif' AS font, trim(t) AS text FROM x WHERE trim(t) <> ''")
add("collect_hooks", lambda s, d: _hooked(s, d), f"{W} SELECT 'files' AS collector, count(*) AS nodes, (SELECT count(*) FROM e WHERE type = 'CONTAINS') AS edges FROM l WHERE type = 'file'")


def _hooked(s, d):
    if not external.HOOKS.get("files"):
        external.add_hook("files", lambda n, e: n.agg(F.count(F.lit(1)).alias("nodes")).join(e.agg(F.count(F.lit(1)).alias("edges")), F.lit(True)))  # one row each
    return external.run_hooks("files", graph(s, d).live.where("type = 'file'"), graph(s, d).edges.where("type = 'CONTAINS'"))[0].select(F.lit("files").alias("collector"), "nodes", "edges")


add("prune_selected_session", lambda s, d: M.prune_selection(graph(s, d).live, "thought", "30d", NOW).agg(F.count(F.lit(1)).alias("n")), f"{W} SELECT count(*) AS n FROM l WHERE type = 'thought' AND created_at < {NOW} - 30 * 86400000000000")

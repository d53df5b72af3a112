"""Queries of sources, mutations, upkeep and streaming."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from sparkloom.functions import scalars as S
from sparkloom.operators import graph as G
from sparkloom.operators import mutations as M
from sparkloom.plans.registry import GRAPH_SQL, add, graph
from sparkloom.runtime import delete_on_exit, shared_dir, table
from sparkloom.sources import documents as D
from sparkloom.sources import external, sessions
from sparkloom.streaming import jobs

W = "WITH" + GRAPH_SQL
NOW = 1_785_000_000_000_000_000


def pages(s, d):
    """A page for every document, of a shape that varies with its id: kinds of lists, a table, links to its own and other hosts, nested sections."""
    n = F.expr("doc_id div 6")
    title = F.regexp_replace(F.coalesce("title", F.lit("")), "[<>&]", " ")
    body = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[<>&]", " "), r"\n\s*\n", "</p><p>")
    items = lambda k, link: F.concat_ws("", F.transform(F.sequence(F.lit(1), k), lambda i: F.concat(F.lit("<li>"), link(i), F.lit("</li>"))))
    inner = lambda i: F.concat(F.lit("<a href='/p"), i.cast("string"), F.lit("'>page "), i.cast("string"), F.lit("</a>"))
    nav = F.when(n % 2 == 0, F.concat(F.lit("<nav><ul>"), items((n % 4 + 1).cast("int"), inner), F.lit("</ul></nav>"))).otherwise(F.lit(""))
    plain = F.when(n % 3 == 0, F.concat(F.lit("<ol>"), items((n % 5 + 2).cast("int"), lambda i: F.concat(F.lit("step "), i.cast("string"), F.lit(" of some length that no menu has"))), F.lit("</ol>"))).otherwise(F.lit(""))
    cells = F.when(n % 5 == 0, F.lit("<table><tr><th>name</th><th>size</th></tr><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table>")).otherwise(F.lit(""))
    out = F.when(n % 7 < 3, F.concat(F.lit("<p>See <a href='https://other"), (n % 7).cast("string"), F.lit(".example/x'>there</a> and <a href='#top'>top</a>.</p>"))).otherwise(F.lit(""))
    html = F.concat(F.lit("<html><head><title>"), title, F.lit("</title></head><body>"), nav, F.lit("<h1>"), title, F.lit("</h1><p>"), body, F.lit("</p>"), plain, cells, out, F.lit("<script>x()</script></body></html>"))
    return table(s, d, "documents").select(F.concat(F.lit("https://docs.example/"), F.col("doc_id").cast("string")).alias("url"), html.alias("html"))


def files(s, d):
    return graph(s, d).live.where("type = 'file'").select("id", "file_path", "language", "content", "source")


add("session_scan", lambda s, d: sessions.scan(s, f"{d}/usage_rows.parquet").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("output_tokens").alias("output_tokens")), "SELECT source, count(*) AS n, sum(output_tokens)::BIGINT AS output_tokens FROM usage_rows GROUP BY 1")
# what the shapes of pages() hold, by the id of the document
_SHAPES = """WITH p AS (SELECT doc_id // 6 AS n, len(list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '[<>&]', ' ', 'g'), '\\n\\s*\\n'), lambda x: regexp_matches(x, '\\S'))) AS parts FROM documents),
x AS (SELECT 'page' AS type, count(*) AS n FROM p UNION ALL SELECT 'section', count(*) FROM p UNION ALL SELECT 'list', sum((n % 2 = 0)::INT + (n % 3 = 0)::INT) FROM p UNION ALL SELECT 'list_item', sum((n % 2 = 0)::INT * (n % 4 + 1) + (n % 3 = 0)::INT * (n % 5 + 2)) FROM p
  UNION ALL SELECT 'table', sum((n % 5 = 0)::INT) FROM p UNION ALL SELECT 'link', sum((n % 2 = 0)::INT * (n % 4 + 1) + (n % 7 < 3)::INT) FROM p UNION ALL SELECT 'paragraph', sum(parts + (n % 7 < 3)::INT) FROM p)"""
add("html_tree", lambda s, d: D.html_tree(pages(s, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n")), f"{_SHAPES} SELECT type, n::BIGINT AS n FROM x WHERE n > 0")
add("html_list_classes", lambda s, d: D.html_tree(pages(s, d)).where("type in ('list', 'table')").groupBy("type", F.col("metadata")["class"].alias("class")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT * FROM (SELECT 'list' AS type, 'nav' AS class, count(*) AS n FROM documents WHERE doc_id // 6 % 2 = 0 UNION ALL SELECT 'list', 'content', count(*) FROM documents WHERE doc_id // 6 % 3 = 0 UNION ALL SELECT 'table', 'data', count(*) FROM documents WHERE doc_id // 6 % 5 = 0) WHERE n > 0")
add("html_edges", lambda s, d: D.tree_edges(D.html_tree(pages(s, d))).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("to_id").alias("ends")), f"{_SHAPES} SELECT 'CONTAINS' AS type, sum(n)::BIGINT AS n, sum(n)::BIGINT AS ends FROM x WHERE type <> 'page'")
add("link_classes", lambda s, d: D.classify_links(D.html_tree(pages(s, d))).groupBy("class").agg(F.count(F.lit(1)).alias("n")), "SELECT 'internal' AS class, sum(doc_id // 6 % 4 + 1)::BIGINT AS n FROM documents WHERE doc_id // 6 % 2 = 0 UNION ALL SELECT 'external', count(*) FROM documents WHERE doc_id // 6 % 7 < 3")
_MEDIA = lambda: F.when(F.expr("doc_id div 6") % 4 == 0, "Text/HTML; charset=utf-8").when(F.expr("doc_id div 6") % 4 == 1, "application/pdf").when(F.expr("doc_id div 6") % 4 == 2, "image/png")
_BODY = lambda: F.when(F.expr("doc_id div 6") % 3 == 0, F.concat(F.lit(" \n<HTML><p>"), F.col("title"))).when(F.expr("doc_id div 6") % 3 == 1, F.lit("%PDF-1.7 x")).otherwise(F.lit("plain words"))
add("page_classes", lambda s, d: table(s, d, "documents").select(D.classify_page(_MEDIA(), _BODY()).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n")),
    "SELECT CASE WHEN doc_id // 6 % 4 = 0 THEN 'html' WHEN doc_id // 6 % 4 = 1 THEN 'pdf' WHEN doc_id // 6 % 4 = 2 THEN 'other' WHEN doc_id // 6 % 3 = 0 AND title IS NOT NULL THEN 'html' WHEN doc_id // 6 % 3 = 1 THEN 'pdf' ELSE 'text' END AS class, count(*) AS n FROM documents GROUP BY 1")
add("crawl_bfs", lambda s, d: D.crawl(pages(s, d), table(s, d, "documents").select(F.concat(F.lit("https://docs.example/"), F.col("doc_id").cast("string")).alias("from_url"), F.concat(F.lit("HTTPS://Docs.Example/"), (F.col("doc_id") * 2).cast("string"), F.lit("/#x")).alias("to_url")), table(s, d, "documents").where("doc_id % 100 = 0").select(F.concat(F.lit("https://docs.example/"), F.col("doc_id").cast("string")).alias("url")), max_depth=5))
_URL = lambda: F.element_at(F.array(*[F.concat(F.lit(a), F.col("doc_id").cast("string"), F.lit(z)) for a, z in ((" HTTP://Ex", ".COM/Path/?Q=1#f"), ("https://A.example:8080/", "/b//"), ("HTTPS://B.example", ""), ("ftp://C.example/", "?x=/#y#z"), ("no scheme ", "/a"))]), (F.expr("doc_id div 6") % 5 + 1).cast("int"))
add("url_canonical", lambda s, d: table(s, d, "documents").select("doc_id", S.canonical_url(_URL()).alias("u")),
    "SELECT doc_id, CASE doc_id // 6 % 5 WHEN 0 THEN 'http://ex' || doc_id || '.com/Path?Q=1' WHEN 1 THEN 'https://a.example:8080/' || doc_id || '/b' WHEN 2 THEN 'https://b.example' || doc_id WHEN 3 THEN 'ftp://c.example/' || doc_id || '?x=/' ELSE '' END AS u FROM documents")
add("layout_blocks", lambda s, d: D.chunk_sections(D.layout_blocks(_runs(s, d))).groupBy("kind").agg(F.count(F.lit(1)).alias("n")))


def _runs(s, d):
    t = table(s, d, "documents").where(F.col("text").rlike(r"\S")).select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", r"\r?\n")).alias("i", "text")).where(F.trim("text") != "")
    page, line = F.floor(F.col("i") / 40), F.col("i") % 40
    body = t.select("doc", page.cast("int").alias("page"), F.lit(50.0).alias("x"), (60.0 + line * 12).alias("y"), F.when(F.col("text").startswith("#"), F.lit(16.0)).otherwise(F.lit(10.0)).alias("size"), F.lit("Serif").alias("font"), "text")
    head = body.select("doc", "page").distinct().select("doc", "page", F.lit(50.0).alias("x"), F.lit(20.0).alias("y"), F.lit(8.0).alias("size"), F.lit("Serif").alias("font"), F.format_string("Report - page %d", "page").alias("text"))
    return body.unionByName(head)


add("code_chunks", lambda s, d: D.chunk_files(files(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n")))
add("code_chunk_calls", lambda s, d: D.chunk_files(files(s, d)).select("file_id", "name", F.explode("calls").alias("call")).groupBy("call").agg(F.count(F.lit(1)).alias("n")))
add("ast_match", lambda s, d: D.ast_matches(files(s, d).where("lower(language) = 'python'"), "sum($X for $Y in $Z if $W)").groupBy("file_id").agg(F.count(F.lit(1)).alias("n")),
    f"{W} SELECT id AS file_id, (length(replace(content, chr(13), '')) - length(replace(replace(content, chr(13), ''), 'sum(x.', 'sum(.'))) AS n FROM l WHERE type = 'file' AND lower(language) = 'python' AND contains(content, 'sum(x.')")
add("ast_count", lambda s, d: D.ast_matches(files(s, d).where("lower(language) = 'python'"), "raise $E($$$A)").groupBy(F.col("captures")["E"].alias("error")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_id").alias("files")))
add("ast_replace", lambda s, d: D.ast_replace(files(s, d).where("lower(language) = 'python'"), "len($X)", "size($X)").groupBy("ok").agg(F.count(F.lit(1)).alias("files"), F.sum("edits").alias("edits")))
_RUNS = lambda s, d: table(s, d, "discovery_runs").select(F.col("repo").alias("source"), F.col("package_prefixes").alias("prefixes"), F.col("lift_exclusions").alias("lift"))
_Q = lambda xs: ", ".join(f"'{x}'" for x in xs)
_DISCOVERY = f"""{W}, f AS (SELECT id, source, file_path, content, string_split(file_path, '/') AS parts FROM l WHERE type = 'file'),
r AS (SELECT repo AS source, bool_or(lift_exclusions) AS lift, bool_or(len(coalesce(package_prefixes, [])) = 0) AS whole, flatten(list(list_transform(coalesce(package_prefixes, []), lambda x: rtrim(x, '/')))) AS cuts FROM discovery_runs GROUP BY 1),
c AS (SELECT f.*, parts[-1] AS name, regexp_extract(parts[-1], '\\.([^.]*)$', 1) AS ext, coalesce(lift, false) AS lifted FROM f LEFT JOIN r USING (source) WHERE coalesce(whole, true) OR len(list_filter(cuts, lambda x: file_path = x OR starts_with(file_path, x || '/'))) > 0),
k AS (SELECT *, CASE WHEN lifted THEN '' WHEN ext IN ({_Q(D.SKIP_EXTENSIONS)}) THEN 'skip_extension' WHEN name IN ({_Q(D.SKIP_FILES)}) THEN 'skip_lockfile' WHEN {" OR ".join(f"name LIKE '%{x}'" for x in D.SKIP_DTS)} THEN 'skip_dts'
  WHEN name LIKE '%.pb.go' OR (regexp_matches(name, '_gen(erated)?\\.go$') AND regexp_matches(regexp_replace(left(content, 4096), '(?ms)^package .*', ''), '(?m)^// Code generated .* DO NOT EDIT\\.\\r?$')) THEN 'skip_generated_go'
  WHEN list_has_any(parts[:-2], [{_Q(D.SKIP_PARTS)}]) THEN 'skip_path_component' WHEN lower(ext) NOT IN ({_Q(D.KNOWN_EXTENSIONS)}) AND name NOT IN ({_Q(D.KNOWN_NAMES)}) THEN 'skip_unknown_lang' WHEN strlen(content) > {D.MAX_FILE_BYTES} THEN 'skip_too_large' ELSE '' END AS rule FROM c)"""
add("file_discovery", lambda s, d: D.discover(files(s, d), _RUNS(s, d))[0].select("id"), f"{_DISCOVERY} SELECT id FROM k WHERE rule = ''")
add("file_discovery_census", lambda s, d: D.discover(files(s, d), _RUNS(s, d))[1].select("source", "rule", "n", "truncated", F.array_join("samples", " ").alias("samples")), f"""{_DISCOVERY}, x AS (SELECT source, rule, count(*) AS n, string_agg(file_path, ' ' ORDER BY file_path) FILTER (p <= 5) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY source, rule ORDER BY file_path) AS p FROM k WHERE rule <> '') GROUP BY 1, 2),
y AS (SELECT source, unnest([{_Q(D.DISCOVERY_RULES)}]) AS rule FROM r) SELECT source, rule, coalesce(n, 0) AS n, coalesce(n, 0) > 5 AS truncated, coalesce(samples, '') AS samples FROM y FULL JOIN x USING (source, rule)""")


add("dockerfile_links", lambda s, d: G.dockerfile_links(files(s, d).select("id", "file_path", "content").unionByName(files(s, d).select(F.concat(F.lit("docker-"), "id").alias("id"), F.concat(F.regexp_extract("file_path", r"^(.*/)[^/]*$", 1), F.lit("Dockerfile")).alias("file_path"), F.concat(F.lit("FROM x\nCOPY ./"), F.regexp_extract("file_path", r"([^/]*)$", 1), F.lit(" /app\n")).alias("content")))).select("docker_id", "target_id"),
    f"{W} SELECT 'docker-' || a.id AS docker_id, b.id AS target_id FROM l a JOIN l b ON a.file_path = b.file_path AND a.type = 'file' AND b.type = 'file'")
add("external_collector", lambda s, d: _collector(s))


def _collector(s):
    external.register(s)
    items = [{"kind": "node", "id": "n1", "type": "page"}, {"kind": "edge", "from_id": "n1", "to_id": "n2", "type": "CONTAINS", "weight": 2}]
    cmd = "\n".join("echo '" + json.dumps(x) + "'" for x in items)
    return s.read.format("collector").option("commands", cmd).load().select("kind", "id", "type", "from_id", "to_id", "weight")


# --- mutations and upkeep
def _ch(s, d):
    return graph(s, d).live.where("type = 'thought' and status = ''").select("id", F.lit("reviewed").alias("status"), F.create_map(F.lit("seen"), F.lit("1")).alias("metadata"))


add("update_batch", lambda s, d: M.update(graph(s, d).live, _ch(s, d), NOW).where("type = 'thought'").select("id", "status", S.meta("seen").alias("seen"), S.meta("cluster_id").alias("cluster"), "updated_at"),
    f"{W} SELECT id, CASE WHEN status = '' THEN 'reviewed' ELSE status END AS status, CASE WHEN status = '' THEN '1' ELSE '' END AS seen, coalesce(element_at(metadata, 'cluster_id')[1], '') AS cluster, CASE WHEN status = '' THEN {NOW} ELSE updated_at END AS updated_at FROM l WHERE type = 'thought'")
add("upsert_latest", lambda s, d: M.upsert(table(s, d, "nodes").where("tombstoned_at = 0").select("id", "updated_at", "type"), table(s, d, "nodes").select("id", F.lit(1_900_000_000_000_000_000).alias("updated_at"), F.lit("moved").alias("type")).where("substr(id, 1, 1) = 'b'"), ["id"], "updated_at"),
    f"SELECT id, CASE WHEN left(id, 1) = 'b' THEN 1900000000000000000 ELSE max(updated_at) END AS updated_at, CASE WHEN left(id, 1) = 'b' THEN 'moved' ELSE arg_max(type, updated_at) END AS type FROM nodes WHERE tombstoned_at = 0 OR left(id, 1) = 'b' GROUP BY id")
add("unlink", lambda s, d: M.unlink(graph(s, d).edges, graph(s, d).edges.where("type = 'CALLS'")).groupBy("type").agg(F.count(F.lit(1)).alias("n")), f"{W} SELECT type, count(*) AS n FROM e WHERE type <> 'CALLS' GROUP BY 1")
add("delete_soft", lambda s, d: M.delete(graph(s, d).nodes, graph(s, d).edges, graph(s, d).live.where("type = 'charge'"), NOW)[0].groupBy("type", (F.col("tombstoned_at") > 0).alias("gone")).agg(F.count(F.lit(1)).alias("n")), f"{W} SELECT type, (type = 'charge' OR tombstoned_at > 0) AS gone, count(*) AS n FROM n GROUP BY 1, 2")
add("delete_hard", lambda s, d: M.delete(graph(s, d).nodes, graph(s, d).edges, graph(s, d).live.where("type = 'charge'"), NOW, hard=True)[1].groupBy("type").agg(F.count(F.lit(1)).alias("n")), f"{W} SELECT type, count(*) AS n FROM e WHERE from_id NOT IN (SELECT id FROM l WHERE type = 'charge') AND to_id NOT IN (SELECT id FROM l WHERE type = 'charge') GROUP BY 1")
add("prune_by_age", lambda s, d: M.prune_selection(graph(s, d).live, "thought", "90d", NOW), f"{W} SELECT id FROM l WHERE type = 'thought' AND created_at < {NOW} - 90 * 86400000000000")


def _manifests(s, d):
    f = files(s, d)
    return M.content_hash(f, "id", ["file_path", "content"]), M.content_hash(f.where("substr(id, 1, 1) <> 'a'").withColumn("content", F.when(F.substring("id", 1, 1) == "b", F.lit("old")).otherwise(F.col("content"))).unionByName(f.where("substr(id, 1, 1) = 'c'").withColumn("id", F.concat("id", F.lit("x")))), "id", ["file_path", "content"])


add("manifest_diff", lambda s, d: M.manifest_diff(*_manifests(s, d)), f"{W}, f AS (SELECT id FROM l WHERE type = 'file') SELECT id AS key, 'insert' AS change FROM f WHERE left(id, 1) = 'a' UNION ALL SELECT id, 'update' FROM f WHERE left(id, 1) = 'b' UNION ALL SELECT id || 'x', 'delete' FROM f WHERE left(id, 1) = 'c'")
add("upload_narrowing", lambda s, d: M.narrow(graph(s, d).live.select("id", "file_path"), files(s, d).where("substr(id, 1, 1) = 'a'").select(F.col("file_path").alias("key"))).select("id"), f"{W} SELECT id FROM l WHERE file_path = '' OR file_path IN (SELECT file_path FROM l WHERE type = 'file' AND left(id, 1) = 'a' AND file_path <> '')")
add("upload_chunks", lambda s, d: M.drop_stale_epochs(M.upload_chunks(files(s, d), 20_000, 2).unionByName(M.upload_chunks(files(s, d), 20_000, 1))).groupBy("epoch").agg(F.count(F.lit(1)).alias("n")), f"{W} SELECT 2 AS epoch, count(*) AS n FROM l WHERE type = 'file'")
_GF = lambda s, d: files(s, d).select(F.col("id").alias("path"), F.octet_length("content").cast("long").alias("size"), (F.conv(F.substring("id", 1, 6), 16, 10).cast("long") % 40000).alias("mtime"))
add("upload_gate", lambda s, d: M.upload_gate(_GF(s, d), _GF(s, d).where("substr(path, 1, 1) <> 'f'").select("path", (F.col("size") + F.when(F.substring("path", 2, 1) < "8", F.lit(1)).otherwise(F.lit(0))).alias("size"), F.when(F.substring("path", 2, 1) < "8", F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"), F.lit(3).alias("version"), F.lit(False).alias("seed")), 20_000, 3),
    f"{W}, f AS (SELECT id AS path, ('0x' || left(id, 6))::BIGINT % 40000 AS mtime FROM l WHERE type = 'file') SELECT path, CASE WHEN left(path, 1) = 'f' THEN 'ship' WHEN substr(path, 2, 1) >= '8' THEN 'skip' WHEN 20000 - mtime >= 900 THEN 'ship' ELSE 'defer' END AS action FROM f")
add("dirty_buckets", lambda s, d: M.dirty_buckets(table(s, d, "search_docs").select("id").distinct(), table(s, d, "search_docs").select("id").where("substr(id, 1, 2) = 'a1'"), 6), "WITH b AS (SELECT DISTINCT id, (('0x' || left(sha256(id), 8))::BIGINT) % 64 AS bucket FROM search_docs WHERE id IS NOT NULL) SELECT id, bucket FROM b WHERE bucket IN (SELECT bucket FROM b WHERE left(id, 2) = 'a1')")
add("tombstone_union", lambda s, d: M.tombstone_union(graph(s, d).nodes.where("tombstoned_at > 0"), graph(s, d).live.where("type = 'type'"), graph(s, d).live.where("type = 'method'").select(M.bucket_of(F.col("id"), 8).alias("bucket")).limit(0).union(s.createDataFrame([(1,), (2,)], "bucket long")), 4), f"{W} SELECT id FROM n WHERE (tombstoned_at > 0 OR type = 'type') AND (('0x' || left(sha256(id), 8))::BIGINT) % 16 NOT IN (1, 2)")
add("compaction_plan", lambda s, d: M.compaction_plan(table(s, d, "search_docs").groupBy(M.bucket_of(F.col("id"), 3).alias("segment")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("vector").isNull().cast("int") * 60).alias("dead"))), "WITH x AS (SELECT (('0x' || left(sha256(id), 8))::BIGINT) % 8 AS segment, count(*) AS docs, sum((vector IS NULL)::INT * 60) AS dead FROM search_docs GROUP BY 1) SELECT segment, dead / greatest(docs, 1) > 0.33 OR (SELECT count(*) FROM x) > 16 AS merge FROM x")


# --- streaming
def _stream_dir(s, name):
    return f"{shared_dir(s)}/sparkloom-stream-{s.sparkContext.applicationId}-{os.urandom(4).hex()}/{name}"


def _events(s, d):
    e = table(s, d, "events")
    return s.readStream.schema(e.schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(s, df, mode="append"):
    name = "q" + os.urandom(4).hex()
    jobs.run_once(df, name, _stream_dir(s, "checkpoint"), mode).awaitTermination()
    return s.table(name)


def _sessions(s, d):
    base = _stream_dir(s, "sessions")
    jobs.activity_sessions(_events(s, d), f"{base}/table", f"{base}/checkpoint").awaitTermination()
    delete_on_exit(s, base)
    return jobs.sessions_of(s, f"{base}/table")


def _feed(s, d):
    """Two deliveries of search records applied version by version; the result is the latest row per id."""
    base = _stream_dir(s, "feed")
    docs = table(s, d, "search_docs").where("id is not null").select("id", "updated_at", "dtype")
    for k in range(2):
        docs.where(F.pmod(F.xxhash64("id", "updated_at"), F.lit(2)) == k).write.mode("append").parquet(f"{base}/delta")
        jobs.change_feed(s, f"{base}/delta", docs.schema, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return jobs.current(s, f"{base}/table").select("id", "updated_at")


add("stream_change_feed", _feed, "SELECT id, max(updated_at) AS updated_at FROM search_docs WHERE id IS NOT NULL GROUP BY 1")
add("stream_tumbling_windows", lambda s, d: _run(s, jobs.windowed_counts(_events(s, d), seconds=3600), "complete"), "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
add("stream_activity_sessions", _sessions, "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), h AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 15 MINUTE AS \"end\", count(*) AS n FROM h GROUP BY user_id, k")

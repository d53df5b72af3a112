"""Queries of smaller operators: sets, scalars, composite reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import scalars as S
from sparkloom.functions.scalars import meta
from sparkloom.operators import evidence as V
from sparkloom.operators import graph as G
from sparkloom.operators import search as X
from sparkloom.plans.registry import GRAPH_SQL, add, graph
from sparkloom.plans.search_queries import _POOL, BM, DOCS, docs, queries
from sparkloom.runtime import table

W = "WITH" + GRAPH_SQL
_M = "coalesce(element_at(metadata, '{}')[1], '')".format

add("merge_queries", lambda s, d: X.merge_queries(table(s, d, "documents").where("lang = 'en'").select(F.col("title").alias("text"), F.col("doc_id").alias("pos")), table(s, d, "documents").select(F.col("title").alias("text"), F.col("doc_id").alias("pos"))),
    "WITH u AS (SELECT title AS text, 0 AS batch, doc_id AS pos FROM documents WHERE lang = 'en' UNION ALL SELECT title, 1, doc_id FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY batch, pos) AS k FROM u) SELECT text, batch, pos FROM r WHERE k = 1")
add("scope_intersection", lambda s, d: G.intersect_prefixes(table(s, d, "discovery_runs").select(F.explode("package_prefixes").alias("p")).select(F.regexp_replace("p", "/$", "").alias("prefix")), s.createDataFrame([("src/api",), ("lib",), ("tools/x",)], "prefix string")),
    "WITH r AS (SELECT DISTINCT rtrim(unnest(package_prefixes), '/') AS r FROM discovery_runs), c AS (SELECT unnest(['src/api', 'lib', 'tools/x']) AS c) SELECT DISTINCT CASE WHEN r = c OR starts_with(r, c || '/') THEN r ELSE c END AS prefix FROM r, c WHERE r = c OR starts_with(r, c || '/') OR starts_with(c, r || '/')")
add("search_destinations", lambda s, d: X.search_destinations({"ubinary": docs(s, d).where("dtype = 'ubinary'"), "other": docs(s, d).where("coalesce(dtype, '') <> 'ubinary'")}, queries(s, d), 10).select("qid", "id", "store", "rank"),
    f"""WITH u AS (SELECT 'ubinary' AS store, * FROM ({_POOL("dtype = 'ubinary'")} SELECT qid, id, score FROM bm) UNION ALL SELECT 'other', * FROM ({_POOL("coalesce(dtype, '') <> 'ubinary'")} SELECT qid, id, score FROM bm)), r AS (SELECT qid, id, store, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM u) SELECT * FROM r WHERE rank <= 10""")
add("text_functions", lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", S.byte_length(F.col("text")).alias("bytes"), F.length(S.collapse_space(F.coalesce("title", F.lit("")))).alias("title_length"), S.clamp(F.col("title"), 10).alias("short"), S.and_(F.coalesce("lang", F.lit("")), F.col("source")).alias("both"), S.not_(F.coalesce("lang", F.lit(""))).alias("no_lang"), S.match_group(F.col("source"), r"^(\w+):(.*)$", 2).alias("name")),
    "SELECT doc_id, strlen(text)::VARCHAR AS bytes, length(trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g'))) AS title_length, left(title, 10) AS short, CASE WHEN coalesce(lang, '') <> '' AND source <> '' THEN source ELSE '' END AS both, CASE WHEN coalesce(lang, '') <> '' THEN '' ELSE '1' END AS no_lang, regexp_extract(source, '^(\\w+):(.*)$', 2) AS name FROM documents WHERE text IS NOT NULL")
add("byte_slices", lambda s, d: table(s, d, "documents").select("doc_id", S.byte_slice(F.col("source"), F.lit("2"), F.lit("9")).alias("part")), "SELECT doc_id, substr(source, 3, 7) AS part FROM documents")
add("dehyphenated", lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", F.length(S.dehyphenate(F.col("text"))).alias("n")), "SELECT doc_id, length(regexp_replace(text, '(\\p{Ll})-[ \\t]*\\r?\\n[ \\t]*(\\p{Ll})', '\\1\\2', 'g')) AS n FROM documents WHERE text IS NOT NULL")
add("instants", lambda s, d: table(s, d, "usage_rows").select(F.unix_micros(S.parse_instant(F.col("record_ts"))).alias("us")).groupBy(F.col("us").isNull().alias("unreadable")).agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first")),
    r"WITH x AS (SELECT epoch_us(try_cast(CASE WHEN regexp_matches(record_ts, '^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$') THEN upper(record_ts) END AS TIMESTAMPTZ)) AS us FROM usage_rows) SELECT us IS NULL AS unreadable, count(*) AS n, min(us) AS first FROM x GROUP BY 1")
add("bit_similarity", lambda s, d: docs(s, d).select("id", F.round(S.bit_similarity(F.col("vector"), F.lit(bytes(range(32)))), 6).alias("similarity")), f"WITH {DOCS} SELECT id, round(CASE WHEN octet_length(vector) = 32 THEN 1 - bit_count(xor(vector::BIT, unhex('{bytes(range(32)).hex()}')::BIT)) / 256.0 ELSE 0 END, 6) AS similarity FROM sd")
add("running_heads", lambda s, d: table(s, d, "documents").where("text is not null").select(S.fingerprint(F.element_at(F.split("text", "\n"), -1)).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n >= 10"),
    r"""WITH x AS (SELECT regexp_replace(lower(trim(regexp_replace(string_split(text, chr(10))[-1], '\s+', ' ', 'g'))), '\d', '#', 'g') AS t FROM documents WHERE text IS NOT NULL), y AS (SELECT trim(regexp_replace(t, '^(page |p\. ?)?#+( of #+)?[ |.-]*|[ |.-]*(page |p\. ?)?#+( of #+)?$', '', 'g')) AS fp FROM x) SELECT fp, count(*) AS n FROM y GROUP BY 1 HAVING count(*) >= 10""")
add("code_stats", lambda s, d: G.graph_stats(graph(s, d)).where("(kind = 'node' and type in ('file', 'function', 'method', 'type')) or (kind = 'edge' and type = upper(type))").select("kind", "type", "n"), f"{W} SELECT 'node' AS kind, type, count(*) AS n FROM l WHERE type IN ('file', 'function', 'method', 'type') GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM e WHERE type = upper(type) GROUP BY 2")
add("rule_index", lambda s, d: G.rule_index(table(s, d, "discovery_runs")),
    "WITH x AS (SELECT repo, unnest(map_keys(excluded_by_rule)) AS rule, unnest(map_values(excluded_by_rule)) AS n FROM discovery_runs) SELECT repo || ':' || rule AS id, CASE WHEN n > 2 THEN 'warning' ELSE 'notice' END AS severity, repo, n || ' files left out by ' || rule AS summary FROM x WHERE n > 0")
add("checks_search", lambda s, d: X.checks_search(docs(s, d), V.thoughts(graph(s, d)).where("status = 'settled'"), queries(s, d)),
    f"WITH {GRAPH_SQL}, {BM.replace('FROM search_docs WHERE id IS NOT NULL) WHERE rn = 1)', 'FROM search_docs WHERE id IS NOT NULL) WHERE rn = 1 AND id IN (SELECT id FROM l WHERE type = ' + chr(39) + 'thought' + chr(39) + ' AND status = ' + chr(39) + 'settled' + chr(39) + '))')}, r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm) SELECT * FROM r WHERE rank <= 5")
add("examine_thoughts", lambda s, d: _examine(s, d), f"{W}, t AS (SELECT id FROM l WHERE type = 'thought'), x AS (SELECT from_id AS id, type, 'out' AS direction, to_id AS o FROM e UNION ALL SELECT to_id, type, 'in', from_id FROM e) SELECT x.id, x.type, direction, count(DISTINCT o) AS n FROM x JOIN t USING (id) WHERE o IN (SELECT id FROM l) GROUP BY 1, 2, 3")


def _examine(s, d):
    g = graph(s, d)
    x = g.edges.select(F.col("from_id").alias("id"), "type", F.lit("out").alias("direction"), F.col("to_id").alias("o")).unionByName(g.edges.select(F.col("to_id").alias("id"), "type", F.lit("in").alias("direction"), F.col("from_id").alias("o")))
    return x.join(V.thoughts(g).select("id"), "id", "left_semi").join(g.live.select(F.col("id").alias("o")), "o", "left_semi").groupBy("id", "type", "direction").agg(F.countDistinct("o").alias("n"))


add("plan_tree", lambda s, d: G.ordered_children(graph(s, d), "contains").select("parent", "id", "no"), f"{W}, c AS (SELECT from_id AS parent, to_id AS id, min(try_cast(CASE WHEN evidence LIKE '{{%' THEN json_extract_string(evidence, '$.position') END AS BIGINT)) AS position FROM e WHERE type = 'contains' AND to_id IN (SELECT id FROM l) GROUP BY 1, 2), r AS (SELECT parent, id, row_number() OVER (PARTITION BY parent ORDER BY position NULLS LAST, id) AS no FROM c) SELECT * FROM r")
add("densify_links", lambda s, d: X.densify(docs(s, d).select("id", "vector").join(graph(s, d).live.select("id", meta("cluster_id").alias("cluster")).where("cluster <> ''"), "id"), "cluster", k=3, floor=0.7),
    f"WITH {GRAPH_SQL}, {DOCS}, v AS (SELECT l.id, {_M('cluster_id')} AS cluster, vector::BIT AS x FROM sd JOIN l USING (id) WHERE {_M('cluster_id')} <> '' AND octet_length(vector) = 32), p AS (SELECT a.cluster, a.id AS qid, b.id AS id, 1 - bit_count(xor(a.x, b.x)) / 256.0 AS score FROM v a JOIN v b ON a.cluster = b.cluster AND a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS k FROM p WHERE score >= 0.7) SELECT DISTINCT cluster, least(qid, id) AS a, greatest(qid, id) AS b, score FROM r WHERE k <= 3")
add("collect_staleness", lambda s, d: G.collect_staleness(graph(s, d), table(s, d, "discovery_runs")),
    f"{W} SELECT repo, max(l.updated_at) > epoch_us(any_value(run_at)) * 1000 AS stale FROM discovery_runs JOIN l ON l.source = repo AND l.type = 'file' GROUP BY repo")
add("limit_offset_total", lambda s, d: graph(s, d).live.where("type = 'thought'").select("id").orderBy("id").offset(20).limit(10), f"{W} SELECT id FROM l WHERE type = 'thought' ORDER BY id LIMIT 10 OFFSET 20")

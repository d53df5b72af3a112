"""Queries of the retrieval operators. Query set: the titles of documents whose id is divisible by 100, against all search records."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import scalars as S
from sparkloom.operators import binary_index as B
from sparkloom.operators import search as X
from sparkloom.plans.registry import GRAPH_SQL, add, graph
from sparkloom.runtime import table

_PART = r"list_filter(string_split_regex(lower(replace(regexp_replace(regexp_replace(w, '(\p{Lu}+)(\p{Lu}\p{Ll})', '\1 \2', 'g'), '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '_', ' ')), ' +'), lambda p: strlen(p) >= 2 AND p <> lower(w))"
TOK = lambda c: r"flatten(list_transform(list_filter(regexp_extract_all(" + c + r", '[\p{L}\p{N}_]+'), lambda w: strlen(w) >= 2), lambda w: list_concat([lower(w)], " + _PART + ")))"
DOCS = """sd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, coalesce(hex(vector), '')) AS rn FROM search_docs WHERE id IS NOT NULL) WHERE rn = 1)"""
BM = f"""{DOCS}, fl AS (SELECT id, unnest(map_keys(fields)) AS field, unnest(map_values(fields)) AS v FROM sd), tk AS (SELECT id, field, unnest({TOK("coalesce(v, '')")}) AS term FROM fl WHERE field IN ('symbol_name', 'summary', 'keywords', 'description', 'content')),
po AS (SELECT id, field, term, count(*) AS tf FROM tk GROUP BY 1, 2, 3), dl AS (SELECT id, field, sum(tf) AS dl FROM po GROUP BY 1, 2), ft AS (SELECT field, sum(tf) AS total FROM po GROUP BY 1), df AS (SELECT term, count(DISTINCT id) AS n FROM po GROUP BY 1),
bo AS (SELECT * FROM (VALUES ('symbol_name', 2.0::DOUBLE, 0.0::DOUBLE), ('summary', 2.0, 0.75), ('keywords', 2.0, 0.0), ('description', 1.0, 0.75), ('content', 1.0, 0.75)) t(field, boost, b)),
q AS (SELECT doc_id::VARCHAR AS qid, title AS text FROM documents WHERE doc_id % 100 = 0), qt AS (SELECT DISTINCT qid, unnest({TOK("coalesce(text, '')")}) AS term FROM q),
bm AS (SELECT qid, po.id, round(sum(boost * ln(((SELECT count(*) FROM sd) - n + 0.5) / (n + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - b + b * dl / (total / (SELECT count(*) FROM sd))))), 9) AS score FROM qt JOIN po USING (term) JOIN df USING (term) JOIN dl ON dl.id = po.id AND dl.field = po.field JOIN ft ON ft.field = po.field JOIN bo ON bo.field = po.field GROUP BY 1, 2)"""
HQ = f"""{DOCS}, v AS (SELECT id, vector::BIT AS x FROM sd WHERE octet_length(vector) = 32), hq AS (SELECT id AS qid, x FROM v WHERE (('0x' || right(id, 4))::INT) % 100 = 0),
hd AS (SELECT qid, v.id, 1 - bit_count(xor(hq.x, v.x)) / 256.0 AS score FROM hq, v)"""


def docs(s, d):
    return X.latest_docs(table(s, d, "search_docs"))


def queries(s, d):
    return table(s, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").cast("string").alias("qid"), F.col("title").alias("text"))


def vector_queries(s, d):
    return docs(s, d).where(F.conv(F.right("id", F.lit(4)), 16, 10).cast("long") % 100 == 0).select(F.col("id").alias("qid"), "vector")


W = f"WITH {BM}"
INTENT = f"""SELECT qid, CASE WHEN {" OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in (*S.TEST_CALLS, *S.TEST_PHRASES))} OR list_has_any(string_split_regex(lower(coalesce(text, '')), '\\s+'), [{", ".join(f"'{w}'" for w in S.TEST_WORDS)}]) THEN 'test'
  WHEN len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) <= 2 THEN 'unknown' ELSE 'impl' END AS intent FROM q"""
add("bm25_postings", lambda s, d: X.postings(docs(s, d)), f"{W} SELECT * FROM po")
add("bm25_corpus_stats", lambda s, d: X.corpus_stats(X.postings(docs(s, d)), docs(s, d))[2], f"{W} SELECT * FROM df")
add("bm25_scores", lambda s, d: X.bm25(docs(s, d), queries(s, d)).select("qid", "id", F.round("score", 6).alias("score")), f"{W} SELECT qid, id, round(score, 6) AS score FROM bm")
add("bm25_top", lambda s, d: X.top_per_query(X.bm25(docs(s, d), queries(s, d)).withColumn("score", F.round("score", 6)), 10), f"{W}, r AS (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM bm) SELECT * FROM r WHERE rank <= 10")
add("hamming_knn", lambda s, d: X.hamming_neighbours(docs(s, d), vector_queries(s, d), 10), f"WITH {HQ}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hd) SELECT qid, id, score FROM r WHERE rank <= 10")
add("similar_by_id", lambda s, d: X.similar(docs(s, d), vector_queries(s, d).select(F.col("qid").alias("id")), 5), f"WITH {HQ}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hd WHERE qid <> id) SELECT qid, id, score, rank FROM r WHERE rank <= 5")
add("hybrid_rrf", lambda s, d: X.fuse([X.top_per_query(X.bm25(docs(s, d), tq(s, d)).withColumn("score", F.round("score", 6)), 20), X.top_per_query(X.hamming_neighbours(docs(s, d), vector_queries(s, d), 20), 20)], 10).select("qid", "id", F.round("score", 6).alias("score")),
    f"""WITH {BM.replace("SELECT doc_id::VARCHAR AS qid, title AS text FROM documents WHERE doc_id % 100 = 0", "SELECT id AS qid, fields['summary'] AS text FROM sd WHERE octet_length(vector) = 32 AND (('0x' || right(id, 4))::INT) % 100 = 0")}, {HQ.replace(DOCS + ", ", "")},
a AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM bm), b AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hd),
u AS (SELECT * FROM a WHERE rank <= 20 UNION ALL SELECT * FROM b WHERE rank <= 20), f AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS k FROM f) SELECT qid, id, round(score, 6) AS score FROM r WHERE k <= 10""")


_KNN = f"WITH {HQ}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hd) SELECT qid, id, score FROM r WHERE rank <= 5"
add("binary_index_knn", lambda s, d: B.nearest(docs(s, d), B.build(docs(s, d)), vector_queries(s, d), 5), _KNN)
add("binary_index_settled", lambda s, d: B.probe(B.build(docs(s, d), 16), vector_queries(s, d), 5).where("settled").select("qid", "id", F.round("score", 6).alias("score")),
    f"WITH {HQ}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hd), t AS (SELECT * FROM r WHERE rank <= 5) SELECT qid, id, round(score, 6) AS score FROM t WHERE qid IN (SELECT qid FROM t WHERE rank = 5 AND score >= 1 - 31 / 256.0)")
add("knn_accepting", lambda s, d: X.hamming_neighbours(docs(s, d), vector_queries(s, d), 5, accept=F.coalesce("dtype", F.lit("")) == "ubinary"), f"WITH {HQ}, r AS (SELECT hd.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, hd.id) AS rank FROM hd JOIN sd ON sd.id = hd.id AND dtype = 'ubinary') SELECT qid, id, score FROM r WHERE rank <= 5")


def _fan(s, d, form):
    # two segments by the first digit of an id; records of the digits 4 to 7 were written again, and live in the second only
    x = docs(s, d).withColumn("digit", F.conv(F.left("id", F.lit(1)), 16, 10).cast("int"))
    both = x.where("digit < 8").withColumn("segment", F.lit("a")).unionByName(x.where("digit >= 4").withColumn("segment", F.lit("b")))
    live = x.select("id", F.when(F.col("digit") < 4, F.lit("a")).otherwise(F.lit("b")).alias("segment"))
    return B.fan_out(B.segments(both, F.col("segment"), ["a", "b"], form), form, vector_queries(s, d), live, 5).select("qid", "id", "score", "segment")


_FAN = f"WITH {HQ}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hd) SELECT qid, id, score, CASE WHEN left(id, 1) < '4' THEN 'a' ELSE 'b' END AS segment FROM r WHERE rank <= 5"
add("segment_fan_out", lambda s, d: _fan(s, d, "flat"), _FAN)
add("segment_fan_out_indexed", lambda s, d: _fan(s, d, "multi_index"), _FAN)
add("search_clamped", lambda s, d: X.search(docs(s, d), queries(s, d), mode="text", k=500).select("qid", "id", "rank"), f"{W}, r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm) SELECT * FROM r WHERE rank <= 50")
add("search_mode_vector", lambda s, d: X.search(docs(s, d), vector_queries(s, d).withColumn("text", F.lit("")), mode="vector", k=7).select("qid", "id", "rank"), f"WITH {HQ}, r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hd) SELECT * FROM r WHERE rank <= 7")


def tq(s, d):
    v = vector_queries(s, d)
    return docs(s, d).select(F.col("id").alias("qid"), F.col("fields")["summary"].alias("text")).join(v.where(F.octet_length("vector") == 32).select("qid"), "qid", "left_semi")


_POOL = lambda cond: "WITH " + BM.replace("FROM search_docs WHERE id IS NOT NULL) WHERE rn = 1)", f"FROM search_docs WHERE id IS NOT NULL) WHERE rn = 1 AND {cond})")
add("overlay_search", lambda s, d: X.overlay_search(docs(s, d), docs(s, d).where(F.conv(F.right("id", F.lit(1)), 16, 10).cast("int") < 4), queries(s, d), 10).select("qid", "id", "rank"), f"""WITH a AS (SELECT * FROM ({_POOL("right(id, 1) < '4'")} SELECT qid, id, score FROM bm)), b AS (SELECT * FROM ({W} SELECT qid, id, score FROM bm WHERE NOT right(id, 1) < '4')), u AS (SELECT * FROM a UNION ALL SELECT * FROM b), r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM u) SELECT * FROM r WHERE rank <= 10""")
add("score_ops_rerank", lambda s, d: X.score_ops(X.bm25(docs(s, d), queries(s, d)), queries(s, d), graph(s, d)).select("qid", "id", F.round("score", 6).alias("score")), f"""{W}, it AS ({INTENT}), fk AS (SELECT id, CASE WHEN p = '' THEN '' WHEN regexp_matches(p, '(^|/)(testdata|fixtures?)/') THEN 'fixture' WHEN regexp_matches(p, '(_test\\.|\\.test\\.|\\.spec\\.|(^|/)tests?/)') THEN 'test' WHEN regexp_matches(p, '\\.(md|rst|txt|adoc)$') THEN 'doc' ELSE 'impl' END AS kind FROM (SELECT id, lower(coalesce(file_path, '')) AS p FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, tombstoned_at DESC) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1 AND coalesce(tombstoned_at, 0) = 0)),
op AS (SELECT * FROM (VALUES {", ".join(f"('{i}', '{k}', {w}::DOUBLE)" for i, ks in X.SCORE_OPS.items() for k, w in ks.items())}) t(intent, kind, w))
SELECT qid, id, round(score + coalesce(w, 0), 6) AS score FROM bm JOIN it USING (qid) LEFT JOIN fk USING (id) LEFT JOIN op USING (intent, kind)""")
add("query_intent", lambda s, d: table(s, d, "documents").select(F.col("doc_id").cast("string").alias("qid"), S.intent(F.coalesce("title", F.lit(""))).alias("intent")), INTENT.replace("FROM q", "FROM (SELECT doc_id::VARCHAR AS qid, title AS text FROM documents)"))
add("temporal_boost", lambda s, d: docs(s, d).select("id", F.round(S.temporal_boost(F.lit(1.0), 1_785_000_000_000_000_000, F.col("updated_at")), 9).alias("score")), f"WITH {DOCS} SELECT id, round(1 + CASE WHEN coalesce(updated_at, 0) = 0 THEN 0.5 ELSE pow(0.5, greatest(0, (1785000000000000000 - updated_at) / 86400000000000.0) / 30) END, 9) AS score FROM sd")
add("recency_scalar", lambda s, d: docs(s, d).select("id", F.round(S.recency(1_785_000_000_000_000_000, F.col("updated_at")), 9).alias("score")), f"WITH {DOCS} SELECT id, round(CASE WHEN coalesce(updated_at, 0) = 0 THEN 0.5 ELSE 1 / (1 + log2(1 + greatest(0, (1785000000000000000 - updated_at) / 86400000000000.0) / 30)) END, 9) AS score FROM sd")
add("topology_hints", lambda s, d: X.topology_hints(graph(s, d)), f"""WITH {GRAPH_SQL}, x AS (SELECT * FROM e WHERE type = 'CALLS' AND from_id <> to_id), a AS (SELECT to_id AS id, count(DISTINCT from_id) AS i FROM x GROUP BY 1), b AS (SELECT from_id AS id, count(DISTINCT to_id) AS o FROM x GROUP BY 1), c AS (SELECT id, coalesce(i, 0) AS i, coalesce(o, 0) AS o FROM a FULL JOIN b USING (id))
SELECT id, CASE WHEN i >= 5 AND o <= 1 THEN 'utility' WHEN i = 0 AND o >= 3 THEN 'entry point' WHEN i >= 5 AND o >= 5 THEN 'hub' ELSE 'member' END || ': called by ' || i || ', calls ' || o AS hint FROM c WHERE id IN (SELECT id FROM l)""")
add("parent_headings", lambda s, d: X.parent_headings(docs(s, d).select("id"), graph(s, d), "contains").select("id", "heading"), f"WITH {GRAPH_SQL}, {DOCS}, p AS (SELECT to_id AS id, min(from_id) AS parent FROM e WHERE type = 'contains' GROUP BY 1) SELECT sd.id, coalesce(CASE WHEN l.symbol_name <> '' THEN l.symbol_name ELSE l.file_path END, '') AS heading FROM sd LEFT JOIN p USING (id) LEFT JOIN l ON l.id = p.parent")
add("rerank_predicate", lambda s, d: graph(s, d).live.where(X.rerank_predicate({"all": [{"field": "type", "op": "in", "values": ["function", "method"]}, {"any": [{"field": "summary", "op": "tokens_match", "value": "cache index"}, {"field": "symbol_name", "op": "prefix", "value": "kel"}]}, {"not": {"field": "metadata.chunk", "op": "equals", "value": "2"}}]})).select("id"),
    f"WITH {GRAPH_SQL} SELECT id FROM l WHERE type IN ('function', 'method') AND (list_has_any({TOK('summary')}, ['cache', 'index']) OR starts_with(symbol_name, 'kel')) AND coalesce(element_at(metadata, 'chunk')[1], '') <> '2'")
add("deterministic_keywords", lambda s, d: graph(s, d).live.where("type = 'function'").select("id", S.keywords_of(F.col("file_path"), F.col("symbol_name")).alias("keywords")), f"WITH {GRAPH_SQL} SELECT id, array_to_string(list_sort(list_distinct(list_concat({TOK('file_path')}, {TOK('symbol_name')}))), ' ') AS keywords FROM l WHERE type = 'function'")
add("lexical_rerank", lambda s, d: X.lexical_rerank(X.bm25(docs(s, d), queries(s, d)), queries(s, d), docs(s, d).select("id", F.col("fields")["summary"].alias("text"))).select("qid", "id"), f"{W} SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM bm) WHERE r <= 1000")
add("hybrid_embedded_queries", lambda s, d: X.search(docs(s, d), X.embed(queries(s, d)), mode="hybrid", k=10).select("qid", "id", "rank"))
add("hit_hydrate", lambda s, d: __import__("sparkloom.operators.graph", fromlist=["x"]).hydrate_hits(X.hamming_neighbours(docs(s, d), vector_queries(s, d), 10), graph(s, d)).select("qid", "id", "symbol_name", "score"), f"WITH {GRAPH_SQL}, {HQ}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hd) SELECT qid, id, symbol_name, score FROM r JOIN l USING (id) WHERE rank <= 10")
add("dense_dot_top", lambda s, d: _dense(s, d), "WITH q AS (SELECT vec_id AS qid, embedding AS a FROM embeddings WHERE vec_id % 100 = 0), x AS (SELECT qid, vec_id AS id, round(list_dot_product(a::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM x) SELECT * FROM r WHERE rank <= 10")


def _dense(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("a"))
    x = e.join(q, F.lit(True)).select("qid", F.col("vec_id").alias("id"), F.round(S.dot(F.col("a"), F.col("embedding")), 6).alias("score"))  # the stated query set against all rows
    return X.top_per_query(x, 10)

"""Queries of the evidence graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions.scalars import meta
from sparkloom.operators import evidence as V
from sparkloom.operators.search import latest_docs
from sparkloom.plans.registry import GRAPH_SQL, add, graph
from sparkloom.plans.search_queries import DOCS
from sparkloom.runtime import table

NOW = 1_785_000_000_000_000_000
_M = "coalesce(element_at(metadata, '{}')[1], '')".format
_NUM = f"coalesce(try_cast(nullif(regexp_extract({_M('weight')}, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1), '') AS DOUBLE), 0.0)"
_REC = f"CASE WHEN updated_at = 0 THEN 0.5 ELSE 1 / (1 + log2(1 + greatest(0.0, ({NOW} - updated_at) / 86400000000000.0) / 30)) END"
BASE = f"""WITH RECURSIVE {GRAPH_SQL}, th AS (SELECT * FROM l WHERE type = 'thought'),
ch AS (SELECT DISTINCT from_id AS thought, to_id AS charge, {_M('polarity')} AS polarity, {_NUM} AS weight, created_at, updated_at, {_NUM} * {_REC} AS w FROM e JOIN l ON l.id = e.to_id AND l.type = 'charge' WHERE e.type = 'charged-by' AND from_id IN (SELECT id FROM th)),
s AS (SELECT thought AS id, sum(CASE WHEN polarity = 'positive' THEN w ELSE 0 END) AS p, sum(CASE WHEN polarity = 'negative' THEN w ELSE 0 END) AS n, count(*) AS charges FROM ch GROUP BY 1),
b AS (SELECT th.id, coalesce(p, 0) AS p, coalesce(n, 0) AS n, coalesce(charges, 0) AS charges FROM th LEFT JOIN s USING (id)),
f0 AS (SELECT *, CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0 END AS valence, CASE WHEN p + n > 0 THEN ln(1 + p + n) ELSE 0 END AS magnitude, CASE WHEN p + n > 0 THEN 1 - least(p, n) / greatest(p, n) ELSE 0 END AS consistency FROM b),
f AS (SELECT *, 0.1 + consistency * ln(1 + charges) AS self_trust FROM f0)"""
TR = f"""{BASE}, nb AS (SELECT from_id AS a, to_id AS b FROM e WHERE type IN ('relates-to', 'supports', 'contradicts', 'informed-by') UNION SELECT to_id, from_id FROM e WHERE type IN ('relates-to', 'supports', 'contradicts', 'informed-by')),
m AS (SELECT a AS i, b AS j, 1.0::DOUBLE AS w FROM nb WHERE a <> b AND a IN (SELECT id FROM f) AND b IN (SELECT id FROM f) UNION ALL SELECT id, id, self_trust FROM f), t AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM m)"""


def folded(s, d):
    return V.fold(graph(s, d), NOW)


def matrix(s, d):
    return V.trust_matrix(graph(s, d), folded(s, d))


r6 = lambda *cs: [F.round(c, 6).alias(c) for c in cs]
R6 = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)
P = ("p", "n", "valence", "magnitude", "consistency", "self_trust")
add("charge_fold", lambda s, d: folded(s, d).select("id", "charges", *r6(*P)), f"{BASE} SELECT id, charges, {R6(*P)} FROM f")
add("trust_matrix", lambda s, d: matrix(s, d).select("i", "j", *r6("w")), f"{TR} SELECT i, j, {R6('w')} FROM t")
add("valence_propagation", lambda s, d: V.propagate_valence(matrix(s, d), folded(s, d).select("id", F.col("valence").alias("v")))[0].select("id", F.round("v", 4).alias("v")))
# twelve unrolled rounds of the same recurrence, which the SQL can follow
_VR = ", ".join(f"v{k} AS (SELECT i AS id, 0.5 * any_value(o.v) + 0.5 * sum(t.w * x.v) AS v FROM t JOIN v{k - 1} x ON x.id = t.j JOIN v{k - 1} o ON o.id = t.i GROUP BY i)" for k in range(1, 13))
add("valence_propagation_12_rounds", lambda s, d: V.propagate_valence(matrix(s, d), folded(s, d).select("id", F.col("valence").alias("v")), max_iter=12, eps=0.0)[0].select("id", *r6("v")), f"{TR}, v0 AS (SELECT id, valence AS v FROM f), {_VR} SELECT id, {R6('v')} FROM v12")
add("magnitude_propagation", lambda s, d: V.propagate_magnitude(matrix(s, d), folded(s, d).select("id", F.col("magnitude").alias("m")), eps=1e-12).select("id", *r6("m")),
    f"{TR}, g2 AS (SELECT id, magnitude AS m, 0 AS k FROM f UNION SELECT t.i, 0.7 * g2.m, k + 1 FROM g2 JOIN t ON t.j = g2.id AND t.i <> t.j JOIN f ON f.id = t.i WHERE k < 12 AND 0.7 * g2.m > f.magnitude) SELECT id, round(max(m), 6) AS m FROM g2 GROUP BY 1")
add("influence_vector", lambda s, d: V.influence(matrix(s, d)).select("id", F.round("influence", 5).alias("influence")))
add("personality_scaling", lambda s, d: V.personality(matrix(s, d), V.thoughts(graph(s, d)).select("id", meta("cluster_id").alias("cluster")), s.createDataFrame([("c001", "c002", 2.0), ("c001", "c001", 0.5)], "cluster_a string, cluster_b string, factor double"), s.createDataFrame([("c001", 1.5)], "cluster_a string, factor double")).select("i", "j", *r6("w")),
    f"""{TR}, c AS (SELECT id, {_M('cluster_id')} AS c FROM th), y AS (SELECT i, j, w * CASE WHEN a.c = 'c001' AND b.c = 'c002' THEN 2.0 WHEN a.c = 'c001' AND b.c = 'c001' THEN 0.5 WHEN a.c = 'c001' THEN 1.5 ELSE 1 END AS w FROM t JOIN c a ON a.id = i JOIN c b ON b.id = j) SELECT i, j, round(w / sum(w) OVER (PARTITION BY i), 6) AS w FROM y""")
_TENSIONS = f"""{BASE}, pr AS (SELECT DISTINCT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b FROM e WHERE type IN ('relates-to', 'supports', 'contradicts', 'informed-by') AND from_id <> to_id),
c AS (SELECT id, CASE WHEN {_M('cluster_id')} = '' THEN 'thought:' || id ELSE {_M('cluster_id')} END AS c FROM th),
q AS (SELECT a, b, round(abs(x.valence - y.valence), 9) AS delta, least(cx.c, cy.c) AS ka, greatest(cx.c, cy.c) AS kb, (SELECT count(DISTINCT charge) FROM ch WHERE thought IN (a, b)) AS evidence FROM pr JOIN f x ON x.id = a JOIN f y ON y.id = b JOIN c cx ON cx.id = a JOIN c cy ON cy.id = b WHERE x.magnitude >= 0.5 AND y.magnitude >= 0.5 AND abs(x.valence - y.valence) >= 0.5),
z AS (SELECT *, row_number() OVER (PARTITION BY ka, kb ORDER BY delta DESC, a, b) AS r, count(*) OVER (PARTITION BY ka, kb) AS pairs FROM q) SELECT ka, kb, pairs, a, b, round(delta, 6) AS delta, evidence, round(delta * (1 + evidence), 6) AS score FROM z WHERE r = 1"""
add("tensions", lambda s, d: V.tensions(graph(s, d), NOW, None, 0), _TENSIONS)
add("tensions_top", lambda s, d: V.tensions(graph(s, d), NOW, "human"), _TENSIONS.replace("AND from_id <> to_id),", "AND from_id <> to_id AND method = 'human'),", 1) + f" ORDER BY score DESC, a, b LIMIT {V.TENSION_CAP}")
add("influence_ranking", lambda s, d: V.influence_ranking(folded(s, d), V.influence(matrix(s, d))).select("section", "rank", "id"))
# ten rounds of the same power iteration, normalised each round
_IR = "x0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM f) AS x FROM f), " + ", ".join(f"y{k} AS (SELECT j AS id, sum(t.w * x.x) AS y FROM t JOIN x{k - 1} x ON x.id = t.i GROUP BY 1), x{k} AS (SELECT f.id, coalesce(y, 0) / (SELECT sum(y) FROM y{k}) AS x FROM f LEFT JOIN y{k} USING (id))" for k in range(1, 11))
_TEN = lambda s, d: V.influence(matrix(s, d), max_iter=10, eps=0.0)
add("influence_vector_ten_rounds", lambda s, d: _TEN(s, d).select("id", F.round("influence", 8).alias("influence")), f"{TR}, {_IR} SELECT id, round(x, 8) AS influence FROM x10")
add("influence_ranking_ten_rounds", lambda s, d: V.influence_ranking(folded(s, d), _TEN(s, d).select("id", F.round("influence", 10).alias("influence"))).select("section", "rank", "id"),
    f"""{TR}, {_IR}, r AS (SELECT id, CASE WHEN charges > 0 THEN 'evidenced' ELSE 'backfill' END AS section, round(CASE WHEN charges > 0 THEN round(x, 10) * (1 + p + n) ELSE round(x, 10) END, 12) AS score FROM f JOIN x10 USING (id)), k AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, id) AS rank FROM r) SELECT section, rank, id FROM k WHERE rank <= 10""")
add("belief_reversal_clusters", lambda s, d: V.cluster_reversals(graph(s, d), NOW, 0), f"""{BASE}, c AS (SELECT id, {_M('cluster_id')} AS cluster FROM th WHERE {_M('cluster_id')} <> ''),
v AS (SELECT cluster, coalesce(sum(CASE WHEN created_at < {NOW} - 30 * 86400000000000 THEN sg END), 0) AS old_net, coalesce(sum(CASE WHEN created_at >= {NOW} - 30 * 86400000000000 THEN sg END), 0) AS recent_net FROM (SELECT c.cluster, ch.created_at, CASE polarity WHEN 'negative' THEN -weight WHEN 'positive' THEN weight END AS sg FROM ch JOIN c ON c.id = thought WHERE created_at <> 0) GROUP BY 1)
SELECT cluster, {R6('old_net', 'recent_net')} FROM v WHERE old_net <> 0 AND recent_net <> 0 AND (old_net < 0) <> (recent_net < 0) AND abs(old_net) >= 6""")
BS = f"""{BASE}, nw AS (SELECT thought AS id, max(updated_at) AS newest FROM ch GROUP BY 1), cc AS (SELECT from_id AS id, max(l.updated_at) AS code_at FROM e JOIN l ON l.id = e.to_id AND l.type IN ('file', 'function', 'method', 'type') GROUP BY 1),
rv AS (SELECT thought AS id, coalesce(sum(CASE WHEN created_at < {NOW} - 30 * 86400000000000 THEN sg END), 0) AS o, coalesce(sum(CASE WHEN created_at >= {NOW} - 30 * 86400000000000 THEN sg END), 0) AS r FROM (SELECT *, CASE polarity WHEN 'negative' THEN -weight WHEN 'positive' THEN weight END AS sg FROM ch WHERE created_at <> 0) GROUP BY 1),
fr AS (SELECT DISTINCT thought AS id FROM ch JOIN s ON s.id = thought WHERE sign(round(p - n, 12)) <> 0 AND sign(round((p - CASE WHEN polarity = 'positive' THEN w ELSE 0 END) - (n - CASE WHEN polarity = 'negative' THEN w ELSE 0 END), 12)) NOT IN (0, sign(round(p - n, 12)))),
x AS (SELECT f.*, newest, code_at, (o <> 0 AND r <> 0 AND (o < 0) <> (r < 0)) AS rev FROM f LEFT JOIN nw USING (id) LEFT JOIN cc USING (id) LEFT JOIN rv USING (id) WHERE id IN (SELECT id FROM th WHERE NOT starts_with(source, 'machine') AND NOT regexp_matches(lower(symbol_name), '^(auto|exported)')))
SELECT 'confident_untested' AS facet, id FROM x WHERE magnitude >= 1.5 AND consistency >= 0.8 AND charges <= 1 UNION ALL SELECT 'foundational_unexamined', id FROM x WHERE charges = 0 UNION ALL SELECT 'fragile_single_point', id FROM x WHERE charges <= 1 OR id IN (SELECT id FROM fr)
UNION ALL SELECT 'stale_confidence', id FROM x WHERE newest < {NOW} - 7 * 86400000000000 UNION ALL SELECT 'code_changed', id FROM x WHERE coalesce(code_at, 0) > newest UNION ALL SELECT 'belief_reversal', id FROM x WHERE rev"""
add("blind_spots", lambda s, d: V.blind_spots(graph(s, d), NOW, None, None), BS)
add("blind_spots_top", lambda s, d: V.blind_spots(graph(s, d), NOW), f"SELECT facet, id FROM (SELECT facet, b.id, row_number() OVER (PARTITION BY facet ORDER BY round(f.magnitude, 9) DESC, b.id) AS r FROM ({BS}) b JOIN ({BASE} SELECT id, magnitude FROM f) f ON f.id = b.id) WHERE r <= {V.FACET_CAP}")
_T = lambda s, d: V.charges(graph(s, d)).agg(F.min(F.struct("thought", "charge")).alias("x")).first().x or ("", "")
SIM = ", ".join(["state", "id", "charges"]) + ", " + R6(*P)
_AFTER = "y AS (SELECT *, CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0 END AS valence, CASE WHEN p + n > 0 THEN ln(1 + p + n) ELSE 0 END AS magnitude, CASE WHEN p + n > 0 THEN 1 - least(p, n) / greatest(p, n) ELSE 0 END AS consistency FROM a), z AS (SELECT *, 0.1 + consistency * ln(1 + charges) AS self_trust FROM y)"
add("simulate_remove", lambda s, d: V.simulate(graph(s, d), NOW, "remove", _T(s, d)[1]).select("state", "id", "charges", *r6(*P)),
    f"""{BASE}, x AS (SELECT charge AS c FROM ch ORDER BY thought, charge LIMIT 1), h AS (SELECT DISTINCT thought AS id FROM ch, x WHERE charge = c), a AS (SELECT 'before' AS state, id, charges, p, n FROM f WHERE id IN (SELECT id FROM h)
UNION ALL SELECT 'after', h.id, count(ch.charge), coalesce(sum(CASE WHEN polarity = 'positive' THEN w ELSE 0 END), 0), coalesce(sum(CASE WHEN polarity = 'negative' THEN w ELSE 0 END), 0) FROM h LEFT JOIN ch ON thought = h.id AND charge <> (SELECT c FROM x) GROUP BY h.id), {_AFTER} SELECT {SIM} FROM z""")
add("simulate_add", lambda s, d: V.simulate(graph(s, d), NOW, "add", _T(s, d)[0], polarity="negative", weight=2.0).select("state", "id", "charges", *r6(*P)), f"""{BASE}, x AS (SELECT min(thought) AS t FROM ch), a AS (SELECT 'before' AS state, id, charges, p, n FROM f, x WHERE id = t UNION ALL SELECT 'after', id, charges + 1, p, n + 2 FROM f, x WHERE id = t),
y AS (SELECT *, CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0 END AS valence, CASE WHEN p + n > 0 THEN ln(1 + p + n) ELSE 0 END AS magnitude, CASE WHEN p + n > 0 THEN 1 - least(p, n) / greatest(p, n) ELSE 0 END AS consistency FROM a), z AS (SELECT *, 0.1 + consistency * ln(1 + charges) AS self_trust FROM y) SELECT {SIM} FROM z""")
add("simulate_invalidate", lambda s, d: V.simulate(graph(s, d), NOW, "invalidate", _T(s, d)[0]).select("state", "id", "charges", *r6(*P)),
    f"{BASE}, x AS (SELECT min(thought) AS t FROM ch), z AS (SELECT 'before' AS state, id, charges, p, n, valence, magnitude, consistency, self_trust FROM f, x WHERE id = t UNION ALL SELECT 'after', t, 0, 0, 0, -1, 0, 0, 0.1 FROM x) SELECT {SIM} FROM z")
add("trace_thoughts", lambda s, d: V.trace(graph(s, d), V.thoughts(graph(s, d)).where("status = 'settled'").select("id"), depth=2), f"{BASE}, st AS (SELECT id FROM th WHERE status = 'settled'), q AS (SELECT from_id AS a, to_id AS b FROM e WHERE type IN ('relates-to', 'supports', 'contradicts', 'informed-by') UNION SELECT to_id, from_id FROM e WHERE type IN ('relates-to', 'supports', 'contradicts', 'informed-by')), r AS (SELECT id, 0 AS distance FROM st UNION SELECT q.b, distance + 1 FROM r JOIN q ON q.a = r.id JOIN l ON l.id = q.b WHERE distance < 2) SELECT id, min(distance) AS distance FROM r GROUP BY 1")
_CV = lambda s, d: latest_docs(table(s, d, "search_docs")).select("id", "vector").join(graph(s, d).live.select("id", meta("cluster_id").alias("cluster")).where("cluster <> ''"), "id")
_BIT = ", ".join(f"CASE WHEN 2 * sum(get_bit(x, {i})) > count(*) THEN '1' ELSE '0' END" for i in range(256))
add("cluster_centroids", lambda s, d: V.centroids(_CV(s, d), "cluster").select("cluster", F.hex("centroid").alias("centroid")), f"WITH {GRAPH_SQL}, {DOCS}, v AS (SELECT {_M('cluster_id')} AS cluster, vector::BIT AS x FROM sd JOIN l USING (id) WHERE {_M('cluster_id')} <> '' AND octet_length(vector) = 32), c AS (SELECT cluster, concat({_BIT}) AS b FROM v GROUP BY 1) SELECT cluster, hex(b::BIT::BLOB) AS centroid FROM c")
add("cluster_medoids", lambda s, d: V.medoids(_CV(s, d), V.centroids(_CV(s, d), "cluster"), "cluster"), f"WITH {GRAPH_SQL}, {DOCS}, v AS (SELECT l.id, {_M('cluster_id')} AS cluster, vector::BIT AS x FROM sd JOIN l USING (id) WHERE {_M('cluster_id')} <> '' AND octet_length(vector) = 32), c AS (SELECT cluster, concat({_BIT})::BIT AS b FROM v GROUP BY 1), k AS (SELECT cluster, id, bit_count(xor(x, b)) AS d FROM v JOIN c USING (cluster)), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY d, id) AS q FROM k) SELECT cluster, id AS medoid, d AS distance FROM r WHERE q = 1")
_TO = lambda s, d: table(s, d, "similarity_reports").groupBy().agg(F.max_by("topic_of", "report_id").alias("m")).select(F.explode("m").alias("cluster", "topic"))
_CL = lambda s, d: V.thoughts(graph(s, d)).where(meta("cluster_id") != "").groupBy(meta("cluster_id").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
add("topic_rollup", lambda s, d: V.topic_rollup(_CL(s, d), _TO(s, d)), f"{BASE}, o AS (SELECT arg_max(topic_of, report_id) AS m FROM similarity_reports), tt AS (SELECT unnest(map_keys(m)) AS cluster, unnest(map_values(m)) AS topic FROM o), c AS (SELECT {_M('cluster_id')} AS cluster, count(*) AS size FROM th WHERE {_M('cluster_id')} <> '' GROUP BY 1) SELECT coalesce(topic, cluster) AS topic, count(*) AS clusters, sum(size)::BIGINT AS size FROM c LEFT JOIN tt USING (cluster) GROUP BY 1")
add("topic_lifecycle", lambda s, d: V.topic_lifecycle(_CL(s, d).select(F.col("cluster").alias("topic"), "size", (F.substring("cluster", 4, 1) == "0").alias("has_summary"), F.when(F.col("size") > 10, F.lit(0.3)).alias("drift"))), f"{BASE}, c AS (SELECT {_M('cluster_id')} AS topic, count(*) AS size FROM th WHERE {_M('cluster_id')} <> '' GROUP BY 1) SELECT topic, CASE WHEN substr(topic, 4, 1) <> '0' AND size >= 5 THEN 'create' WHEN substr(topic, 4, 1) = '0' AND size > 10 THEN 'refresh' ELSE 'keep' END AS action FROM c")
add("cited_code_staleness", lambda s, d: V.cited_code(graph(s, d)), f"{BASE} SELECT from_id AS id, max(l.updated_at) AS code_at FROM e JOIN l ON l.id = e.to_id AND l.type IN ('file', 'function', 'method', 'type') WHERE from_id IN (SELECT id FROM th) GROUP BY 1")
add("charges_for_thoughts", lambda s, d: V.charges_of(graph(s, d)), f"{BASE} SELECT thought AS id, count(*) AS charges, string_agg(charge, ',' ORDER BY charge) AS ids FROM ch GROUP BY 1")
add("lineage", lambda s, d: V.lineage(graph(s, d), graph(s, d).live.where("type = 'thought' and status = 'settled'").select("id")), f"""{BASE}, u AS (SELECT to_id AS id, 0 AS p, from_id AS up FROM e WHERE type = 'contains' UNION ALL SELECT to_id, 1, from_id FROM e WHERE type = 'implements' UNION ALL SELECT from_id, 2, to_id FROM e WHERE type = 'informed-by'),
k AS (SELECT id, up, row_number() OVER (PARTITION BY id ORDER BY p, up) AS q FROM u WHERE up IN (SELECT id FROM l)), r AS (SELECT id AS start, id, 0 AS hop FROM th WHERE status = 'settled' UNION SELECT start, k.up, hop + 1 FROM r JOIN k ON k.id = r.id AND q = 1 WHERE hop < 10) SELECT start, id, min(hop) AS hop FROM r GROUP BY 1, 2""")
add("thought_summary", lambda s, d: V.summary(graph(s, d), NOW), f"{BASE} SELECT count(*) AS thoughts, sum((charges > 0)::INT)::BIGINT AS charged, round(avg(valence), 6) AS valence, round(max(magnitude), 6) AS magnitude FROM f")
add("recall", lambda s, d: V.recall(graph(s, d), NOW, min_valence=0.2, min_magnitude=0.5, limit=50), f"{BASE} SELECT id, symbol_name, {R6('valence', 'magnitude')} FROM f JOIN th USING (id) WHERE valence >= 0.2 AND magnitude >= 0.5 ORDER BY updated_at DESC, id LIMIT 50")

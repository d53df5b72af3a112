"""Queries of the graph analyzers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import analyzers as A
from sparkloom.operators import graph as G
from sparkloom.plans.registry import GRAPH_SQL, add, graph

WR = "WITH RECURSIVE" + GRAPH_SQL
CODE = ["CALLS", "USES_TYPE", "REFERENCES"]
THOUGHT = ["relates-to", "supports", "contradicts", "informed-by"]


def code(s, d, types=CODE):
    g = graph(s, d)
    return g.live.where("type in ('function', 'method', 'type')").select("id", "metadata"), G.analyzer_edges(g, types)


def thought(s, d):
    g = graph(s, d)
    return g.live.where("type = 'thought'").select("id"), G.analyzer_edges(g, THOUGHT)


r = lambda c, n: F.round(c, n).alias(c)
add("pagerank", lambda s, d: A.run("pagerank", *code(s, d)).select("id", r("score", 6)))
# ten rounds of the same recurrence in SQL
_PR = f"""{WR}, v AS (SELECT id FROM l WHERE type IN ('function', 'method', 'type')), k AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM e WHERE type IN ('CALLS', 'USES_TYPE', 'REFERENCES') AND from_id <> to_id AND from_id IN (SELECT id FROM l) AND to_id IN (SELECT id FROM l)),
o AS (SELECT src, count(*)::DOUBLE AS t FROM k GROUP BY 1), c AS (SELECT count(*)::DOUBLE AS n FROM v), r0 AS (SELECT id, 1.0 / n AS r FROM v, c), """ + ", ".join(
    f"r{i} AS (SELECT v.id, 0.15 / n + 0.85 * (coalesce((SELECT sum(x.r / o.t) FROM k JOIN r{i - 1} x ON x.id = k.src JOIN o ON o.src = k.src WHERE k.dst = v.id), 0) + (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM o)) / n) AS r FROM v, c)" for i in range(1, 6))


add("pagerank_five_rounds", lambda s, d: A.run("pagerank", *code(s, d), rounds=5).select("id", F.round("score", 9).alias("r")), f"{_PR} SELECT id, round(r, 9) AS r FROM r5")
_HITS = f"""{WR}, v AS (SELECT id FROM l WHERE type IN ('function', 'method', 'type')), k AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM e WHERE type IN ('CALLS', 'USES_TYPE', 'REFERENCES') AND from_id <> to_id AND from_id IN (SELECT id FROM l) AND to_id IN (SELECT id FROM l)), h0 AS (SELECT id, 1 / sqrt((SELECT count(*) FROM v)) AS h FROM v), """ + ", ".join(
    f"x{i} AS (SELECT dst AS id, sum(h) AS a FROM k JOIN h{i - 1} ON id = src GROUP BY 1), a{i} AS (SELECT id, a / (SELECT sqrt(sum(a * a)) FROM x{i}) AS a FROM x{i}), y{i} AS (SELECT src AS id, sum(a) AS h FROM k JOIN a{i} ON id = dst GROUP BY 1), h{i} AS (SELECT v.id, coalesce(h, 0) / (SELECT sqrt(sum(h * h)) FROM y{i}) AS h FROM v LEFT JOIN y{i} USING (id))" for i in range(1, 5))
add("hits_four_rounds", lambda s, d: A.run("hits", *code(s, d), rounds=4).select("id", r("hub", 7), r("authority", 7)), f"{_HITS} SELECT v.id, round(h, 7) AS hub, round(coalesce(a, 0), 7) AS authority FROM v JOIN h4 USING (id) LEFT JOIN a4 USING (id)")
add("pagerank_weighted", lambda s, d: A.run("pagerank_weighted", *thought(s, d)).select("id", r("score", 6)))
_PW = f"""{WR}, v AS (SELECT id FROM l WHERE type = 'thought'), k0 AS (SELECT from_id AS src, to_id AS dst, max(CASE WHEN weight = 0 THEN 1.0 ELSE weight END) AS w FROM e WHERE type IN ('relates-to', 'supports', 'contradicts', 'informed-by') AND from_id <> to_id AND from_id IN (SELECT id FROM l) AND to_id IN (SELECT id FROM l) GROUP BY 1, 2), k AS (SELECT * FROM k0 WHERE w > 0),
o AS (SELECT src, sum(w) AS t FROM k GROUP BY 1), c AS (SELECT count(*)::DOUBLE AS n FROM v), r0 AS (SELECT id, 1.0 / n AS r FROM v, c), """ + ", ".join(
    f"r{i} AS (SELECT v.id, 0.15 / n + 0.85 * (coalesce((SELECT sum(x.r * k.w / o.t) FROM k JOIN r{i - 1} x ON x.id = k.src JOIN o ON o.src = k.src WHERE k.dst = v.id), 0) + (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM o)) / n) AS r FROM v, c)" for i in range(1, 5))
add("pagerank_weighted_four_rounds", lambda s, d: A.run("pagerank_weighted", *thought(s, d), rounds=4).select("id", r("score", 9)), f"{_PW} SELECT id, round(r, 9) AS score FROM r4")
add("pagerank_findings", lambda s, d: A.findings(A.run("pagerank", *code(s, d)), "pagerank").select("algorithm", "rank", "id", "severity"))
add("hits", lambda s, d: A.run("hits", *code(s, d)).select("id", r("hub", 5), r("authority", 5)))
add("connected_components", lambda s, d: A.components(*code(s, d)).select("id", "comp"),
    f"{WR}, v AS (SELECT id FROM l WHERE type IN ('function', 'method', 'type')), k AS (SELECT from_id AS a, to_id AS b FROM e WHERE type IN ('CALLS', 'USES_TYPE', 'REFERENCES') AND from_id IN (SELECT id FROM l) AND to_id IN (SELECT id FROM l) AND from_id <> to_id UNION SELECT to_id, from_id FROM e WHERE type IN ('CALLS', 'USES_TYPE', 'REFERENCES') AND from_id IN (SELECT id FROM l) AND to_id IN (SELECT id FROM l) AND from_id <> to_id), r AS (SELECT id, id AS m FROM v UNION SELECT k.b, r.m FROM r JOIN k ON k.a = r.id JOIN v ON v.id = k.b WHERE r.m < k.b) SELECT id, min(m) AS comp FROM r GROUP BY 1")
add("betweenness", lambda s, d: A.run("betweenness", *code(s, d, ["CALLS"])).select("id", r("score", 4)))
# shortest paths and their numbers by levels; the calls of these tables are few and their paths short
add("betweenness_exact", lambda s, d: A.run("betweenness", *code(s, d, ["CALLS"]), exact=True).select("id", r("score", 4)),
    f"""{WR}, v AS (SELECT id FROM l WHERE type IN ('function', 'method', 'type')), k AS (SELECT DISTINCT from_id AS a, to_id AS b FROM e WHERE type = 'CALLS' AND from_id <> to_id AND from_id IN (SELECT id FROM l) AND to_id IN (SELECT id FROM l)),
w AS (SELECT a AS s, a AS t, 0 AS d FROM k UNION SELECT w.s, k.b, d + 1 FROM w JOIN k ON k.a = w.t WHERE d < 40), m AS (SELECT s, t, min(d) AS d FROM w GROUP BY 1, 2),
p AS (SELECT s, s AS t, 0 AS d, 1.0::DOUBLE AS n FROM m WHERE d = 0 UNION ALL SELECT p.s, k.b, p.d + 1, sum(p.n) FROM p JOIN k ON k.a = p.t JOIN m ON m.s = p.s AND m.t = k.b AND m.d = p.d + 1 GROUP BY 1, 2, 3),
c AS (SELECT s, t, d, sum(n) AS n FROM p GROUP BY 1, 2, 3)
SELECT v.id, round(coalesce(sum(x.n * y.n / z.n), 0), 4) AS score FROM v LEFT JOIN (c x JOIN c y ON y.s = x.t AND y.d > 0 AND x.d > 0 JOIN c z ON z.s = x.s AND z.t = y.t AND z.d = x.d + y.d) ON x.t = v.id GROUP BY 1""")
add("articulation", lambda s, d: A.run("articulation", *thought(s, d)))
add("community", lambda s, d: A.run("community", *code(s, d)))
add("community_incremental", lambda s, d: A.touched_communities(A.run("community", *code(s, d)), *code(s, d), code(s, d)[1].where("substr(src, 1, 1) = 'a'").select(F.col("src").alias("a"), F.col("dst").alias("b"))))
add("blast_radius", lambda s, d: A.run("blast_radius", *code(s, d, ["CALLS"]), seeds=code(s, d)[0].select("id"), depth=4).select("seed", "impacted", r("score", 6)),
    f"{WR}, k AS (SELECT DISTINCT to_id AS a, from_id AS b FROM e WHERE type = 'CALLS' AND from_id <> to_id AND from_id IN (SELECT id FROM l) AND to_id IN (SELECT id FROM l)), r AS (SELECT id AS seed, id, 0 AS d FROM l WHERE type IN ('function', 'method', 'type') UNION SELECT seed, k.b, d + 1 FROM r JOIN k ON k.a = r.id WHERE d < 4), m AS (SELECT seed, id, min(d) AS d FROM r GROUP BY 1, 2) SELECT seed, count(*) AS impacted, round(sum(1.0 / d), 6) AS score FROM m WHERE d > 0 AND id IN (SELECT id FROM l WHERE type IN ('function', 'method', 'type')) GROUP BY 1")
add("scc", lambda s, d: A.run("scc", *code(s, d)),
    f"{WR}, k AS (SELECT DISTINCT from_id AS a, to_id AS b FROM e WHERE type IN ('CALLS', 'USES_TYPE', 'REFERENCES') AND from_id <> to_id AND from_id IN (SELECT id FROM l) AND to_id IN (SELECT id FROM l)), r AS (SELECT a, b FROM k UNION SELECT r.a, k.b FROM r JOIN k ON k.a = r.b), s AS (SELECT r.a AS id, least(min(r.b), r.a) AS scc FROM r JOIN r q ON q.a = r.b AND q.b = r.a GROUP BY r.a HAVING count(DISTINCT CASE WHEN r.b <> r.a THEN r.b END) > 0) SELECT id, scc, count(*) OVER (PARTITION BY scc) AS size FROM s")
add("cycles", lambda s, d: A.run("cycles", *code(s, d, ["CALLS"])),
    f"""{WR}, k AS (SELECT DISTINCT from_id AS a, to_id AS b FROM e WHERE type = 'CALLS' AND from_id <> to_id AND from_id IN (SELECT id FROM l) AND to_id IN (SELECT id FROM l)), r AS (SELECT a, b FROM k UNION SELECT r.a, k.b FROM r JOIN k ON k.a = r.b),
sc AS (SELECT r.a AS id, least(min(r.b), r.a) AS scc FROM r JOIN r q ON q.a = r.b AND q.b = r.a GROUP BY r.a HAVING count(DISTINCT CASE WHEN r.b <> r.a THEN r.b END) > 0), sz AS (SELECT scc, count(*) AS size FROM sc GROUP BY 1),
ks AS (SELECT a, b, s.scc FROM k JOIN sc s ON s.id = a JOIN sc t ON t.id = b AND t.scc = s.scc JOIN sz ON sz.scc = s.scc WHERE size <= 40),
p AS (SELECT scc, a AS s, b AS t, [a] AS path FROM ks WHERE b > a UNION ALL SELECT p.scc, s, ks.b, list_append(path, t) FROM p JOIN ks ON ks.a = p.t WHERE t <> s AND ks.b >= s AND NOT list_contains(path, t)),
c AS (SELECT scc, array_to_string(path, '->') AS cycle, len(path) AS length FROM p WHERE t = s UNION ALL SELECT scc, '', 0 FROM sz WHERE size > 40)
SELECT scc, cycle, length, CASE WHEN length = 0 THEN 'critical' WHEN length = 2 THEN 'warning' WHEN length <= 5 THEN 'notice' ELSE 'info' END AS severity FROM c""")
# packages by the first digit of an id: links to higher digits, and one back from 3 to 1, which closes a cycle; two have names of known layers
_PKG = lambda c: F.when(F.left(c, F.lit(1)) == "5", F.lit("lib/util")).when(F.left(c, F.lit(1)) == "6", F.lit("app/cmd")).otherwise(F.concat(F.lit("p/"), F.left(c, F.lit(1))))
_PKG_SQL = "CASE left({0}, 1) WHEN '5' THEN 'lib/util' WHEN '6' THEN 'app/cmd' ELSE 'p/' || left({0}, 1) END".format
_DSM = f"""{WR}, m AS (SELECT {_PKG_SQL('from_id')} AS src, {_PKG_SQL('to_id')} AS dst, count(*) AS n FROM e WHERE type IN ('CALLS', 'USES_TYPE', 'REFERENCES') AND (left(from_id, 1) < left(to_id, 1) OR (left(from_id, 1) = '3' AND left(to_id, 1) = '1')) GROUP BY 1, 2),
rc AS (SELECT src AS a, dst AS b FROM m UNION SELECT rc.a, m.dst FROM rc JOIN m ON m.src = rc.b), p AS (SELECT src AS id FROM m UNION SELECT dst FROM m),
gr AS (SELECT p.id, coalesce(min(q.b), p.id) AS g, count(q.b) > 0 AS cyc FROM p LEFT JOIN (SELECT x.a, x.b FROM rc x JOIN rc y ON y.a = x.b AND y.b = x.a) q ON q.a = p.id GROUP BY 1), ge AS (SELECT DISTINCT s.g AS gs, t.g AS gd FROM m JOIN gr s ON s.id = src JOIN gr t ON t.id = dst WHERE s.g <> t.g),
ly AS (SELECT DISTINCT g, 0 AS k FROM gr UNION SELECT gs, k + 1 FROM ly JOIN ge ON gd = g), mx AS (SELECT g, max(k) AS k FROM ly GROUP BY 1), l2 AS (SELECT id, g, CASE WHEN id = 'lib/util' THEN 0 WHEN id = 'app/cmd' THEN (SELECT max(k) FROM mx) + 1 ELSE k END AS layer FROM gr JOIN mx USING (g))
SELECT src AS from_pkg, dst AS to_pkg, n, a.layer AS from_layer, b.layer AS to_layer, a.g = b.g AS in_cycle FROM m JOIN l2 a ON a.id = src JOIN l2 b ON b.id = dst WHERE b.layer > a.layer OR a.g = b.g"""


def _dsm(s, d):
    e = graph(s, d).edges.where(F.col("type").isin(*CODE))
    a, b = F.left("from_id", F.lit(1)), F.left("to_id", F.lit(1))
    m = e.where((a < b) | ((a == "3") & (b == "1"))).groupBy(_PKG(F.col("from_id")).alias("src"), _PKG(F.col("to_id")).alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    return A.run("dsm", m.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), m)


add("dsm_violations", _dsm, _DSM)
add("structural_motif", lambda s, d: A.motifs(graph(s, d), "contains", ["thought_session"], 1), f"""{WR}, c AS (SELECT DISTINCT from_id AS id, to_id AS child FROM e WHERE type = 'contains' AND from_id <> to_id), k AS (SELECT c.id, string_agg('(' || l.type || ':1)', '' ORDER BY l.type, child) AS below FROM c JOIN l ON l.id = child GROUP BY 1),
x AS (SELECT l.id, left(sha256('(' || type || ':0)' || coalesce(below, '')), 16) AS motif FROM l LEFT JOIN k USING (id) WHERE type = 'thought_session') SELECT motif, count(*) AS members, min(id) AS sample FROM x GROUP BY 1 HAVING count(*) >= 3""")
CHECKS = [{"name": "called", "node_type": "function", "edge_type": "CALLS", "direction": "in", "require": "present"}, {"name": "fan", "node_type": "type", "edge_type": "CALLS", "direction": "out", "max": 2}, {"name": "held", "node_type": "method", "edge_type": "CONTAINS", "direction": "in", "min": 1}]
add("corpus_scan", lambda s, d: A.corpus_scan(graph(s, d), CHECKS), f"""{WR}, i AS (SELECT to_id AS id, count(*) AS k FROM e WHERE type = 'CALLS' GROUP BY 1), o AS (SELECT from_id AS id, count(*) AS k FROM e WHERE type = 'CALLS' GROUP BY 1), h AS (SELECT to_id AS id, count(*) AS k FROM e WHERE type = 'CONTAINS' GROUP BY 1)
SELECT 'called' AS "check", id, 0 AS degree FROM l WHERE type = 'function' AND id NOT IN (SELECT id FROM i) UNION ALL SELECT 'fan', id, k FROM l JOIN o USING (id) WHERE type = 'type' AND k > 2 UNION ALL SELECT 'held', id, 0 FROM l WHERE type = 'method' AND id NOT IN (SELECT id FROM h)""")

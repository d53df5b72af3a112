"""Queries of the dataflow language over the thoughts and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.plans.recipe import Program, land
from sparkloom.plans.registry import GRAPH_SQL, add, graph

W = "WITH" + GRAPH_SQL
EMIT = '''
# sessions to topics
select thought_session where {"equals": {"of": "node.status", "value": "open"}}
bind $slug := lower(trim(node.id))
traverse contains out as $t
filter {"matches": {"of": "$t.status", "regex": "^(active|settled)$"}}
group_by $slug
emit topic {
    name := concat("topic-", $slug)
    state := node.status
    first := $t.name
} as $topic
emit use_case {
    name := concat("when-", $slug)
} as $uc
link $topic --[applies-when]--> $uc
'''
HEAD = '''
select thought where {"all": [{"exists": {"of": "node.metadata.cluster_id"}}, {"not": {"equals": {"of": "node.status", "value": "settled"}}}, {"descendant": {"edge": "charged-by", "where": {"equals": {"of": "node.metadata.polarity", "value": "positive"}}}}]}
bind $up := heading_path("contains", "status", " / ")
bind $kids := children_concat("charged-by", "type", "+")
bind $big := and(match_group(node.metadata.cluster_id, "c(\\\\d+)", "1"), not(has_edge("contradicts", "out")))
emit note {
    name := node.id
    path := $up
    kids := $kids
    mark := $big
}
'''
add("recipe_emit", lambda s, d: Program(EMIT, graph(s, d)).run()["nodes"].select("id", "type", "name"),
    f"""{W}, r AS (SELECT s.id FROM l s JOIN e ON e.from_id = s.id AND e.type = 'contains' JOIN l t ON t.id = e.to_id WHERE s.type = 'thought_session' AND s.status = 'open' AND t.status IN ('active', 'settled') GROUP BY 1)
SELECT left(sha256('practice' || chr(0) || 'source' || chr(0) || 'topic' || chr(0) || 'topic-' || lower(id)), 16) AS id, 'topic' AS type, 'topic-' || lower(id) AS name FROM r UNION ALL SELECT left(sha256('practice' || chr(0) || 'source' || chr(0) || 'use_case' || chr(0) || 'when-' || lower(id)), 16), 'use_case', 'when-' || lower(id) FROM r""")
_SESSIONS = f"{W}, r AS (SELECT s.id FROM l s JOIN e ON e.from_id = s.id AND e.type = 'contains' JOIN l t ON t.id = e.to_id WHERE s.type = 'thought_session' AND s.status = 'open' AND t.status IN ('active', 'settled') GROUP BY 1)"
_SID = "left(sha256('practice' || chr(0) || 'source' || chr(0) || '{0}' || chr(0) || '{1}-' || lower(id)), 16)".format
add("recipe_links", lambda s, d: Program(EMIT, graph(s, d)).run()["edges"], f"{_SESSIONS} SELECT {_SID('topic', 'topic')} AS from_id, {_SID('use_case', 'when')} AS to_id, 'applies-when' AS type FROM r")
add("recipe_group_keys", lambda s, d: Program('select thought_session\nbind $s := node.status\ngroup_by $s\nemit status {\n name := concat("s-", node.status)\n keys := group.keys\n}', graph(s, d)).run()["nodes"].select("name", F.col("fields")["keys"].alias("keys")),
    f"{W}, k AS (SELECT DISTINCT status FROM l WHERE type = 'thought_session') SELECT 's-' || status AS name, (SELECT string_agg(status, ',' ORDER BY status) FROM k) AS keys FROM k")
add("recipe_where_and_functions", lambda s, d: Program(HEAD, graph(s, d)).run()["nodes"].select("name", F.coalesce(F.col("fields")["path"], F.lit("")).alias("path"), F.coalesce(F.col("fields")["kids"], F.lit("")).alias("kids"), F.coalesce(F.col("fields")["mark"], F.lit("")).alias("mark")),
    f"""{W}, c AS (SELECT *, coalesce(element_at(metadata, 'cluster_id')[1], '') AS cl FROM l WHERE type = 'thought' AND status <> 'settled'), pos AS (SELECT DISTINCT from_id AS id FROM e JOIN l ON l.id = e.to_id AND coalesce(element_at(l.metadata, 'polarity')[1], '') = 'positive' WHERE e.type = 'charged-by'),
up AS (SELECT to_id AS id, min(from_id) AS p FROM e WHERE type = 'contains' GROUP BY 1), kd AS (SELECT from_id AS id, string_agg(t, '+') AS kids FROM (SELECT DISTINCT from_id, to_id, l.type AS t FROM e JOIN l ON l.id = to_id WHERE e.type = 'charged-by') GROUP BY 1), hc AS (SELECT DISTINCT from_id AS id FROM e WHERE type = 'contradicts')
SELECT c.id AS name, coalesce(l.status, '') AS path, coalesce(kids, '') AS kids, CASE WHEN regexp_extract(cl, 'c(\\d+)', 1) <> '' AND c.id NOT IN (SELECT id FROM hc) THEN '1' ELSE '' END AS mark FROM c LEFT JOIN up ON up.id = c.id LEFT JOIN l ON l.id = up.p LEFT JOIN kd ON kd.id = c.id WHERE cl <> '' AND c.id IN (SELECT id FROM pos)""")
add("recipe_walk", lambda s, d: Program('select thought_session where {"equals": {"of": "node.status", "value": "closed"}}\nwalk contains as $root\nemit step {\n name := concat($root.id, ":", node.id)\n depth := walk.depth\n position := walk.position\n}', graph(s, d)).run()["nodes"].select("name", F.col("fields")["depth"].alias("depth"), F.col("fields")["position"].alias("position")),
    f"""{W}, k AS (SELECT from_id AS a, to_id AS b, min(try_cast(CASE WHEN evidence LIKE '{{%' THEN json_extract_string(evidence, '$.position') END AS BIGINT)) AS p FROM e WHERE type = 'contains' GROUP BY 1, 2), r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY coalesce(p, 999999999999), b) AS n FROM k WHERE a IN (SELECT id FROM l WHERE type = 'thought_session' AND status = 'closed'))
SELECT a || ':' || b AS name, '1' AS depth, n::VARCHAR AS position FROM r WHERE b IN (SELECT id FROM l)""")
add("recipe_lookup", lambda s, d: Program('select thought_session\nemit topic {\n name := node.status\n identity := node.id\n}\nselect thought_session\nlookup topic by node.id as $t\nbind $none := "x"\nlink $t --[of]--> node.id', graph(s, d)).run()["edges"],
    f"{W} SELECT left(sha256('practice' || chr(0) || 'source' || chr(0) || 'topic' || chr(0) || id), 16) AS from_id, id AS to_id, 'of' AS type FROM l WHERE type = 'thought_session'")
add("recipe_landing", lambda s, d: land(Program(EMIT, graph(s, d)).run()["nodes"].select("id", "type", "name"), Program(EMIT, graph(s, d)).run()["nodes"].where("type = 'topic'").select("id"))[0].select("id", "type"), f"{_SESSIONS} SELECT {_SID('topic', 'topic')} || '@v2' AS id, 'topic' AS type FROM r UNION ALL SELECT {_SID('use_case', 'when')}, 'use_case' FROM r")

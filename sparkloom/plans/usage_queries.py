"""Queries of the usage analytics."""

from __future__ import annotations

from sparkloom.operators import usage as U
from sparkloom.plans.registry import USAGE_SQL, add, usage

W = "WITH" + USAGE_SQL
_P = "CAST(min(CASE WHEN cum >= ceil({q} * total) THEN (1::BIGINT << (b + 1)) - 1 END) AS BIGINT)"
_p = lambda q: _P.format(q=q)
ACTIVE = """
SELECT {k}, coalesce(sum(CASE WHEN gap < 600000 THEN gap END), 0)::BIGINT AS active_ms, coalesce(max(ms) - min(ms), 0)::BIGINT AS span_ms
FROM (SELECT *, ms - lag(ms) OVER (PARTITION BY {k} ORDER BY ms) AS gap FROM u WHERE ms IS NOT NULL {w}) GROUP BY {k}"""

add("usage_tool_latency", lambda s, d: U.tool_latency(usage(s, d)), f"{W} SELECT tool_name, total::BIGINT AS count, {_p(0.5)} AS p50, {_p(0.9)} AS p90, {_p(0.99)} AS p99 FROM hc GROUP BY tool_name, total")
add("usage_tool_time_totals", lambda s, d: U.tool_time_totals(usage(s, d)), f"{W} SELECT tool_name, coalesce(sum(CASE WHEN trust THEN duration_ms END), 0)::BIGINT AS total_duration_ms, count(*) AS call_count FROM u WHERE tool_name <> '' GROUP BY 1")
DUP = f"""{W}, p AS (SELECT tool_name, total, {_p(0.999)} AS p999 FROM hc GROUP BY 1, 2),
d AS (SELECT session_id, tool_name, tool_input_hash, count(*) AS run_count, coalesce(sum(CASE WHEN trust THEN duration_ms END), 0)::BIGINT AS wasted_ms, sum(trust::INT)::BIGINT AS trusted,
  sum(run_in_background::INT)::BIGINT AS background_runs, min(tool_input_preview) AS preview FROM u WHERE tool_name <> '' AND tool_input_hash <> '' GROUP BY 1, 2, 3 HAVING count(*) > 1),
x AS (SELECT d.*, CASE WHEN trusted > 0 THEN wasted_ms // trusted ELSE 0 END AS per_call_ms, (trusted > 0 AND coalesce(total, 0) >= {U.MIN_SAMPLES}) AS known, p999 FROM d LEFT JOIN p USING (tool_name)),
r AS (SELECT session_id, tool_name, tool_input_hash, run_count, wasted_ms, background_runs, preview, per_call_ms::BIGINT AS per_call_ms, CASE WHEN known THEN p999 ELSE 0 END::BIGINT AS p999_ms,
  CASE WHEN NOT known THEN 'undetermined' WHEN per_call_ms > p999 THEN 'implausible' ELSE 'plausible' END AS verdict FROM x)"""
add("usage_duplicate_groups", lambda s, d: U.duplicate_groups(usage(s, d)), f"{DUP} SELECT * FROM r")
add("usage_duplicate_commands_top", lambda s, d: U.duplicate_commands(usage(s, d)), f"{DUP} SELECT * FROM r ORDER BY (verdict = 'implausible')::INT, wasted_ms DESC, run_count DESC, session_id, tool_name, tool_input_hash LIMIT {U.TOP}")
add("usage_duplicate_truncation", lambda s, d: U.truncation(U.duplicate_groups(usage(s, d)), U.TOP, "duplicate_commands"), f"{DUP} SELECT 'duplicate_commands' AS family, least(count(*), {U.TOP}) AS returned, count(*) AS total FROM r")
add("usage_avg_tokens_per_session", lambda s, d: U.avg_tokens_per_session(usage(s, d)), f"{W}, s AS (SELECT session_id, sum(input_tokens) AS i, sum(output_tokens) AS o FROM u GROUP BY 1) SELECT round(avg(i), 6) AS avg_input, round(avg(o), 6) AS avg_output, round(avg(i + o), 6) AS avg_total, count(*) AS sessions FROM s")
for dim in ("subagent_type", "model", "project"):
    add(f"usage_tokens_by_{dim}", lambda s, d, dim=dim: U.tokens_by(usage(s, d), dim), f"{W} SELECT {dim} AS key, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM u GROUP BY 1")
add("usage_result_residency", lambda s, d: U.result_residency(usage(s, d)), f"""{W}, c AS (SELECT session_id, agent_id, us, sum((call AND us IS NOT NULL)::INT) OVER (PARTITION BY session_id, agent_id ORDER BY us DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after, tool_name, tool_result_bytes, tool_result_images, tool_result_spilled FROM u),
t AS (SELECT tool_name, tool_result_bytes, tool_result_spilled, (round(tool_result_bytes / 3.6) + 1500 * tool_result_images)::BIGINT AS tokens, CASE WHEN us IS NULL THEN 0 ELSE coalesce(after, 0) END AS after FROM c WHERE tool_name <> ''),
b AS (SELECT sum(cache_read_tokens + cache_creation_1h_tokens + cache_creation_5m_tokens + input_tokens) AS billed FROM u),
r AS (SELECT tool_name, count(*) AS calls, sum(tool_result_bytes)::BIGINT AS result_bytes, sum(tokens)::BIGINT AS result_tokens, sum(tokens * after)::BIGINT AS resident_tokens, sum(tool_result_spilled::INT)::BIGINT AS spilled_results FROM t GROUP BY 1)
SELECT r.*, round(CASE WHEN billed > 0 THEN resident_tokens / billed * 100 ELSE 0 END, 6) AS pct_billed_input FROM r, b WHERE result_bytes <> 0 OR result_tokens <> 0""")
add("usage_cache_efficiency", lambda s, d: U.cache_efficiency(usage(s, d)), f"{W} SELECT sum(cache_read_tokens)::BIGINT AS cache_read_tokens, sum(input_tokens)::BIGINT AS input_tokens, sum(cache_creation_1h_tokens)::BIGINT AS cc_1h, sum(cache_creation_5m_tokens)::BIGINT AS cc_5m, round(CASE WHEN sum(input_tokens) > 0 THEN sum(cache_read_tokens) / sum(input_tokens) ELSE 0 END, 6) AS ratio FROM u")
add("usage_waste_summary", lambda s, d: U.waste_summary(usage(s, d)), f"{W} SELECT sum(cache_creation_1h_tokens)::BIGINT AS cc_1h, sum(cache_creation_5m_tokens)::BIGINT AS cc_5m, sum(is_api_error::INT)::BIGINT AS api_errors, sum(interrupted::INT)::BIGINT AS interrupted, sum((stop_reason = 'max_tokens')::INT)::BIGINT AS truncated, coalesce(sum(CASE WHEN stop_reason = 'max_tokens' THEN output_tokens END), 0)::BIGINT AS truncated_output, coalesce(sum(CASE WHEN stop_reason = 'max_tokens' THEN duration_ms END), 0)::BIGINT AS truncated_ms FROM u")
SUB = f"""{W}, a AS ({ACTIVE.format(k='agent_id', w="AND agent_id <> '' AND is_sidechain")}),
t AS (SELECT agent_id, min(subagent_type) AS subagent_type, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM u WHERE agent_id <> '' AND is_sidechain GROUP BY 1),
r AS (SELECT t.*, coalesce(active_ms, 0) AS active_ms, coalesce(span_ms, 0) AS span_ms FROM t LEFT JOIN a USING (agent_id))"""
add("usage_subagent_wall_time", lambda s, d: U.subagent_wall_time(usage(s, d), 0), f"{SUB} SELECT * FROM r")
add("usage_subagent_wall_time_top", lambda s, d: U.subagent_wall_time(usage(s, d)), f"{SUB} SELECT * FROM r ORDER BY active_ms DESC, span_ms DESC, agent_id LIMIT {U.TOP}")
add("usage_agent_chains", lambda s, d: U.agent_chains(usage(s, d)), f"""{W}, a AS ({ACTIVE.format(k='session_id, agent_id', w="AND agent_id <> '' AND is_sidechain")}),
t AS (SELECT session_id, agent_id, min(subagent_type) AS kind FROM u WHERE agent_id <> '' AND is_sidechain GROUP BY 1, 2)
SELECT session_id, count(*) AS subagents, count(DISTINCT kind) AS kinds, sum(coalesce(span_ms, 0))::BIGINT AS total_span_ms, max(coalesce(span_ms, 0)) AS max_span_ms, sum(coalesce(active_ms, 0))::BIGINT AS total_active_ms, max(coalesce(active_ms, 0)) AS max_active_ms FROM t LEFT JOIN a USING (session_id, agent_id) GROUP BY 1""")
add("usage_lane_summary", lambda s, d: U.lane_summary(usage(s, d)), f"""{W}, a AS ({ACTIVE.format(k='session_id, agent_id', w='')}),
t AS (SELECT session_id, agent_id, coalesce(sum(CASE WHEN tool_name <> '' AND trust THEN duration_ms END), 0)::BIGINT AS tool_ms, sum(call::INT)::BIGINT AS turns FROM u GROUP BY 1, 2)
SELECT t.*, coalesce(active_ms, 0) AS active_ms, coalesce(span_ms, 0) AS span_ms, round(CASE WHEN coalesce(active_ms, 0) > 0 THEN turns / (active_ms / 60000.0) ELSE 0 END, 6) AS turns_per_min FROM t LEFT JOIN a USING (session_id, agent_id)""")
add("usage_lane_waits", lambda s, d: U.lane_waits(usage(s, d)), f"""{W}, x AS (SELECT DISTINCT session_id, agent_id, tool_name, duration_ms, tool_input_preview, uuid FROM u WHERE tool_name <> '' AND trust),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, agent_id ORDER BY duration_ms DESC, tool_name, tool_input_preview, uuid) AS rank FROM x) SELECT * FROM r WHERE rank <= {U.TOP_WAITS}""")
add("usage_provenance", lambda s, d: U.provenance(usage(s, d)), f"{W} SELECT count(DISTINCT (session_id, agent_id)) AS lanes, count(*) AS records, count(DISTINCT session_id) AS sessions, count(DISTINCT CASE WHEN agent_id <> '' THEN agent_id END) AS agents, min(ms) AS first_ms, max(ms) AS last_ms FROM u")
add("usage_lane_names", lambda s, d: U.lane_names(usage(s, d)), f"{W} SELECT DISTINCT regexp_extract(agent_id, '^a(.+)-[0-9a-f]{{16}}$', 1) AS name, agent_id, session_id FROM u WHERE regexp_matches(agent_id, '^a.+-[0-9a-f]{{16}}$')")
add("usage_time_range", lambda s, d: U.tool_time_totals(U.intake(__import__("sparkloom.runtime", fromlist=["table"]).table(s, d, "usage_rows"), scope="time_range", since="2026-03-01T00:00:00Z", until="2026-05-01T00:00:00Z")),
    f"{W} SELECT tool_name, coalesce(sum(CASE WHEN trust THEN duration_ms END), 0)::BIGINT AS total_duration_ms, count(*) AS call_count FROM u WHERE tool_name <> '' AND us >= epoch_us(TIMESTAMPTZ '2026-03-01 00:00:00+00') AND us < epoch_us(TIMESTAMPTZ '2026-05-01 00:00:00+00') GROUP BY 1")

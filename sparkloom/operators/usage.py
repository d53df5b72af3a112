"""Usage analytics over session rows: intake, latency, duplicates, tokens, residency, lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.operators.sliced import active_and_span, strictly_after

# Fixed values of the analytics.
TRUST_MS = 7_200_000
MIN_SAMPLES = 1000
BYTES_PER_TOKEN, IMAGE_TOKENS = 3.6, 1500
IDLE_MS = 600_000
TOP, TOP_WAITS = 100, 20
SYNTHETIC = "<synthetic>"
RFC3339 = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"

_LONGS = "input_tokens output_tokens cache_read_tokens cache_creation_tokens duration_ms cache_creation_1h_tokens cache_creation_5m_tokens web_search_count web_fetch_count tool_result_bytes tool_result_images".split()
_BOOLS = "is_error is_sidechain is_api_error is_meta interrupted tool_result_spilled run_in_background".split()
SCOPES = {"all": set(), "session_tree": {"session_id"}, "single": {"session_id", "agent_id"}, "time_range": {"since", "until"}}


def normalised(rows: DataFrame) -> DataFrame:
    """Null texts become empty, null numbers 0, null flags false; adds ``us`` and ``ms`` of the instant (null where unreadable)."""
    fix = []
    for f in rows.schema.fields:
        zero = F.lit(0).cast("long") if f.name in _LONGS else F.lit(False) if f.name in _BOOLS else F.lit("") if f.dataType.simpleString() == "string" else None
        fix.append(F.coalesce(F.col(f.name), zero).alias(f.name) if zero is not None else F.col(f.name))
    d = rows.select(*fix)
    us = F.when(F.col("record_ts").rlike(RFC3339), F.unix_micros(F.upper("record_ts").try_cast("timestamp")))
    return d.withColumn("us", us).withColumn("ms", F.floor(F.col("us") / 1000))


def intake(rows: DataFrame, *, since: str | None = None, until: str | None = None, model: str | None = None, tool: str | None = None, project: str | None = None,
           scope: str = "all", session_id: str | None = None, agent_id: str | None = None) -> DataFrame:
    """Rows that count: synthetic-model and meta rows are dropped, ``since`` is inclusive, ``until`` exclusive.

    A scope refuses selectors it does not use (ValueError). A missing meta flag keeps the row; sidechain rows
    are never dropped. A bound in time drops rows whose instant cannot be read.
    """
    given = {k for k, v in {"session_id": session_id, "agent_id": agent_id}.items() if v is not None}
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}")
    if given - SCOPES[scope] or (scope in ("session_tree", "single") and session_id is None):
        raise ValueError(f"scope {scope!r} takes {sorted(SCOPES[scope])}, got {sorted(given)}")
    d = normalised(rows).where((F.col("model") != SYNTHETIC) & ~F.col("is_meta"))
    for c, v in (("model", model), ("tool_name", tool), ("project", project), ("session_id", session_id)):
        if v is not None:
            d = d.where(F.col(c) == v)
    if scope == "single":
        d = d.where(F.col("agent_id") == (agent_id or ""))
    us = lambda t: F.unix_micros(F.lit(t).cast("timestamp"))
    if since is not None:
        d = d.where(F.col("us") >= us(since))
    if until is not None:
        d = d.where(F.col("us") < us(until))
    return d


def trustworthy() -> Column:
    return F.col("duration_ms").between(1, TRUST_MS) & ~F.col("interrupted")


def bucket(c: Column) -> Column:
    """floor(log2 ms) in [0, 31]; 0 below 2."""
    return F.when(c < 2, F.lit(0)).otherwise(F.least(F.length(F.bin(c)) - 1, F.lit(31)))


def hist_percentiles(hist: DataFrame, key: list[str], qs: dict[str, float]) -> DataFrame:
    """``(*key, total, *qs)`` from ``(*key, bucket, n)``: 2**(b+1)-1 of the first bucket whose running count reaches ceil(q total). At most 32 rows per key."""
    w = W.partitionBy(*key)
    d = hist.withColumn("cum", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    rep = (F.shiftleft(F.lit(1).cast("long"), 1) * F.pow(F.lit(2.0), F.col("bucket")) - 1).cast("long")
    return d.groupBy(*key, "total").agg(*[F.min(F.when(F.col("cum") >= F.ceil(F.lit(q) * F.col("total")), rep)).alias(a) for a, q in qs.items()])


def latency_histogram(d: DataFrame) -> DataFrame:
    return d.where((F.col("tool_name") != "") & trustworthy()).groupBy("tool_name", bucket(F.col("duration_ms")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def tool_latency(d: DataFrame) -> DataFrame:
    return hist_percentiles(latency_histogram(d), ["tool_name"], {"p50": 0.5, "p90": 0.9, "p99": 0.99}).withColumnRenamed("total", "count")


def tool_time_totals(d: DataFrame) -> DataFrame:
    return d.where("tool_name <> ''").groupBy("tool_name").agg(
        F.coalesce(F.sum(F.when(trustworthy(), F.col("duration_ms"))), F.lit(0)).alias("total_duration_ms"), F.count(F.lit(1)).alias("call_count"))


def duplicate_groups(d: DataFrame) -> DataFrame:
    """Groups (session, tool, input hash) run more than once, with waste, bound and verdict; blank tools or hashes are no command."""
    g = d.where("tool_name <> '' and tool_input_hash <> ''").groupBy("session_id", "tool_name", "tool_input_hash").agg(
        F.count(F.lit(1)).alias("run_count"), F.coalesce(F.sum(F.when(trustworthy(), F.col("duration_ms"))), F.lit(0)).alias("wasted_ms"),
        F.sum(trustworthy().cast("long")).alias("trusted"), F.sum(F.col("run_in_background").cast("long")).alias("background_runs"), F.min("tool_input_preview").alias("preview"),
    ).where("run_count > 1")
    bound = hist_percentiles(latency_histogram(d), ["tool_name"], {"p999": 0.999})
    g = g.join(bound, "tool_name", "left")
    per_call = F.when(F.col("trusted") > 0, F.floor(F.col("wasted_ms") / F.greatest("trusted", F.lit(1)))).otherwise(F.lit(0))
    known = (F.col("trusted") > 0) & (F.coalesce("total", F.lit(0)) >= MIN_SAMPLES)
    return g.select(
        "session_id", "tool_name", "tool_input_hash", "run_count", "wasted_ms", "background_runs", "preview", per_call.cast("long").alias("per_call_ms"),
        F.when(known, F.col("p999")).otherwise(F.lit(0)).cast("long").alias("p999_ms"),
        F.when(~known, F.lit("undetermined")).when(per_call > F.col("p999"), F.lit("implausible")).otherwise(F.lit("plausible")).alias("verdict"))


def duplicate_commands(d: DataFrame, top: int = TOP) -> DataFrame:
    g = duplicate_groups(d)
    order = [(F.col("verdict") == "implausible").cast("int"), F.desc("wasted_ms"), F.desc("run_count"), "session_id", "tool_name", "tool_input_hash"]
    return g.orderBy(*order).limit(top) if top else g


def avg_tokens_per_session(d: DataFrame) -> DataFrame:
    s = d.groupBy("session_id").agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    return s.agg(F.round(F.avg("i"), 6).alias("avg_input"), F.round(F.avg("o"), 6).alias("avg_output"), F.round(F.avg(F.col("i") + F.col("o")), 6).alias("avg_total"), F.count(F.lit(1)).alias("sessions"))


def tokens_by(d: DataFrame, dim: str) -> DataFrame:
    return d.groupBy(F.col(dim).alias("key")).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def is_model_call() -> Column:
    """A row of an assistant turn that was billed: no tool and some tokens."""
    return (F.col("tool_name") == "") & ((F.col("output_tokens") > 0) | (F.col("input_tokens") > 0))


def result_residency(d: DataFrame) -> DataFrame:
    """Per tool: calls, bytes, tokens, resident tokens (tokens times later model calls of the lane), share of all billed input; tools that measured nothing are left out."""
    r = strictly_after(d, ["session_id", "agent_id"], is_model_call()).where("tool_name <> ''")
    tokens = (F.round(F.col("tool_result_bytes") / BYTES_PER_TOKEN) + F.col("tool_result_images") * IMAGE_TOKENS).cast("long")
    t = r.withColumn("tokens", tokens).groupBy("tool_name").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tool_result_bytes").alias("result_bytes"), F.sum("tokens").alias("result_tokens"),
        F.sum(F.col("tokens") * F.col("after")).alias("resident_tokens"), F.sum(F.col("tool_result_spilled").cast("long")).alias("spilled_results"))
    billed = d.agg(F.sum(F.col("cache_read_tokens") + F.col("cache_creation_1h_tokens") + F.col("cache_creation_5m_tokens") + F.col("input_tokens")).alias("billed"))
    t = t.where("result_bytes <> 0 or result_tokens <> 0").crossJoin(F.broadcast(billed))  # one row
    return t.withColumn("pct_billed_input", F.round(F.when(F.col("billed") > 0, F.col("resident_tokens") / F.col("billed") * 100).otherwise(F.lit(0.0)), 6)).drop("billed")


def cache_efficiency(d: DataFrame) -> DataFrame:
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    a = d.agg(s("cache_read_tokens").alias("cache_read_tokens"), s("input_tokens").alias("input_tokens"), s("cache_creation_1h_tokens").alias("cc_1h"), s("cache_creation_5m_tokens").alias("cc_5m"))
    return a.withColumn("ratio", F.round(F.when(F.col("input_tokens") > 0, F.col("cache_read_tokens") / F.col("input_tokens")).otherwise(F.lit(0.0)), 6))


def waste_summary(d: DataFrame) -> DataFrame:
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    cut = F.col("stop_reason") == "max_tokens"
    return d.agg(
        s("cache_creation_1h_tokens").alias("cc_1h"), s("cache_creation_5m_tokens").alias("cc_5m"), s(F.col("is_api_error").cast("long")).alias("api_errors"), s(F.col("interrupted").cast("long")).alias("interrupted"),
        s(cut.cast("long")).alias("truncated"), s(F.when(cut, F.col("output_tokens"))).alias("truncated_output"), s(F.when(cut, F.col("duration_ms"))).alias("truncated_ms"))


def subagent_wall_time(d: DataFrame, top: int = TOP) -> DataFrame:
    a = d.where("agent_id <> '' and is_sidechain")
    t = a.groupBy("agent_id").agg(F.min("subagent_type").alias("subagent_type"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    r = t.join(active_and_span(a, ["agent_id"]).drop("rows"), "agent_id")
    return r.orderBy(F.desc("active_ms"), F.desc("span_ms"), "agent_id").limit(top) if top else r


def agent_chains(d: DataFrame) -> DataFrame:
    a = d.where("agent_id <> '' and is_sidechain")
    k = ["session_id", "agent_id"]
    t = a.groupBy(*k).agg(F.min("subagent_type").alias("kind")).join(active_and_span(a, k).drop("rows"), k)
    return t.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("subagents"), F.countDistinct("kind").alias("kinds"), F.sum("span_ms").alias("total_span_ms"), F.max("span_ms").alias("max_span_ms"),
        F.sum("active_ms").alias("total_active_ms"), F.max("active_ms").alias("max_active_ms"))


def lane_summary(d: DataFrame) -> DataFrame:
    """One row per lane: span, active time, tool time, model turns and turns per active minute."""
    k = ["session_id", "agent_id"]
    t = d.groupBy(*k).agg(F.coalesce(F.sum(F.when((F.col("tool_name") != "") & trustworthy(), F.col("duration_ms"))), F.lit(0)).alias("tool_ms"), F.sum(is_model_call().cast("long")).alias("turns"))
    r = t.join(active_and_span(d, k).drop("rows"), k)
    return r.withColumn("turns_per_min", F.round(F.when(F.col("active_ms") > 0, F.col("turns") / (F.col("active_ms") / 60000.0)).otherwise(F.lit(0.0)), 6))


def lane_waits(d: DataFrame, top: int = TOP_WAITS) -> DataFrame:
    """The longest trustworthy tool runs of every lane; combined per slice first, so no lane is one task."""
    order = [F.desc("duration_ms"), "tool_name", "tool_input_preview", "uuid"]
    x = d.where((F.col("tool_name") != "") & trustworthy()).select("session_id", "agent_id", "tool_name", "duration_ms", "tool_input_preview", "uuid").distinct()
    x = x.withColumn("salt", F.pmod(F.xxhash64("uuid"), F.lit(16)))
    x = x.withColumn("rank", F.row_number().over(W.partitionBy("session_id", "agent_id", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return x.withColumn("rank", F.row_number().over(W.partitionBy("session_id", "agent_id").orderBy(*order))).where(F.col("rank") <= top).drop("salt")


def provenance(d: DataFrame) -> DataFrame:
    return d.agg(
        F.countDistinct("session_id", "agent_id").alias("lanes"), F.count(F.lit(1)).alias("records"), F.countDistinct("session_id").alias("sessions"),
        F.countDistinct(F.when(F.col("agent_id") != "", F.col("agent_id"))).alias("agents"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


def lane_names(d: DataFrame) -> DataFrame:
    """Spawned lanes ``a<name>-<16 hex>`` by name: candidates with their sessions."""
    return d.where(F.col("agent_id").rlike(r"^a.+-[0-9a-f]{16}$")).select(F.regexp_extract("agent_id", r"^a(.+)-[0-9a-f]{16}$", 1).alias("name"), "agent_id", "session_id").distinct()


def truncation(total: DataFrame, cap: int, family: str) -> DataFrame:
    return total.agg(F.lit(family).alias("family"), F.least(F.count(F.lit(1)), F.lit(cap)).alias("returned"), F.count(F.lit(1)).alias("total"))

"""Session rows: parquet scan and sink, and reading of line-delimited logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

_STR = "source session_id project git_branch record_ts record_type model tool_name cli_version uuid parent_uuid tool_use_id agent_id subagent_type tool_input_hash tool_input_preview service_tier stop_reason mcp_server mcp_tool skill".split()
_ORDER = ("source session_id project git_branch record_ts record_type model input_tokens output_tokens cache_read_tokens cache_creation_tokens tool_name is_error cli_version uuid parent_uuid duration_ms "
          "tool_use_id is_sidechain agent_id subagent_type tool_input_hash tool_input_preview cache_creation_1h_tokens cache_creation_5m_tokens service_tier web_search_count web_fetch_count stop_reason "
          "is_api_error is_meta interrupted mcp_server mcp_tool skill tool_result_bytes tool_result_images tool_result_spilled run_in_background").split()
_BOOL = {"is_error", "is_sidechain", "is_api_error", "is_meta", "interrupted", "tool_result_spilled", "run_in_background"}
SCHEMA = T.StructType([T.StructField(c, T.StringType() if c in _STR else T.BooleanType() if c in _BOOL else T.LongType()) for c in _ORDER])
MAX_WAIT_MS = 7_200_000


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of session files or globs ``{source}/{session}.parquet`` with the file they come from; the schema is given, not inferred."""
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(*paths).withColumn("file", F.input_file_name())


def enumerate_files(spark: SparkSession, **roots: str) -> DataFrame:
    """``(source, path, size, modified)`` of the files below every named root."""
    out = None
    for source, root in roots.items():
        d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.lit(source).alias("source"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
        out = d if out is None else out.unionByName(d)
    return out


def sink(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Rows as zstd parquet by source; files appear when their write is committed."""
    rows.write.mode(mode).option("compression", "zstd").partitionBy("source").parquet(path)


def parse_layered_log(lines: DataFrame) -> DataFrame:
    """Rows of a layered log ``(file, line_no, value)``: session, directory, version, branch and model carry on to later lines.

    Token rows come from the last usage of a line: input is input less cached, output adds reasoning. A tool
    row takes its duration from the output of the same call, clamped to two hours, and its error from the text
    of it. Lines that are no JSON object are skipped. State is carried within a file; calls and outputs meet
    by (file, call id).
    """
    j = lambda p: F.get_json_object("value", p)
    d = lines.where(F.col("value").startswith("{")).select(
        "file", "line_no", j("$.timestamp").alias("record_ts"), j("$.type").alias("kind"), j("$.payload.type").alias("ptype"), j("$.payload.id").alias("sid"), j("$.payload.cwd").alias("cwd"),
        j("$.payload.cli_version").alias("version"), j("$.payload.git.branch").alias("branch"), j("$.payload.model").alias("model"), j("$.payload.call_id").alias("call_id"), j("$.payload.name").alias("name"),
        j("$.payload.arguments").alias("arguments"), j("$.payload.output").alias("output"), *[j(f"$.payload.info.last_token_usage.{c}").try_cast("long").alias(c) for c in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")],
    ).where(F.col("kind").isNotNull())
    w = W.partitionBy("file").orderBy("line_no")
    carry = lambda c: F.last(c, ignorenulls=True).over(w)
    meta = F.col("kind") == "session_meta"
    d = d.withColumn("sid", F.when(meta, F.col("sid"))).withColumns({c: carry(c) for c in ("sid", "cwd", "version", "branch", "model")})
    e = lambda c: F.coalesce(c, F.lit(""))
    z = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    base = [e(F.col("sid")).alias("session_id"), e(F.col("cwd")).alias("project"), e(F.col("branch")).alias("git_branch"), "record_ts", e(F.col("model")).alias("model"), e(F.col("version")).alias("cli_version")]
    tokens = d.where("ptype = 'token_count'").select(*base, F.lit("token_count").alias("record_type"), F.lit("").alias("tool_name"), F.greatest(z("input_tokens") - z("cached_input_tokens"), F.lit(0).cast("long")).alias("input_tokens"),
                                                     (z("output_tokens") + z("reasoning_output_tokens")).alias("output_tokens"), z("cached_input_tokens").alias("cache_read_tokens"), F.lit(0).cast("long").alias("duration_ms"), F.lit(False).alias("is_error"))
    outs = d.where("ptype = 'function_call_output'").groupBy("file", "call_id").agg(F.min(F.struct("line_no", F.col("record_ts").alias("end_ts"), F.col("output").alias("result"))).alias("o"))
    ms = lambda c: F.unix_millis(F.col(c).try_cast("timestamp"))
    calls = d.where("ptype = 'function_call'").join(outs, ["file", "call_id"], "left").withColumns({"end_ts": F.col("o.end_ts"), "result": F.col("o.result")})
    calls = calls.select(*base, F.lit("assistant").alias("record_type"), e(F.col("name")).alias("tool_name"), *[F.lit(0).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens")],
                         F.least(F.greatest(F.coalesce(ms("end_ts") - ms("record_ts"), F.lit(0)), F.lit(0)), F.lit(MAX_WAIT_MS)).cast("long").alias("duration_ms"), e(F.col("result")).rlike(r'"exit_code":\s*[1-9]|(?i)^error|exited with code [1-9]').alias("is_error"))
    said = d.where("ptype in ('user_message', 'agent_message')").select(*base, F.col("ptype").alias("record_type"), F.lit("").alias("tool_name"), *[F.lit(0).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "duration_ms")], F.lit(False).alias("is_error"))
    return tokens.unionByName(calls).unionByName(said)


def result_size(content: Column) -> Column:
    """``struct(bytes, images, spilled)`` of a tool result given as JSON: a text, or a list of text and image parts.

    A notice of a spilled result gives the size it names in place of its own.
    """
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    listed = content.startswith("[") & parts.isNotNull()
    text = F.when(listed, F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "")).otherwise(F.coalesce(F.from_json(F.concat(F.lit('{"t":'), content, F.lit("}")), "struct<t:string>")["t"], content))
    images = F.when(listed, F.size(F.filter(parts, lambda p: p["type"] == "image"))).otherwise(F.lit(0)).cast("long")
    size = F.regexp_extract(text, r"(?i)(?:output|result) (?:too large|saved|spilled)[^0-9]{0,80}([0-9][0-9.,]*)\s*(KB|MB|GB|B|bytes|characters)?", 1)
    unit = F.upper(F.regexp_extract(text, r"(?i)(?:output|result) (?:too large|saved|spilled)[^0-9]{0,80}[0-9][0-9.,]*\s*(KB|MB|GB|B|bytes|characters)?", 1))
    named = F.regexp_replace(size, ",", "").try_cast("double") * F.when(unit == "KB", 1024).when(unit == "MB", 1024**2).when(unit == "GB", 1024**3).otherwise(1)
    spilled = named.isNotNull()
    return F.struct(F.when(spilled, F.round(named)).otherwise(F.octet_length(F.coalesce(text, F.lit("")))).cast("long").alias("bytes"), images.alias("images"), spilled.alias("spilled"))

"""Mutations of graph tables as DataFrame to DataFrame functions, and upkeep by differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.functions.scalars import meta, parse_duration


def create(nodes: DataFrame, new: DataFrame) -> DataFrame:
    return nodes.unionByName(new, allowMissingColumns=True)


def update(nodes: DataFrame, changes: DataFrame, now_ns: int) -> DataFrame:
    """Rows with the non-null columns of ``changes`` (by id) in place of theirs; metadata merges per key, the change winning."""
    c = changes.select([F.col(x).alias(x if x == "id" else f"_{x}") for x in changes.columns])
    d = nodes.join(c.withColumn("_hit", F.lit(True)), "id", "left")
    cols = {}
    for x in changes.columns:
        if x == "metadata":
            old = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
            cols[x] = F.when(F.col("_metadata").isNotNull(), F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key("_metadata", k)), "_metadata")).otherwise(F.col("metadata"))
        elif x != "id":
            cols[x] = F.coalesce(f"_{x}", x)
    cols["updated_at"] = F.when(F.col("_hit"), F.lit(now_ns)).otherwise(F.col("updated_at"))
    return d.withColumns(cols).select(*nodes.columns)


def upsert(table: DataFrame, delta: DataFrame, key: list[str], at: str) -> DataFrame:
    """Latest row per key of table and delta; ties go to the delta."""
    u = table.withColumn("_n", F.lit(0)).unionByName(delta.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(*key).orderBy(F.col(at).desc_nulls_last(), F.desc("_n"))
    return u.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_n")


def link(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new, allowMissingColumns=True).distinct()


def unlink(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("from_id", "to_id", "type").distinct(), ["from_id", "to_id", "type"], "left_anti")


def delete(nodes: DataFrame, edges: DataFrame, ids: DataFrame, now_ns: int, *, hard: bool = False, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """Soft by default: rows get a tombstone; hard drops them and their edges; a dry run gives what would go."""
    i = ids.select("id").distinct()
    if dry_run:
        return nodes.join(i, "id", "left_semi"), edges.join(i, F.col("from_id") == F.col("id"), "left_semi")
    if hard:
        e = edges.join(i.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(i.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
        return nodes.join(i, "id", "left_anti"), e.select(*edges.columns)
    d = nodes.join(i.withColumn("_g", F.lit(True)), "id", "left")
    return d.withColumn("tombstoned_at", F.when(F.col("_g"), F.lit(now_ns)).otherwise(F.col("tombstoned_at"))).select(*nodes.columns), edges


def prune_selection(nodes: DataFrame, kind: str, older_than: str, now_ns: int, session: str | None = None) -> DataFrame:
    """Ids of a type created before now less a duration, of one session if asked."""
    d = nodes.where((F.col("type") == kind) & (F.col("created_at") < now_ns - int(parse_duration(older_than) * 1e9)))
    return (d.where(meta("session_id") == session) if session is not None else d).select("id")


# --- differences ----------------------------------------------------------------------------------
def content_hash(d: DataFrame, key: str, cols: list[str]) -> DataFrame:
    return d.select(F.col(key).alias("key"), F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256).alias("hash"))


def manifest_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """``(key, change)`` between manifests ``(key, hash)``: insert, update or delete; equal keys are left out."""
    d = new.select("key", F.col("hash").alias("h")).join(old.select("key", F.col("hash").alias("g")), "key", "full")
    return d.where(~F.col("h").eqNullSafe(F.col("g"))).select("key", F.when(F.col("g").isNull(), F.lit("insert")).when(F.col("h").isNull(), F.lit("delete")).otherwise(F.lit("update")).alias("change"))


def narrow(nodes: DataFrame, changed: DataFrame, kind: str = "file", keep_fileless: bool = True) -> DataFrame:
    """Nodes to send again: by id (kind node) or by file path (kind file); nodes of no file by the flag."""
    if kind == "node":
        return nodes.join(changed.select(F.col("key").alias("id")), "id", "left_semi")
    d = nodes.where("file_path <> ''").join(changed.select(F.col("key").alias("file_path")), "file_path", "left_semi")
    return d.unionByName(nodes.where("file_path = ''").select(*d.columns)) if keep_fileless else d


def guard_deletions(diff: DataFrame, total: int, most: float = 0.5) -> DataFrame:
    """Refuses a diff that deletes more than a share of all keys."""
    n = diff.where("change = 'delete'").count()
    if total and n > most * total:
        raise ValueError(f"{n} of {total} keys would be deleted")
    return diff


def upload_chunks(nodes: DataFrame, cap_bytes: int, epoch: int) -> DataFrame:
    """Nodes with ``epoch`` and ``chunk``: a file stays together; chunks of a slice of files fill up to a cap by running size."""
    size = F.octet_length(F.coalesce("content", F.lit(""))) + 200
    f = nodes.groupBy("file_path").agg(F.sum(size).alias("_b")).withColumn("_s", F.pmod(F.xxhash64("file_path"), F.lit(64)))
    w = W.partitionBy("_s").orderBy("file_path").rowsBetween(W.unboundedPreceding, -1)
    f = f.withColumn("chunk", F.concat_ws("-", "_s", F.floor(F.coalesce(F.sum("_b").over(w), F.lit(0)) / cap_bytes)))
    return nodes.join(f.select("file_path", "chunk"), "file_path").withColumn("epoch", F.lit(epoch))


def drop_stale_epochs(d: DataFrame, key: str = "id") -> DataFrame:
    """Of every key the rows of the latest epoch: late rows of an older collection do not undo a newer one."""
    m = d.groupBy(key).agg(F.max("epoch").alias("epoch"))
    return d.join(m, [key, "epoch"], "left_semi")


def upload_gate(files: DataFrame, marks: DataFrame, now_s: int, version: int, quiet_s: int = 900, most_s: int = 21_600) -> DataFrame:
    """``(path, action)``: ship without a mark, with an older version; skip what is unchanged; ship changes once quiet for 15 minutes or 6 hours after the last ship; else defer."""
    d = files.join(marks.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.col("version").alias("_v"), F.col("seed").alias("_seed")), "path", "left")
    a = F.when(F.col("_m").isNull() | F.coalesce("_seed", F.lit(False)) | (F.col("_v") < version), "ship").when((F.col("size") == F.col("_s")) & (F.col("mtime") == F.col("_m")), "skip")
    a = a.when((now_s - F.col("mtime") >= quiet_s) | (F.col("mtime") - F.col("_m") >= most_s), "ship").otherwise("defer")
    return d.select("path", a.alias("action"))


def bucket_of(c, bits: int):
    """Bucket of an id among 2**bits, by its SHA-256."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long") % F.lit(1 << bits)


def dirty_buckets(docs: DataFrame, changed: DataFrame, bits: int) -> DataFrame:
    """Documents of the buckets in which anything changed: only these are rebuilt."""
    b = changed.select(bucket_of(F.col("id"), bits).alias("bucket")).distinct()
    return docs.withColumn("bucket", bucket_of(F.col("id"), bits)).join(b, "bucket", "left_semi")


def compaction_plan(segments: DataFrame, dead_ratio: float = 0.33, most: int = 16) -> DataFrame:
    """Segments ``(segment, docs, dead)`` to merge: too many dead documents, or too many segments."""
    n = segments.agg(F.count(F.lit(1)).alias("n"))
    return segments.crossJoin(F.broadcast(n)).select("segment", ((F.col("dead") / F.greatest("docs", F.lit(1)) > dead_ratio) | (F.col("n") > most)).alias("merge"))  # one row


def tombstone_union(retained: DataFrame, scanned: DataFrame, emitted_buckets: DataFrame, bits: int) -> DataFrame:
    u = retained.select("id").union(scanned.select("id")).distinct().withColumn("bucket", bucket_of(F.col("id"), bits))
    return u.join(emitted_buckets.select("bucket").distinct(), "bucket", "left_anti").select("id")


def reconcile(cache: DataFrame, live: int, horizon: int, max_cursor: int) -> bool:
    """A cache holds if it has as many rows up to the horizon as the probe says and its greatest cursor is the probe's."""
    return cache_state(cache, live, horizon, max_cursor).first().holds


def cache_state(cache: DataFrame, live: int, horizon: int, max_cursor: int) -> DataFrame:
    """``(rows, cursor, holds)``, one row: what a cache holds up to a safe horizon and whether that is what the probe says."""
    r = cache.where(F.col("updated_at") <= horizon).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max("updated_at"), F.lit(0)).alias("cursor"))
    return r.withColumn("holds", (F.col("rows") == live) & (F.col("cursor") == max_cursor))


def progress_mark(rows: DataFrame, mark: int, at: str = "updated_at", grace: int = 0) -> DataFrame:
    """``(mark, pending, next_mark)``, one row: rows past a watermark and the mark after them; rows younger than ``grace`` before the newest stay pending for the next round."""
    top = rows.agg(F.coalesce(F.max(at), F.lit(mark)).alias("top"))
    safe = F.greatest(F.lit(mark), F.col("top") - grace)
    d = rows.select(F.col(at).alias("_at")).where(F.col("_at") > mark).join(F.broadcast(top), F.col("_at") <= safe)  # one row
    n = d.agg(F.count(F.lit(1)).alias("pending"), F.max("_at").alias("m"))
    return n.select(F.lit(mark).alias("mark"), "pending", F.coalesce("m", F.lit(mark)).alias("next_mark"))


# --- pacing -----------------------------------------------------------------------------------------
def backoff_ms(attempt: Column, key: Column, *, base: int = 1000, most: int = 60_000) -> Column:
    """Milliseconds to wait before an attempt (from 1): doubling from ``base`` up to ``most``, with a share of up to one half taken off by the key, the same on every run."""
    full = F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(attempt, F.lit(1)) - 1))
    jitter = (F.conv(F.substring(F.sha2(F.concat_ws(":", key, attempt.cast("string")), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)) / 2
    return F.floor(full * (1 - jitter)).cast("long")


def pace(calls: DataFrame, per_minute: int, *, axis: str = "axis", order: str = "id") -> DataFrame:
    """Calls with ``send_ms``, when a gate of so many calls a minute and axis lets them pass, in their order.

    Ranks come from counts of slices and ranks inside them, so an axis is many tasks.
    """
    d = calls.withColumn("_h", F.substring(F.sha2(F.col(order).cast("string"), 256), 1, 3))
    n = d.groupBy(axis, "_h").agg(F.count(F.lit(1)).alias("_n"))
    before = n.withColumn("_b", F.coalesce(F.sum("_n").over(W.partitionBy(axis).orderBy("_h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    r = d.withColumn("_r", F.row_number().over(W.partitionBy(axis, "_h").orderBy(order)) - 1).join(before, [axis, "_h"])
    return r.withColumn("send_ms", F.floor((F.col("_b") + F.col("_r")) * 60_000 / per_minute).cast("long")).drop("_h", "_r", "_b")

"""Structured streaming: change feed, tumbling windows, activity sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.operators.mutations import bucket_of, upsert
from sparkloom.runtime import list_names, path_exists, remove_path


BUCKET_BITS = 6


def change_feed(spark: SparkSession, delta_dir: str, schema, target: str, checkpoint: str, *, key: str = "id", at: str = "updated_at", files: int = 100, bits: int = BUCKET_BITS) -> StreamingQuery:
    """Applies delta files to a table of the latest row per key, version by version; run with what is there, then stop.

    The table is kept in 2**bits buckets of its keys. A batch reads and writes only the buckets its keys fall in,
    beside the old ones, and names what it wrote in a log last, so a lost executor or a repeated batch leaves the
    table as it was or as it should be. Rows without a key are dropped.
    """

    def apply(batch: DataFrame, n: int) -> None:
        d = batch.where(F.col(key).isNotNull()).withColumn("bucket", bucket_of(F.col(key).cast("string"), bits).cast("int"))
        touched = sorted(r.bucket for r in d.select("bucket").distinct().toLocalIterator())  # at most 2**bits
        if not touched:
            return
        old = current(spark, target, touched)
        base = d.limit(0) if old is None else old.withColumn("bucket", bucket_of(F.col(key).cast("string"), bits).cast("int"))
        path = f"{target}/v{n:08d}"
        upsert(base, d, [key], at).repartition("bucket", F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(path)
        spark.createDataFrame([(n, b) for b in touched], "version long, bucket int").coalesce(1).write.mode("append").parquet(f"{target}/_log")

    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(delta_dir)
    return src.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, target: str) -> dict[int, int]:
    """The newest version of every bucket of a fed table; empty before the first batch."""
    if not path_exists(spark, f"{target}/_log"):
        return {}
    return {r.bucket: r.version for r in spark.read.parquet(f"{target}/_log").groupBy("bucket").agg(F.max("version").alias("version")).toLocalIterator()}


def current(spark: SparkSession, target: str, buckets: list[int] | None = None) -> DataFrame | None:
    """The newest rows of a fed table, of some buckets if told, or None where there are none."""
    paths = [f"{target}/v{v:08d}/bucket={b}" for b, v in sorted(newest(spark, target).items()) if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None


def vacuum(spark: SparkSession, target: str) -> int:
    """Drops the buckets that a newer version has replaced; how many."""
    keep, gone = newest(spark, target), 0
    for r in spark.read.parquet(f"{target}/_log").distinct().toLocalIterator():
        if keep[r.bucket] != r.version and path_exists(spark, old := f"{target}/v{r.version:08d}/bucket={r.bucket}"):
            remove_path(spark, old)
            gone += 1
    return gone


def windowed_counts(events: DataFrame, *, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Events ``(ts, event_type, value)`` per tumbling window and type; rows later than the watermark are dropped."""
    e = events.withWatermark("ts", late)
    return e.groupBy(F.window("ts", f"{seconds} seconds"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def join_sessions(sessions: DataFrame, gap: str, user: str) -> DataFrame:
    """Sessions ``(user, start, last, n)`` with those of a user joined that are less than a gap apart; one without a time stays by itself."""
    w = Window.partitionBy(user).orderBy(F.asc_nulls_last("start")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = F.col("start") - F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)) < F.expr(f"interval {gap}")
    k = F.sum(F.when(F.col("near"), 0).otherwise(1)).over(w)
    return sessions.withColumn("near", near).withColumn("k", k).groupBy(user, "k").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("k")


def activity_sessions(events: DataFrame, target: str, checkpoint: str, *, gap: str = "15 minutes", user: str = "user_id") -> StreamingQuery:
    """Feeds a table of sessions, a user's events ``(user, ts)`` that are less than a gap apart, with what is there, then stops.

    The table is the state: a batch joins its events to the sessions so far and writes the next version, so no session is
    held in memory or passes the driver, and late events count. The version before stays for a batch that is repeated.
    """
    spark = events.sparkSession

    def apply(batch: DataFrame, n: int) -> None:
        new = batch.select(user, F.col("ts").alias("start"), F.col("ts").alias("last"), F.lit(1).cast("long").alias("n"))
        old = [v for v in _versions(spark, target) if v < n]
        if old:
            new = new.unionByName(spark.read.schema(new.schema).parquet(f"{target}/v{old[-1]:08d}"))
        join_sessions(new, gap, user).write.mode("overwrite").parquet(f"{target}/v{n:08d}")
        for v in old[:-1]:
            remove_path(spark, f"{target}/v{v:08d}")

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, target: str) -> list[int]:
    return sorted(int(x[1:]) for x in list_names(spark, target) if x[0] == "v")


def sessions_of(spark: SparkSession, target: str, *, gap: str = "15 minutes") -> DataFrame | None:
    """The sessions ``(user, start, end, n)`` of a fed table, the end a gap after the last event; None before the first batch."""
    if not (v := _versions(spark, target)):
        return None
    d = spark.read.parquet(f"{target}/v{v[-1]:08d}")
    return d.select(d.columns[0], "start", (F.col("last") + F.expr(f"interval {gap}")).alias("end"), "n")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what is there into an in-memory table; for reports and tests."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

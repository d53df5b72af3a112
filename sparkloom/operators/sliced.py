"""Window computations over long lanes in two levels, so that a hot lane is many tasks.

Rows are ordered inside (lane, hour); only one summary row per (lane, hour) is ordered over the lane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SLICE_US = 3_600_000_000


def with_slice(df: DataFrame, us: str = "us") -> DataFrame:
    return df.withColumn("_slice", F.floor(F.col(us) / SLICE_US))


def strictly_after(df: DataFrame, lane: list[str], flag: Column, us: str = "us", out: str = "after") -> DataFrame:
    """Adds to every row the number of flagged rows of its lane whose instant is strictly later. Rows with a null instant get 0 and count for none."""
    d = with_slice(df.withColumn("_flag", F.when(F.col(us).isNotNull() & flag, F.lit(1)).otherwise(F.lit(0))), us)
    per = d.groupBy(*lane, "_slice").agg(F.sum("_flag").alias("_n"))
    w = W.partitionBy(*lane).orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)
    per = per.where(F.col("_slice").isNotNull()).select(*[F.col(c).alias(f"_l{i}") for i, c in enumerate(lane)], F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_later"))
    inside = W.partitionBy(*lane, "_slice").orderBy(F.desc(us)).rangeBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_in", F.when(F.col(us).isNotNull(), F.coalesce(F.sum("_flag").over(inside), F.lit(0))))
    cond = F.col("_slice") == F.col("_s")
    for i, c in enumerate(lane):
        cond = cond & (F.col(c) == F.col(f"_l{i}"))
    d = d.join(per, cond, "left")
    return d.withColumn(out, F.coalesce(F.col("_in") + F.col("_later"), F.lit(0)).cast("long")).drop("_flag", "_slice", "_in", "_later", "_s", *[f"_l{i}" for i in range(len(lane))])


def active_and_span(df: DataFrame, lane: list[str], ms: str = "ms", idle_ms: int = 600_000) -> DataFrame:
    """``(*lane, active_ms, span_ms, rows)``: sum of gaps below ``idle_ms`` and last minus first instant; rows without an instant only count in ``rows``."""
    d = df.withColumn("_slice", F.floor(F.col(ms) / (SLICE_US // 1000)))
    w = W.partitionBy(*lane, "_slice").orderBy(ms)
    gap = F.col(ms) - F.lag(ms).over(w)
    per = d.withColumn("_g", gap).groupBy(*lane, "_slice").agg(
        F.coalesce(F.sum(F.when(F.col("_g") < idle_ms, F.col("_g"))), F.lit(0)).alias("_in"), F.min(ms).alias("_a"), F.max(ms).alias("_b"), F.count(F.lit(1)).alias("_n"))
    over = W.partitionBy(*lane).orderBy("_slice")
    per = per.withColumn("_x", F.when(F.col("_slice").isNotNull(), F.col("_a") - F.lag("_b").over(over)))
    return per.groupBy(*lane).agg(
        (F.sum("_in") + F.coalesce(F.sum(F.when(F.col("_x") < idle_ms, F.col("_x"))), F.lit(0))).cast("long").alias("active_ms"),
        F.coalesce(F.max("_b") - F.min("_a"), F.lit(0)).cast("long").alias("span_ms"), F.sum("_n").alias("rows"))

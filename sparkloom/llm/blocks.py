"""Helpers for operators that compare rows inside small groups of a sorted partition."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def sorted_groups(batches: Iterator[pd.DataFrame], key: str | list[str]) -> Iterator[pd.DataFrame]:
    """Yield one frame per run of equal keys from batches that arrive sorted by ``key``; a run may span batches."""
    keys = [key] if isinstance(key, str) else key
    held: list[pd.DataFrame] = []
    last = None
    for b in batches:
        if b.empty:
            continue
        k = b[keys]
        change = (k != k.shift()).any(axis=1).to_numpy()
        change[0] = True
        starts = [*change.nonzero()[0], len(b)]
        for s, e in zip(starts, starts[1:]):
            part = b.iloc[s:e]
            now = tuple(part[keys].iloc[0])
            if held and now != last:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
            last = now
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def parts_for(spark: SparkSession, rows: float, per_part: float) -> int:
    """Shuffle partitions so that none holds many more than ``per_part`` rows."""
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(least, int(rows // per_part) + 1)


def latest(df: DataFrame, id_col: str, value: str, at: str) -> DataFrame:
    """``(id, value)`` of the row with the greatest ``at`` per id (nulls lowest, ties by the greater value); blank ids are dropped."""
    from pyspark.sql import functions as F

    return (
        df.where(F.col(id_col).isNotNull() & (F.trim(F.col(id_col)) != ""))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.struct(F.coalesce(F.col(at), F.lit(-(2**62))).alias("at"), F.col(value).alias("v"))).alias("m"))
        .select("id", F.col("m.v").alias(value))
    )


def bounded_sample(df: DataFrame, by: list[str], rows: int) -> DataFrame:
    """The ``rows`` rows of the smallest hash of ``by``; about twice as many leave the executors in all, however many partitions there are."""
    from pyspark.sql import functions as F

    n, space = df.count(), 1 << 30
    h = F.xxhash64(*by)
    if n > 4 * rows:
        df = df.where(F.pmod(F.xxhash64(F.lit(7), *by), F.lit(space)) < int(space * 2 * rows / n))
    return df.orderBy(h, *by).limit(rows)

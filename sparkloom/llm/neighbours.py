"""Problem 5: the most similar vectors of every vector, by multi-index hashing over learned binary codes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.llm.blocks import bounded_sample, latest, parts_for, sorted_groups
from sparkloom.runtime import materialize

#: Rows the rotation is learned from: those of the smallest id hash, at most this many.
SAMPLE_ROWS = 16_384
#: Effort that searches all index tables; smaller ones of a record search as large a part of them.
FULL_EFFORT = 64
#: Index tables: TABLES * TABLES_GROWTH ** bits of a substring.
TABLES, TABLES_GROWTH = 5.8, 1.12
#: About how many rows a bucket of an index table holds; bits and tables grow with the rows.
BUCKET_ROWS = 64
#: Largest side of a block of vectors that one step compares; larger buckets are cut into pairs of blocks.
BLOCK_ROWS = 4096
#: Buckets that need cutting are broadcast up to this many rows (16 bytes each), joined by shuffle beyond.
MAX_BROADCAST_ROWS = 20_000
#: Bits of a substring's place in the number of its bucket; the table stands above them.
TABLE_SHIFT = 40


def learn_rotations(sample: np.ndarray, rounds: int, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean and a (dim, rounds*dim) projection: PCA, then ``rounds`` iterative-quantisation rotations from different starts."""
    dim = sample.shape[1]
    mean = sample.mean(0)
    p0 = sample - mean
    _, v = np.linalg.eigh(p0.T @ p0 / max(1, len(sample)))
    v = v[:, ::-1]
    p = p0 @ v
    out = []
    for k in range(rounds):
        r = np.linalg.qr(np.random.default_rng(k).normal(size=(dim, dim)))[0]
        for _ in range(steps):
            u, _, vt = np.linalg.svd(np.where(p @ r > 0, 1.0, -1.0).T @ p)
            r = (u @ vt).T
        out.append(v @ r)
    return mean, np.concatenate(out, axis=1)


def unit_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """``(id, ef, unit)`` with unit-length float32 bytes of usable vectors: ``dim`` finite values, not all zero."""

    def to_unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok, units = [], []
            for i, v in enumerate(b["v"]):
                if v is None or len(v) != dim:
                    continue
                x = np.asarray(v, dtype=np.float64)
                s = np.sqrt((x * x).sum())
                if np.isfinite(s) and s > 0:
                    ok.append(i)
                    units.append((x / s).astype(np.float32).tobytes())
            yield b[["id", "ef"]].iloc[ok].assign(unit=units)

    return vectors.mapInPandas(to_unit, "id string, ef int, unit binary")


def _top(sim: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (row, column) of the k largest entries of every row that reach ``floor``."""
    if sim.shape[1] > 4 * k:
        p = np.argpartition(-sim, k, axis=1)[:, : k + 1]
        rows = np.repeat(np.arange(sim.shape[0]), p.shape[1])
        cols = p.ravel()
    else:
        rows, cols = np.divmod(np.arange(sim.size), sim.shape[1])
    keep = sim[rows, cols] >= floor
    return rows[keep], cols[keep]


def nearest(units: DataFrame, *, dim: int, k: int, floor: float) -> DataFrame:
    """``(q, r, sim)`` for rows ``(nid long, unit binary, ef int)`` of distinct unit vectors: the k best others reaching ``floor``.

    Codes of several learned rotations are split into substrings of about log2(n / BUCKET_ROWS) bits; every
    substring is an index table. A longer substring is met less often, by about one tenth a bit, so the tables grow
    by as much with each bit and the recall holds. Two codes that differ in fewer bits than
    there are tables agree in one substring (pigeonhole), so equal substrings retrieve the whole Hamming ball of
    that radius and most pairs beyond it. Retrieved rows meet as blocks and are reranked by their float cosine. A
    record with an effort ``ef`` below FULL_EFFORT searches that share of the tables, at least four, while every
    record stands in all of them. Buckets above BLOCK_ROWS become pairs of blocks that are tasks of their own: no
    bucket is cut short and none is one task.
    """
    spark = units.sparkSession
    n = units.count()
    bits = max(4, int(math.log2(max(2, n) / BUCKET_ROWS)))
    tables = math.ceil(TABLES * TABLES_GROWTH ** bits)
    sample = bounded_sample(units, ["nid"], SAMPLE_ROWS).select("unit").toPandas()
    if len(sample) < 2:
        return spark.createDataFrame([], "q long, r long, sim double")
    train = np.frombuffer(b"".join(sample["unit"]), dtype=np.float32).reshape(-1, dim).astype(np.float64)
    mean, proj = learn_rotations(train, math.ceil(bits * tables / dim))
    mean, proj = mean.astype(np.float32), proj[:, : bits * tables].astype(np.float32)

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = 1 << np.arange(bits, dtype=np.int64)
        base = np.arange(tables, dtype=np.int64) << TABLE_SHIFT
        for b in batches:
            if b.empty:
                continue
            x = np.frombuffer(b"".join(b["unit"]), dtype=np.float32).reshape(-1, dim)
            on = ((x - mean) @ proj > 0).reshape(len(x), tables, bits)
            mine = np.clip(np.ceil(b["ef"].to_numpy() / FULL_EFFORT * tables), 4, tables).astype(np.int32)
            yield pd.DataFrame({"nid": b["nid"], "unit": b["unit"], "own": mine, "g": list(on @ weight + base)})

    coded = materialize(units.mapInPandas(codes, "nid long, unit binary, own int, g array<long>"), "p5-codes")
    rows = coded.df.select("nid", "unit", "own", F.explode("g").alias("g"))
    hot = (
        coded.df.select(F.explode("g").alias("g"))
        .groupBy("g").count().where(F.col("count") > BLOCK_ROWS)
        .select("g", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("cuts"))
    )
    hot_m = materialize(hot, "p5-hot")
    hot_rows = hot_m.df.count()
    rows = rows.join(F.broadcast(hot_m.df) if hot_rows <= MAX_BROADCAST_ROWS else hot_m.df, "g", "left")
    rows = rows.withColumn("cuts", F.coalesce("cuts", F.lit(1))).withColumn("blk", F.pmod(F.xxhash64("nid"), F.col("cuts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(
        "g", (F.least("blk", "other").cast("long") * F.lit(1 << 24) + F.greatest("blk", "other")).alias("pair"), "blk", "nid", "unit", (F.col("own") > F.shiftright("g", TABLE_SHIFT)).alias("asks")
    )
    parts = parts_for(spark, n * tables, 150_000)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for grp in sorted_groups(batches, ["g", "pair"]):
            if len(grp) < 2:
                continue
            nid = grp["nid"].to_numpy()
            x, asks = np.frombuffer(b"".join(grp["unit"]), dtype=np.float32).reshape(-1, dim), grp["asks"].to_numpy()
            i, j = divmod(int(grp["pair"].iloc[0]), 1 << 24)
            if i == j:
                asking = asks.nonzero()[0]
                for s in range(0, len(asking), 1024):
                    at = asking[s : s + 1024]
                    sim = x[at] @ x.T
                    sim[np.arange(len(at)), at] = -2
                    a, c = _top(sim, k, floor - 1e-5)
                    held.append(_rerank(nid, x, at[a], nid, x, c))
                    size += len(a)
            else:
                left = (grp["blk"] == i).to_numpy()
                xa, xb, na, nb = x[left], x[~left], nid[left], nid[~left]
                if not len(xa) or not len(xb):
                    continue
                fa, fb = asks[left], asks[~left]
                for p, np_, q, nq in ((xa[fa], na[fa], xb, nb), (xb[fb], nb[fb], xa, na)):
                    for s in range(0, len(p), 1024):
                        a, c = _top(p[s : s + 1024] @ q.T, k, floor - 1e-5)
                        held.append(_rerank(np_, p, a + s, nq, q, c))
                        size += len(a)
            if size > 50_000:
                yield _best(held, k, floor)
                held, size = [], 0
        if held:
            yield _best(held, k, floor)

    found = rows.repartition(parts, "g", "pair").sortWithinPartitions("g", "pair").mapInPandas(compare, "q long, r long, sim double")
    per_q = found.groupBy("q").agg(F.collect_set(F.struct((-F.col("sim")).alias("d"), F.col("r").alias("r"))).alias("all"))
    return per_q.select("q", F.explode(F.slice(F.array_sort("all"), 1, k)).alias("x")).select("q", F.col("x.r").alias("r"), (-F.col("x.d")).alias("sim"))


def _rerank(na, xa, a, nb, xb, b):
    """Cosine in double precision, the same number whichever block a pair is met in."""
    return na[a], nb[b], np.round((xa[a].astype(np.float64) * xb[b].astype(np.float64)).sum(1), 9)


def _best(held, k: int, floor: float) -> pd.DataFrame:
    """The k best distinct partners of every query among what one task has met so far."""
    q, r, s = (np.concatenate(x) for x in zip(*held))
    keep = s >= floor
    d = pd.DataFrame({"q": q[keep], "r": r[keep], "sim": s[keep]}).drop_duplicates(["q", "r"])
    d = d.sort_values(["q", "sim", "r"], ascending=[True, False, True], kind="stable")
    return d[d.groupby("q").cumcount() < k]


def similar_pairs(vectors: DataFrame, *, dim: int = 64, k: int = 5, floor: float = 0.8, ef_search: int | None = None) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``: one of the two is among the k most cosine-similar records of the other, at ``floor`` or more.

    Input columns ``id, query_vector, updated_at`` and, if there, ``ef_search``; only the latest row of an id counts,
    and a vector that is null, of another width, all zero or holds a null, NaN or infinite value belongs to no pair.
    The effort of a record is its own ``ef_search``, FULL_EFFORT where that is null, zero or less, or the parameter
    for all if it is told. Records with equal unit vectors are one point of the search, of the greatest effort among
    them: of their members the k+1 smallest ids stand for the point in other records' results, and every member gets
    its own k. Equal similarities go to the smaller id. Empty input gives an empty result; other columns are ignored.
    """
    ef = F.lit(ef_search).cast("int") if ef_search or "ef_search" not in vectors.columns else F.col("ef_search").cast("int")
    v = latest(vectors.select("id", F.struct(F.col("query_vector").alias("v"), ef.alias("ef")).alias("v"), "updated_at"), "id", "v", "updated_at").select("id", "v.v", F.when(F.col("v.ef") > 0, F.col("v.ef")).otherwise(FULL_EFFORT).alias("ef"))
    members = materialize(unit_vectors(v, dim), "p5-units")
    firsts = members.df.groupBy("unit").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size"), F.max("ef").alias("ef"))
    points = materialize(firsts.orderBy("first").select(F.monotonically_increasing_id().alias("nid"), "unit", "first", "size", "ef"), "p5-points")
    near = materialize(nearest(points.df.select("nid", "unit", "ef"), dim=dim, k=k, floor=floor), "p5-near")
    singles = points.df.where("size = 1").select(F.col("nid"), F.col("first").alias("id"))
    many = points.df.where("size > 1").select("nid", "unit")
    copies = members.df.join(many, "unit").select("nid", "id")
    # rank copies of one point without ordering a hot point in one task: k+1 smallest of each of 64 slices, then of all
    first_few = lambda d, by: d.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy("id"))).where(F.col("rn") <= k + 1).drop("rn")
    shown = first_few(first_few(copies.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))), ["nid", "salt"]).drop("salt"), ["nid"])
    standing = singles.unionByName(shown)
    # candidates of a point: the standing members of its neighbours and of itself
    cand = (
        near.df.select(F.col("q").alias("p"), F.col("r").alias("nid"), "sim")
        .unionByName(many.select(F.col("nid").alias("p"), "nid", F.lit(1.0).alias("sim")))
        .join(standing, "nid")
        .groupBy("p").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("d"), F.col("id").alias("id")))).alias("c"))
    )
    own = singles.unionByName(copies).withColumnRenamed("id", "me").withColumnRenamed("nid", "p")
    best = own.join(cand, "p").select("me", F.explode(F.slice(F.expr("filter(c, x -> x.id <> me)"), 1, k)).alias("x"))
    return best.select(F.least("me", "x.id").alias("id_a"), F.greatest("me", "x.id").alias("id_b")).distinct()

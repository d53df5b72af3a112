"""A multi-index over 256-bit codes, kept in segments, and the registry of segment formats.

Every code is split into substrings, and every substring is an entry ``(table, key)`` of the index. Two codes that
differ in at most ``2 * tables - 1`` bits agree in one substring up to one bit (pigeonhole), so looking up the keys
within one bit of a query's substrings finds all codes of that radius. A query whose k-th hit lies within it is
settled: its result is exact. The rest can be scanned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import search as X
from sparkloom.runtime import materialize

BITS = 256


def substring_bits(rows: int) -> int:
    """Bits of a substring: 8, 16 or 32, such that a bucket of a table holds few rows."""
    return 8 if rows < 1 << 12 else 16 if rows < 1 << 26 else 32


def _keys(vector: str, bits: int) -> Column:
    """``array<struct<t, key>>`` of the substrings of a code."""
    step = bits // 8
    number = lambda k: F.conv(F.hex(F.substring(F.col(vector), k * step + 1, step)), 16, 10).cast("long")
    return F.array(*[F.struct(F.lit(k).alias("t"), number(k).alias("key")) for k in range(BITS // bits)])


def build(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """Index entries ``(t, key, id, vector, bits)`` of the rows ``(id, vector)`` with 32 bytes; others have none."""
    d = docs.where(F.octet_length("vector") == BITS // 8).select("id", "vector")
    b = bits or substring_bits(d.count())
    return d.select("id", "vector", F.inline(_keys("vector", b))).select("t", "key", "id", "vector", F.lit(b).alias("bits"))


def probe(index: DataFrame, queries: DataFrame, k: int, *, accept: DataFrame | None = None) -> DataFrame:
    """``(qid, id, score, rank, settled)``: the k best codes the index finds for queries ``(qid, vector)``.

    Hits of an index with an ``accept`` table ``(id)`` are chosen among its ids only. ``settled`` tells that the
    query's hits are its exact k nearest; the others may miss codes beyond the radius.
    """
    first = index.select("bits").first()
    if first is None:
        return X.top_per_query(queries.select("qid", F.lit(None).cast("string").alias("id"), F.lit(0.0).alias("score")).limit(0), k).withColumn("settled", F.lit(True))
    bits, tables = first.bits, BITS // first.bits
    q = queries.where(F.octet_length("vector") == BITS // 8).select("qid", F.col("vector").alias("qv"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(bits)])
    asked = q.select("qid", "qv", F.inline(_keys("qv", bits))).select("qid", "qv", "t", F.explode(F.transform(flips, lambda x: F.col("key").bitwiseXOR(x))).alias("key"))
    met = index.join(accept.select("id").distinct(), "id", "left_semi") if accept is not None else index
    hits = met.drop("bits").join(asked, ["t", "key"]).select("qid", "id", F.round(bit_similarity(F.col("qv"), F.col("vector")), 9).alias("score")).distinct()
    top = X.top_per_query(hits, k)
    sure = top.where((F.col("rank") == k) & (F.col("score") >= 1 - (2 * tables - 1) / BITS - 1e-9)).select("qid", F.lit(True).alias("settled"))
    return top.join(sure, "qid", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))


def bit_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits of two codes of 32 bytes."""
    part = lambda c, k: F.conv(F.hex(F.substring(c, 4 * k + 1, 4)), 16, 10).cast("long")
    far = F.lit(0)
    for k in range(BITS // 32):
        far = far + F.bit_count(part(a, k).bitwiseXOR(part(b, k)))
    return 1 - far / float(BITS)


def nearest(docs: DataFrame, index: DataFrame, queries: DataFrame, k: int, *, accept: DataFrame | None = None) -> DataFrame:
    """``(qid, id, score)``: the exact k nearest, by the index for the queries it settles and by a scan for the rest."""
    found = materialize(probe(index, queries, k, accept=accept), "probe").df
    done = found.where("settled")
    rest = queries.join(done.select("qid").distinct(), "qid", "left_anti")
    pool = docs.join(accept.select("id").distinct(), "id", "left_semi") if accept is not None else docs
    return done.select("qid", "id", "score").unionByName(X.hamming_neighbours(pool, rest, k))


# --- segments -----------------------------------------------------------------------------------
@dataclass
class SegmentFormat:
    """How one kind of segment is built from records and searched: build(docs) -> entries, search(entries, queries, k, accept) -> (qid, id, score)."""

    build: Callable[[DataFrame], DataFrame]
    search: Callable[[DataFrame, DataFrame, int, DataFrame | None], DataFrame]


FORMATS: dict[str, SegmentFormat] = {}


def register_format(name: str, form: SegmentFormat) -> None:
    if name in FORMATS:
        raise ValueError(f"{name} exists")
    FORMATS[name] = form


def _scan(entries: DataFrame, queries: DataFrame, k: int, accept: DataFrame | None) -> DataFrame:
    return X.hamming_neighbours(entries if accept is None else entries.join(accept.select("id").distinct(), "id", "left_semi"), queries, k)


register_format("multi_index", SegmentFormat(build, lambda e, q, k, a: nearest(e.select("id", "vector").distinct(), e, q, k, accept=a)))
register_format("flat", SegmentFormat(lambda d: d.where(F.octet_length("vector") == BITS // 8).select("id", "vector"), _scan))


def segments(docs: DataFrame, of: Column, names: list[str], form: str) -> dict[str, DataFrame]:
    """Segments of a format by name, the records cut by the value of ``of``."""
    return {n: materialize(FORMATS[form].build(docs.where(of == n)), f"segment-{form}").df for n in names}


def fan_out(parts: dict[str, DataFrame], form: str, queries: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """``(qid, id, score, rank, segment)``: every segment is searched among the live ids ``(id, segment)`` it holds, and the best k of all are kept.

    A record that was written again stands in several segments and is live in the last of them only.
    """
    out = None
    for name, entries in sorted(parts.items()):
        h = FORMATS[form].search(entries, queries, k, live.where(F.col("segment") == name)).withColumn("segment", F.lit(name))
        out = h if out is None else out.unionByName(h)
    return X.top_per_query(out, k)

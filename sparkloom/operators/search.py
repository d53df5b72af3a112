"""Hybrid search: field-weighted BM25, Hamming neighbours, rank fusion, boosts and reranking."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.functions.scalars import intent, tokens
from sparkloom.operators.graph import SEARCH_CLAMP, Graph, overlay

# Boost and length normalisation of every field.
FIELDS = {"symbol_name": (2.0, 0.0), "summary": (2.0, 0.75), "keywords": (2.0, 0.0), "description": (1.0, 0.75), "content": (1.0, 0.75)}
K1 = 1.2
RRF_K = 60
# Score changes of the default rerank by intent and kind of file.
SCORE_OPS = {"impl": {"test": -0.15, "doc": -0.05, "impl": 0.02}, "test": {"test": 0.10, "fixture": 0.05, "impl": -0.05}, "unknown": {"test": -0.10}}
MODES = {"hybrid": ("text", "vector"), "text": ("text",), "vector": ("vector",), "similar": ("vector",), "recent": ()}
QUERY_BLOCK = 16_384


def latest_docs(docs: DataFrame) -> DataFrame:
    """Latest version of every record; a null map is empty."""
    w = W.partitionBy("id").orderBy(F.col("updated_at").desc_nulls_last(), F.coalesce(F.hex("vector"), F.lit("")), F.to_json(F.coalesce("fields", F.create_map().cast("map<string,string>"))))
    d = docs.where("id is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return d.withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))


def postings(docs: DataFrame) -> DataFrame:
    """``(id, field, term, tf)`` over the known fields of ``(id, fields)``."""
    t = docs.select("id", F.explode(F.map_entries("fields")).alias("f")).where(F.col("f.key").isin(*FIELDS))
    return t.select("id", F.col("f.key").alias("field"), F.explode(tokens(F.coalesce(F.col("f.value"), F.lit("")))).alias("term")).groupBy("id", "field", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(post: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Number of documents (one row), tokens per field (at most five rows) and documents per term in any field."""
    return docs.agg(F.count(F.lit(1)).alias("all_docs")), post.groupBy("field").agg(F.sum("tf").alias("total")), post.groupBy("term").agg(F.countDistinct("id").alias("n"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode(F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).alias("term"))


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``(qid, id, score)`` of every document with a term of the query ``(qid, text)``.

    The score sums over terms and fields; idf counts documents with the term in any field, the average length
    of a field is over all documents. Terms that no query holds leave the postings before any join.
    """
    post = postings(docs)
    n, fields, df = corpus_stats(post, docs)
    q = query_terms(queries)
    terms = q.select("term").distinct()
    length = post.groupBy("id", "field").agg(F.sum("tf").alias("dl"))
    p = post.join(terms, "term", "left_semi").join(df, "term").join(length, ["id", "field"]).join(F.broadcast(fields), "field").crossJoin(F.broadcast(n))  # five rows and one row
    boost = F.create_map(*[F.lit(x) for f, (b, _) in FIELDS.items() for x in (f, b)])[F.col("field")]
    norm = F.create_map(*[F.lit(x) for f, (_, b) in FIELDS.items() for x in (f, b)])[F.col("field")]
    avg = F.col("total") / F.col("all_docs")
    ratio = F.when(avg > 0, F.col("dl") / avg).otherwise(F.lit(0.0))
    idf = F.log((F.col("all_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5) + 1)
    s = boost * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - norm + norm * ratio))
    per_term = p.groupBy("term", "id").agg(F.sum(s).alias("s"))
    return q.join(per_term, "term").groupBy("qid", "id").agg(F.round(F.sum("s"), 9).alias("score"))


def top_per_query(hits: DataFrame, k: int, *, score: str = "score") -> DataFrame:
    """The k best hits of every query by score, then id, with their rank from 1; combined per slice of ids first."""
    by = [F.desc(score), "id"]
    h = hits.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(16))).withColumn("_r", F.row_number().over(W.partitionBy("qid", "_s").orderBy(*by))).where(F.col("_r") <= k)
    return h.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*by))).where(F.col("rank") <= k).drop("_s", "_r")


def hamming_neighbours(docs: DataFrame, queries: DataFrame, k: int, *, accept: Column | None = None) -> DataFrame:
    """``(qid, id, score)``: exact k nearest 32-byte vectors of every query vector, score 1 - distance/256; vectors of another width are no hits.

    ``accept`` is a predicate on the records: it holds before the k best are chosen. Queries are taken in blocks of
    at most some QUERY_BLOCK that reach every task; each task gives the k best of its rows for each query once.
    """
    d = (docs if accept is None else docs.where(accept)).where(F.octet_length("vector") == 32).select("id", "vector")
    q = queries.where(F.octet_length("vector") == 32).select(F.col("qid").cast("string").alias("qid"), "vector")
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        rows = [(r.qid, bytes(r.vector)) for r in (q if blocks == 1 else q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)).toLocalIterator()]
        h = _scan_block(d, rows, k)
        out = h if out is None else out.unionByName(h)
    return top_per_query(out, k).select("qid", "id", "score")


def _scan_block(docs: DataFrame, rows: list[tuple[str, bytes]], k: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def best(parts: list[pd.DataFrame]) -> pd.DataFrame:
        d = pd.concat(parts, ignore_index=True).sort_values(["q", "far", "id"], kind="stable")
        return d[d.groupby("q").cumcount() < k]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not sent.value:
            return
        qid = np.array([r[0] for r in sent.value], dtype=object)
        qm = _signs([r[1] for r in sent.value])
        held, size = [], 0
        for b in batches:
            if b.empty:
                continue
            ids = b["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, dm = ids[order], _signs([b["vector"].iloc[i] for i in order])
            for s in range(0, len(qm), 1024):
                far = ((256 - qm[s : s + 1024] @ dm.T) / 2).astype(np.int32)
                # the row number breaks ties towards the smaller id
                near = np.argpartition(far * np.int64(len(ids)) + np.arange(len(ids)), min(k, len(ids)) - 1, axis=1)[:, :k]
                q = np.repeat(np.arange(s, s + len(far)), near.shape[1])
                held.append(pd.DataFrame({"q": q, "far": np.take_along_axis(far, near, 1).ravel(), "id": ids[near].ravel()}))
                size += len(q)
            if size > 8 * k * len(qm):
                held = [best(held)]
                size = len(held[0])
        if held:
            d = best(held)
            yield pd.DataFrame({"qid": qid[d["q"].to_numpy()], "id": d["id"], "score": 1 - d["far"] / 256.0})

    return docs.mapInPandas(run, "qid string, id string, score double")


def _signs(v: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(bytes(x) for x in v), dtype=np.uint8).reshape(len(v), -1), axis=1).astype(np.float32) * 2 - 1


def fuse(lists: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists ``(qid, id, rank from 1)``; a single list keeps its scores' order."""
    u = None
    for x in lists:
        y = x.select("qid", "id", (1.0 / (RRF_K + F.col("rank"))).alias("s"))
        u = y if u is None else u.unionByName(y)
    return top_per_query(u.groupBy("qid", "id").agg(F.round(F.sum("s"), 9).alias("score")), k)


def arms(mode: str, vector_requested: bool = False) -> tuple[str, ...]:
    """Arms of a mode; a vector with the text mode is refused."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {sorted(MODES)}")
    if mode == "text" and vector_requested:
        raise ValueError("mode 'text' takes no vector")
    return MODES[mode]


def search(docs: DataFrame, queries: DataFrame, *, mode: str = "hybrid", k: int = 10) -> DataFrame:
    """``(qid, id, score, rank)`` of queries ``(qid, text, vector)`` by the arms of the mode; k is clamped."""
    k = min(k, SEARCH_CLAMP)
    lists = []
    if "text" in arms(mode):
        lists.append(top_per_query(bm25(docs, queries), k))
    if "vector" in arms(mode):
        lists.append(top_per_query(hamming_neighbours(docs, queries, k), k))
    return lists[0] if len(lists) == 1 else fuse(lists, k)


def overlay_search(base: DataFrame, over: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Text hits of an overlay and of the records it does not shadow, each pool with its own statistics, by score."""
    b = bm25(base, queries).join(over.select("id").distinct(), "id", "left_anti")
    return top_per_query(bm25(over, queries).unionByName(b.select("qid", "id", "score")), k)


def similar(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Nearest records of stored records, themselves left out."""
    q = docs.join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("qid"), "vector")
    return top_per_query(hamming_neighbours(docs, q, k + 1).where("qid <> id"), k)


def file_kind() -> Column:
    p = F.lower("file_path")
    return F.when(p.rlike(r"(^|/)(testdata|fixtures?)/"), F.lit("fixture")).when(p.rlike(r"(_test\.|\.test\.|\.spec\.|(^|/)tests?/)"), F.lit("test")).when(p.rlike(r"\.(md|rst|txt|adoc)$"), F.lit("doc")).otherwise(F.lit("impl"))


def score_ops(hits: DataFrame, queries: DataFrame, g: Graph, ops: dict[str, dict[str, float]] = SCORE_OPS) -> DataFrame:
    """Adds the change for (intent of the query, kind of the hit's file) to the scores; records that are no node keep theirs."""
    q = queries.select("qid", intent(F.coalesce("text", F.lit(""))).alias("intent"))
    d = hits.join(q, "qid").join(g.live.select("id", "file_path"), "id", "left").withColumn("kind", F.when(F.coalesce("file_path", F.lit("")) != "", file_kind()).otherwise(F.lit("")))
    delta = F.lit(0.0)
    for i, kinds in ops.items():
        for kind, w in kinds.items():
            delta = F.when((F.col("intent") == i) & (F.col("kind") == kind), F.lit(w)).otherwise(delta)
    return d.select("qid", "id", F.round(F.col("score") + delta, 9).alias("score"))


RERANK_FIELDS = "symbol_name summary keywords description content file_path language type signature source status".split()


def rerank_predicate(p: dict, query: Column | None = None) -> Column:
    """Predicate over the fields of a hit: regex, prefix, suffix, contains, equals, in, tokens_match; any, all, not; ``negate``; ``$query`` is the query."""
    if "all" in p or "any" in p:
        cs = [rerank_predicate(x, query) for x in p.get("all", p.get("any"))]
        r = cs[0]
        for c in cs[1:]:
            r = r & c if "all" in p else r | c
    elif "not" in p:
        r = ~rerank_predicate(p["not"], query)
    else:
        f = p["field"]
        if f not in RERANK_FIELDS and not f.startswith("metadata."):
            raise ValueError(f"unknown field {f!r}")
        c = F.coalesce(F.col("metadata")[f[9:]] if f.startswith("metadata.") else F.col(f), F.lit(""))
        v = query if p.get("value") == "$query" and query is not None else F.lit(p.get("value"))
        op = p["op"]
        r = {"regex": lambda: F.regexp_like(c, v), "prefix": lambda: c.startswith(v), "suffix": lambda: c.endswith(v), "contains": lambda: c.contains(v), "equals": lambda: c == v,
             "in": lambda: c.isin(*p["values"]), "tokens_match": lambda: F.arrays_overlap(tokens(c), tokens(v))}[op]()
    return ~r if p.get("negate") else r


def topology_hints(g: Graph) -> DataFrame:
    """A phrase on the role of a node by its callers and callees."""
    e = g.edges.where("type = 'CALLS' and from_id <> to_id")
    i = e.groupBy(F.col("to_id").alias("id")).agg(F.countDistinct("from_id").alias("i"))
    o = e.groupBy(F.col("from_id").alias("id")).agg(F.countDistinct("to_id").alias("o"))
    d = i.join(o, "id", "full").select("id", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("o", F.lit(0)).alias("o")).join(g.live.select("id"), "id", "left_semi")
    role = F.when((F.col("i") >= 5) & (F.col("o") <= 1), "utility").when((F.col("i") == 0) & (F.col("o") >= 3), "entry point").when((F.col("i") >= 5) & (F.col("o") >= 5), "hub").otherwise("member")
    return d.select("id", F.format_string("%s: called by %d, calls %d", role, "i", "o").alias("hint"))


def parent_headings(hits: DataFrame, g: Graph, edge: str) -> DataFrame:
    """Hits with the heading of the node that contains them (smallest id), or an empty text."""
    p = g.edges.where(F.col("type") == edge).select(F.col("to_id").alias("id"), "from_id").groupBy("id").agg(F.min("from_id").alias("parent"))
    n = g.live.select(F.col("id").alias("parent"), F.when(F.col("symbol_name") != "", F.col("symbol_name")).otherwise(F.col("file_path")).alias("heading"))
    return hits.join(p, "id", "left").join(n, "parent", "left").withColumn("heading", F.coalesce("heading", F.lit("")))


def hash_embedding(text: str) -> bytes:
    """A deterministic 256-bit vector of a text: the majority sign of its tokens' hash bits."""
    acc = np.zeros(256, dtype=np.int64)
    for w in text.lower().split():
        acc += np.unpackbits(np.frombuffer(hashlib.sha256(w.encode()).digest(), dtype=np.uint8)).astype(np.int64) * 2 - 1
    return np.packbits(acc > 0).tobytes()


def embed(queries: DataFrame, fn=hash_embedding) -> DataFrame:
    """Adds ``vector`` to queries by any function of a text, in Arrow batches."""

    @F.pandas_udf("binary")
    def run(t: pd.Series) -> pd.Series:
        return t.fillna("").map(fn)

    return queries.withColumn("vector", run("text"))


def lexical_rerank(hits: DataFrame, queries: DataFrame, texts: DataFrame, keep: int = 1000) -> DataFrame:
    """Stand-in for an external reranker over at most ``keep`` candidates: share of query tokens in the text, then the old score."""
    d = top_per_query(hits, keep).drop("rank").join(queries.select("qid", "text"), "qid").join(texts.select("id", F.col("text").alias("body")), "id", "left")
    q = F.array_distinct(tokens(F.coalesce("text", F.lit(""))))
    s = F.size(F.array_intersect(q, tokens(F.coalesce("body", F.lit(""))))) / F.greatest(F.size(q), F.lit(1))
    return d.select("qid", "id", F.round(s + F.col("score") * 1e-3, 9).alias("score"))


def merge_queries(a: DataFrame, b: DataFrame) -> DataFrame:
    """Texts of two batches, each once, with the first place it had."""
    u = a.select("text", F.lit(0).alias("batch"), "pos").unionByName(b.select("text", F.lit(1).alias("batch"), "pos"))
    return u.groupBy("text").agg(F.min(F.struct("batch", "pos")).alias("first")).select("text", "first.batch", "first.pos")


__all__ = [n for n in dir() if not n.startswith("_")] + ["overlay"]


def densify(vectors: DataFrame, key: str, *, k: int = 3, floor: float = 0.7, budget: int = 10_000, block: int = 2048) -> DataFrame:
    """``(key, a, b, score)``, a < b: the k nearest records of every record inside its group at a bit similarity of ``floor`` or more, at most ``budget`` links by score.

    Groups are cut into blocks and compared block by block: no group is one task, and only the k best of a row leave it.
    """
    v = vectors.where(F.octet_length("vector") == 32).select(key, "id", "vector")
    n = v.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cuts"))
    d = v.join(n, key).withColumn("blk", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    d = d.select(key, F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"), "blk", "id", "vector")

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, x, b = pdf["id"].to_numpy(), _signs(list(pdf["vector"])), pdf["blk"].to_numpy()
        s = 1 - (256 - x @ x.T) / 512
        np.fill_diagonal(s, -1)
        if pdf["p"].iloc[0] != pdf["q"].iloc[0]:
            s[b[:, None] == b[None, :]] = -1
        o = np.argsort(-s, axis=1, kind="stable")[:, :k]
        sc = np.take_along_axis(s, o, 1)
        i, j = np.nonzero(sc >= floor)
        return pd.DataFrame({"g": pdf[key].iloc[0], "qid": ids[i], "id": ids[o[i, j]], "score": sc[i, j]})

    h = d.groupBy(key, "p", "q").applyInPandas(near, "g string, qid string, id string, score double")
    best = top_per_query(h, k)
    u = best.select(F.col("g").alias(key), F.least("qid", "id").alias("a"), F.greatest("qid", "id").alias("b"), "score").distinct()
    return u.orderBy(F.desc("score"), "a", "b").limit(budget)


def checks_search(docs: DataFrame, checks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(qid, id, rank)``: text hits among the records that are checks ``(id)`` only, with the statistics of these."""
    return top_per_query(bm25(docs.join(checks.select("id").distinct(), "id", "left_semi"), queries), k).select("qid", "id", "rank")


def search_destinations(pools: dict[str, DataFrame], queries: DataFrame, k: int) -> DataFrame:
    """Text hits of several stores or repositories, each with its own statistics, in one list by score; ``store`` names where a hit is from."""
    out = None
    for name, docs in sorted(pools.items()):
        h = bm25(docs, queries).withColumn("store", F.lit(name))
        out = h if out is None else out.unionByName(h)
    return top_per_query(out, k)

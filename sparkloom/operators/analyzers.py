"""Graph analyzers over ``(src, dst, weight)`` edges, and their registry."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scalars import severity
from sparkloom.operators import graph as G
from sparkloom.runtime import Materialized, materialize

DAMPING, PR_TOL, PR_ITER = 0.85, 1e-6, 200
HITS_TOL, HITS_ITER = 1e-8, 200
#: After so many rounds of HITS, more than so many left by their rate mean that leading vectors are sought in at most so many steps.
HITS_PLAIN, HITS_LEFT, HITS_STEPS = 8, 60, 1000
#: Tables of up to this many parts of a graph are broadcast.
MAX_PARTS = 100_000
TOP = 20
MIN_COMMUNITY, GAMMA, LEIDEN_ITER = 5, 0.5, 100
EXACT_BETWEENNESS, SAMPLES, MAX_SAMPLES = 5000, 100, 200
#: An adjacency of up to this many edges (16 bytes each) is sent to every task; beyond it betweenness is refused.
MAX_ADJACENCY = 20_000_000
#: Sequential analyzers take one connected component per task, of up to this many edges; beyond it they are refused.
MAX_COMPONENT = 5_000_000
CYCLE_SCC = 40
#: Links that one task finishes by itself.
SMALL_GRAPH = 200_000

REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def analyzer(name: str):
    """Registers a function (nodes, edges, **knobs) -> DataFrame as an analyzer."""

    def reg(fn):
        if name in REGISTRY:
            raise ValueError(f"{name} exists")
        REGISTRY[name] = fn
        return fn

    return reg


def run(name: str, nodes: DataFrame, edges: DataFrame, **knobs) -> DataFrame:
    if name not in REGISTRY:
        raise ValueError(f"unknown analyzer {name!r}; one of {sorted(REGISTRY)}")
    return REGISTRY[name](nodes, edges, **knobs)


class _State:
    """The table of an iteration, written to the shared folder every round: its plan never grows with the rounds."""

    def __init__(self, df: DataFrame):
        self.m = materialize(df, "state")

    @property
    def df(self) -> DataFrame:
        return self.m.df

    def next(self, df: DataFrame) -> None:
        old, self.m = self.m, materialize(df, "state")
        old.drop()


@analyzer("pagerank")
def pagerank(nodes: DataFrame, edges: DataFrame, *, weighted: bool = False, damping: float = DAMPING, tol: float = PR_TOL, max_iter: int = PR_ITER, rounds: int | None = None) -> DataFrame:
    """``(id, score)``: rank flows along edges (by weight if asked), nodes without outgoing weight spread theirs evenly.

    Runs until the ranks move by less than ``tol`` and raises if they have not after ``max_iter`` rounds; ``rounds`` asks for so many instead.
    """
    ids = nodes.select("id").distinct()
    n = ids.count()
    if not n:
        return ids.withColumn("score", F.lit(0.0))
    w = F.col("weight") if weighted else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w")).where("w > 0")
    out = e.groupBy("src").agg(F.sum("w").alias("t"))
    e = materialize(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p")), "pagerank").df
    dangling = ids.join(out.select(F.col("src").alias("id")), "id", "left_anti").withColumn("dangling", F.lit(True))
    st = _State(ids.join(dangling, "id", "left").select("id", F.lit(1.0 / n).alias("r"), F.coalesce("dangling", F.lit(False)).alias("dangling"), F.lit(0.0).alias("d")))
    lost = st.df.where("dangling").agg(F.sum("r")).first()[0] or 0.0
    for k in range(1, (rounds or max_iter) + 1):
        x = e.join(st.df.select(F.col("id").alias("src"), "r"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("r")).alias("s"))
        new = (1 - damping) / n + damping * (F.coalesce("s", F.lit(0.0)) + lost / n)
        st.next(st.df.join(x, "id", "left").select("id", new.alias("r"), "dangling", (new - F.col("r")).alias("d")))
        a = st.df.agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("d"), F.sum(F.when(F.col("dangling"), F.col("r"))).alias("l")).first()
        lost = a.l or 0.0
        if (a.d < tol and not rounds) or k == rounds:
            return st.df.select("id", F.col("r").alias("score"))
    raise RuntimeError(f"pagerank did not settle in {max_iter} rounds")


@analyzer("pagerank_weighted")
def pagerank_weighted(nodes: DataFrame, edges: DataFrame, **knobs) -> DataFrame:
    return pagerank(nodes, edges, weighted=True, **knobs)


@analyzer("hits")
def hits(nodes: DataFrame, edges: DataFrame, *, tol: float = HITS_TOL, max_iter: int = HITS_ITER, rounds: int | None = None) -> DataFrame:
    """``(id, hub, authority)``: authorities from hubs, then hubs from the new authorities, each of length 1; no edges give zeros.

    Where the rounds so far tell that parts of the graph with nearly equal weight would keep it from settling, the hubs
    that the rounds tend to come from :func:`_leading_hubs`, and rounds go on from there until they settle. Raises if
    they do not; ``rounds`` asks for so many plain ones instead.
    """
    ids = nodes.select("id").distinct()
    e = materialize(edges.select("src", "dst").distinct(), "hits").df
    if e.isEmpty():
        return ids.select("id", F.lit(0.0).alias("hub"), F.lit(0.0).alias("authority"))
    n = ids.count()
    st = _State(ids.select("id", F.lit(n**-0.5).alias("h"), F.lit(n**-0.5).alias("a")))
    before, led = 0.0, bool(rounds)
    for k in range(1, (rounds or max_iter) + 1):
        am = materialize(e.join(st.df.select(F.col("id").alias("src"), "h"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("h").alias("na")), "hits-a")
        a = am.df
        la = a.agg(F.sqrt(F.sum(F.col("na") * F.col("na")))).first()[0] or 1.0
        hm = materialize(e.join(a.select(F.col("id").alias("dst"), F.col("na")), "dst").groupBy(F.col("src").alias("id")).agg((F.sum("na") / la).alias("nh")), "hits-h")
        h = hm.df
        lh = h.agg(F.sqrt(F.sum(F.col("nh") * F.col("nh")))).first()[0] or 1.0
        z = F.lit(0.0)
        na, nh = F.coalesce(F.col("na") / la, z), F.coalesce(F.col("nh") / lh, z)
        st.next(st.df.select("id", F.col("h").alias("h0"), F.col("a").alias("a0")).join(a, "id", "left").join(h, "id", "left").select("id", nh.alias("h"), na.alias("a"), (nh - F.col("h0")).alias("dh"), (na - F.col("a0")).alias("da")))
        am.drop()
        hm.drop()
        d = st.df.agg(F.sqrt(F.sum(F.col("dh") * F.col("dh"))).alias("h"), F.sqrt(F.sum(F.col("da") * F.col("da"))).alias("a")).first()
        if (d.h < tol and d.a < tol and not rounds) or k == rounds:
            return st.df.select("id", F.col("h").alias("hub"), F.col("a").alias("authority"))
        now = max(d.h, d.a)
        if not led and k >= HITS_PLAIN and (now >= before or math.log(tol / now) / math.log(now / before) > HITS_LEFT):
            led = True
            x = _leading_hubs(ids, e, st.df.select("id", "h"), tol)
            st.next(ids.join(x, "id", "left").select("id", F.coalesce("h", z).alias("h"), z.alias("a")))
        before = now
    raise RuntimeError(f"hits did not settle in {max_iter} rounds")


def _leading_hubs(ids: DataFrame, edges: DataFrame, start: DataFrame, tol: float) -> DataFrame:
    """``(id, h)``: the hubs that rounds from equal ones tend to, for a start ``(id, h)`` out of these rounds.

    Hubs that share authorities, directly or by others, make a part; the rounds keep parts apart and weigh each by its
    leading eigenvalue, so only parts of the greatest one remain. In every part at once the leading vector is sought by
    locally optimal conjugate gradients: the best of the span of the vector, its residual and the step before. A part
    is left out where it has too few edges, or its greatest ratio of a positive vector's image to it is too small, for
    the greatest eigenvalue. Equal within ``tol`` counts as equal.
    """
    e = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    m = materialize(components(e.select(F.concat(F.lit(">"), "src").alias("id")).distinct(), e.select(F.concat(F.lit(">"), "src").alias("src"), F.concat(F.lit("<"), "dst").alias("dst"))).select(F.substr("id", F.lit(2)).alias("id"), "comp"), "hits-parts")
    hubs = m.df.join(start, "id").select("id", "comp", "h")
    old = materialize(e.join(hubs.select(F.col("id").alias("src"), "comp", "h"), "src").select("src", "dst", "comp", "h"), "hits-e")
    x = old.df.groupBy("dst").agg(F.sum("h").alias("a")).agg(F.sum(F.col("a") * F.col("a"))).first()[0] / hubs.agg(F.sum(F.col("h") * F.col("h"))).first()[0]  # no more than the greatest eigenvalue
    parts = materialize(old.df.groupBy("comp").agg(F.count(F.lit(1)).cast("double").alias("ub")).where(F.col("ub") >= x * (1 - tol)), "hits-c")
    few = parts.df.count() <= MAX_PARTS
    with_parts = lambda t, c: t.join(F.broadcast(c) if few else c, "comp")
    em = materialize(with_parts(old.df, parts.df).select("src", "dst"), "hits-e")
    old.drop()

    def image(t: DataFrame, c: str) -> DataFrame:
        a = em.df.join(t.select(F.col("id").alias("src"), F.col(c).alias("v")), "src").groupBy("dst").agg(F.sum("v").alias("a"))
        return em.df.join(a, "dst").groupBy(F.col("src").alias("id")).agg(F.sum("a").alias("m" + c))

    dot = lambda a, b: F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}")
    gram = [dot(a, b) for k, a in enumerate("xrp") for b in "xrp"[k:]] + [dot(a, "m" + b) for k, a in enumerate("xrp") for b in "xrp"[k:]]
    o = F.lit(0.0)
    s = with_parts(hubs, parts.df).select("id", "comp", "ub", F.col("h").alias("x"))
    t = materialize(s.join(image(s, "x"), "id").select("id", "comp", "ub", "x", "mx", *(o.alias(c) for c in ("r", "mr", "p", "mp"))), "hits-t")
    m.drop()
    for k in range(HITS_STEPS):
        bound = F.least(F.min("ub"), F.when(F.min("x") > 0, F.max(F.col("mx") / F.col("x"))))  # Collatz and Wielandt
        c = materialize(t.df.groupBy("comp").agg(bound.alias("ub"), *gram).mapInPandas(_best_of_span, "comp string, ub double, cx double, cr double, cp double, theta double, off double"), "hits-c")
        step = lambda v: F.col("cr") * F.col(v + "r") + F.col("cp") * F.col(v + "p")
        s = with_parts(t.df.drop("ub"), c.df).select("id", "comp", "ub", "theta", (F.col("cx") * F.col("x") + step("")).alias("x"), (F.col("cx") * F.col("mx") + step("m")).alias("mx"), step("").alias("p"), step("m").alias("mp"))
        g = c.df.agg(F.max("theta").alias("top"), F.max(F.when(F.col("off") > tol / 100, F.col("ub"))).alias("open")).first()
        if k and (g.open is None or g.open < g.top * (1 - tol)):
            s = s.where(F.col("theta") >= g.top * (1 - tol))
            w = s.groupBy("comp").agg(F.sum("x").alias("w"))
            return materialize(with_parts(s, w).select("id", (F.col("x") * F.col("w")).alias("h")), "hits-x").df
        s = s.withColumn("r", F.col("mx") - F.col("theta") * F.col("x"))
        nt = materialize(s.join(image(s, "r"), "id").select("id", "comp", "ub", "x", "mx", "r", "mr", "p", "mp"), "hits-t")
        for y in (t, parts):
            y.drop()
        t, parts = nt, c
    raise RuntimeError(f"the leading hubs did not settle in {HITS_STEPS} steps")


def _best_of_span(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The combination of x, r and p with the greatest Rayleigh quotient, for rows of their inner products; off is the length of r against x's eigenvalue."""
    for b in batches:
        g, h = np.empty((len(b), 3, 3)), np.empty((len(b), 3, 3))
        for k, a in enumerate("xrp"):
            for n, c in enumerate("xrp"[k:], k):
                g[:, k, n] = g[:, n, k] = b[f"{a}_{c}"]
                h[:, k, n] = h[:, n, k] = b[f"{a}_m{c}"]
        size = np.sqrt(np.einsum("ikk->ik", g))
        inv = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)
        both = inv[:, :, None] * inv[:, None, :]
        s, u = np.linalg.eigh(g * both)
        w = u * np.where(s > 1e-10, 1 / np.sqrt(np.maximum(s, 1e-10)), 0.0)[:, None, :]
        theta, y = np.linalg.eigh(w.transpose(0, 2, 1) @ (h * both) @ w)
        coef = np.einsum("ikn,in->ik", w, y[:, :, -1]) * inv
        off = size[:, 1] * size[:, 0] / np.maximum(h[:, 0, 0], 1e-300)
        yield pd.DataFrame({"comp": b["comp"], "ub": b["ub"], "cx": coef[:, 0], "cr": coef[:, 1], "cp": coef[:, 2], "theta": theta[:, -1], "off": off})


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, comp)`` of the undirected view by least labels and pointer jumping, rounds written to the shared folder; single nodes are their own."""
    e = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).where("u <> v").distinct()
    lab = materialize(nodes.select("id", F.col("id").alias("comp")).distinct(), "comp")
    cur = materialize(e, "comp-e")
    while not cur.df.isEmpty():
        p = cur.df.select(F.col("v").alias("id"), F.col("u").alias("to")).unionByName(cur.df.select(F.col("u").alias("id"), F.col("u").alias("to"))).groupBy("id").agg(F.min("to").alias("to"))
        p = materialize(p, "comp-p")
        for _ in range(2):
            q = materialize(p.df.join(p.df.select(F.col("id").alias("to"), F.col("to").alias("up")), "to", "left").select("id", F.coalesce("up", "to").alias("to")), "comp-p")
            p.drop()
            p = q
        nl = materialize(lab.df.join(p.df.select(F.col("id").alias("comp"), "to"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "comp")
        m = p.df
        ne = cur.df.join(m.select(F.col("id").alias("u"), F.col("to").alias("a")), "u").join(m.select(F.col("id").alias("v"), F.col("to").alias("b")), "v")
        ne = materialize(ne.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "comp-e")
        for o in (lab, cur, p):
            o.drop()
        lab, cur = nl, ne
    return lab.df


def _per_component(nodes: DataFrame, edges: DataFrame, fn, schema: str) -> DataFrame:
    """Runs a sequential function on the edges of every connected component; larger ones than MAX_COMPONENT are refused, not cut."""
    c = components(nodes, edges)
    e = materialize(edges.join(c.withColumnRenamed("id", "src"), "src"), "comp-edges").df
    big = e.groupBy("comp").count().where(F.col("count") > MAX_COMPONENT).first()
    if big:
        raise ValueError(f"component {big.comp} has {big['count']} edges; sequential analyzers take {MAX_COMPONENT}")
    return e.groupBy("comp").applyInPandas(fn, schema)


def _adjacency(pdf: pd.DataFrame, undirected: bool) -> tuple[np.ndarray, list[list[int]]]:
    ids = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]))
    a, b = np.searchsorted(ids, pdf["src"].to_numpy()), np.searchsorted(ids, pdf["dst"].to_numpy())
    out: list[set[int]] = [set() for _ in ids]
    for x, y in zip(a, b):
        if x != y:
            out[x].add(int(y))
            if undirected:
                out[y].add(int(x))
    return ids, [sorted(s) for s in out]


@analyzer("articulation")
def articulation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, blast)``: nodes whose removal parts their component, and how many nodes it cuts off from the largest rest."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, adj = _adjacency(pdf, True)
        n = len(ids)
        order, low, par, size = [-1] * n, [0] * n, [-1] * n, [1] * n
        cut: dict[int, list[int]] = {}
        t = 0
        for root in range(n):
            if order[root] >= 0:
                continue
            stack, kids = [(root, iter(adj[root]))], 0
            order[root] = low[root] = t
            t += 1
            while stack:
                v, it = stack[-1]
                for w in it:
                    if order[w] < 0:
                        par[w] = v
                        order[w] = low[w] = t
                        t += 1
                        stack.append((w, iter(adj[w])))
                        break
                    if w != par[v]:
                        low[v] = min(low[v], order[w])
                else:
                    stack.pop()
                    p = par[v]
                    if p >= 0:
                        low[p] = min(low[p], low[v])
                        size[p] += size[v]
                        if p == root:
                            kids += 1
                            cut.setdefault(root, []).append(size[v])
                        elif low[v] >= order[p]:
                            cut.setdefault(p, []).append(size[v])
            if kids < 2:
                cut.pop(root, None)
        rows = []
        for v, parts in cut.items():
            rest = n - 1 - sum(parts)
            largest = max([*parts, rest])
            rows.append((ids[v], n - 1 - largest))
        return pd.DataFrame(rows, columns=["id", "blast"])

    return _per_component(nodes, edges, solve, "id string, blast long")


@analyzer("community")
def community(nodes: DataFrame, edges: DataFrame, *, gamma: float = GAMMA, max_iter: int = LEIDEN_ITER, least: int = MIN_COMMUNITY) -> DataFrame:
    """``(id, community, size)`` by local moves of the constant Potts model and splitting communities that fell apart.

    Nodes move in the order of their ids; ties keep the first community met. A community is named by its
    smallest member; those below ``least`` members are not reported.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, adj = _adjacency(pdf, True)
        n = len(ids)
        comm, size = list(range(n)), [1] * n
        for _ in range(max_iter):
            moved = False
            for v in range(n):
                links: dict[int, int] = {}
                for w in adj[v]:
                    links[comm[w]] = links.get(comm[w], 0) + 1
                cur = comm[v]
                stay = links.get(cur, 0) - gamma * (size[cur] - 1)
                best, gain = cur, 0.0
                for c, k in links.items():
                    if c != cur and (k - gamma * size[c]) - stay > gain + 1e-12:
                        best, gain = c, (k - gamma * size[c]) - stay
                if best != cur:
                    size[cur] -= 1
                    size[best] += 1
                    comm[v] = best
                    moved = True
            if not moved:
                break
            seen, fresh = [False] * n, [0] * n  # every connected part becomes a community of its own
            for v in range(n):
                if seen[v]:
                    continue
                part, todo = [], [v]
                seen[v] = True
                while todo:
                    x = todo.pop()
                    part.append(x)
                    for w in adj[x]:
                        if not seen[w] and comm[w] == comm[x]:
                            seen[w] = True
                            todo.append(w)
                for x in part:
                    fresh[x] = v
            comm = fresh
            size = [0] * n
            for c in comm:
                size[c] += 1
        out = pd.DataFrame({"id": ids, "c": comm})
        out["community"] = out.groupby("c")["id"].transform("min")
        out["size"] = out.groupby("c")["id"].transform("size")
        return out[out["size"] >= least][["id", "community", "size"]]

    return _per_component(nodes, edges, solve, "id string, community string, size long")


def touched_communities(old: DataFrame, nodes: DataFrame, edges: DataFrame, changes: DataFrame, **knobs) -> DataFrame:
    """Communities after edge changes ``(a, b)``: components with a changed end are solved again, others keep theirs."""
    c = components(nodes, edges)
    ends = changes.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    hot = c.join(ends, "id", "left_semi").select("comp").distinct()
    ids = c.join(hot, "comp", "left_semi").select("id")
    new = community(nodes.join(ids, "id", "left_semi"), edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi"), **knobs)
    return old.join(ids, "id", "left_anti").select("id", "community", "size").unionByName(new)


@analyzer("betweenness")
def betweenness(nodes: DataFrame, edges: DataFrame, *, samples: int | None = None, exact: bool | None = None) -> DataFrame:
    """``(id, score)``: unscaled directed shortest-path betweenness; exact if asked, or if not told below EXACT_BETWEENNESS nodes, else from k sampled sources times n/k.

    The k sources are drawn from all n nodes, with or without an edge; k is n/50 between SAMPLES and MAX_SAMPLES
    unless given. If no more than k nodes have an edge, all of these are sources and the scores are exact.
    Sources are the work list; the adjacency goes to every task behind a check of its size.
    """
    spark = nodes.sparkSession
    m = edges.count()
    if m > MAX_ADJACENCY:
        raise ValueError(f"{m} edges; betweenness takes {MAX_ADJACENCY}")
    pdf = edges.select("src", "dst").distinct().toPandas()
    ids, adj = _adjacency(pdf, False) if len(pdf) else (np.array([], dtype=object), [])
    n = nodes.select("id").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("id"))).distinct().count()
    samples = samples or min(MAX_SAMPLES, max(SAMPLES, n // 50))
    sources = np.arange(len(ids))
    scale = 1.0
    if exact is None:
        exact = n < EXACT_BETWEENNESS
    if not exact and len(ids) > samples:
        # numbers from len(ids) on stand for nodes without an edge: they count as drawn and add nothing
        drawn = np.sort(np.random.default_rng(0).permutation(n)[:samples])
        sources = drawn[drawn < len(ids)]
        scale = n / samples
    b = spark.sparkContext.broadcast(adj)

    def brandes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = b.value
        acc = np.zeros(len(g))
        for batch in batches:
            for s in batch["s"]:
                sigma, dist, preds, order = {int(s): 1.0}, {int(s): 0}, {}, [int(s)]
                for v in order:
                    for w in g[v]:
                        if w not in dist:
                            dist[w] = dist[v] + 1
                            sigma[w] = 0.0
                            order.append(w)
                        if dist[w] == dist[v] + 1:
                            sigma[w] += sigma[v]
                            preds.setdefault(w, []).append(v)
                delta = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in preds.get(w, ()):
                        delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
                    if w != s:
                        acc[w] += delta[w]
        k = acc.nonzero()[0]
        yield pd.DataFrame({"i": k, "s": acc[k]})

    work = spark.createDataFrame(pd.DataFrame({"s": sources.astype("int64")}), "s long") if len(sources) else spark.createDataFrame([], "s long")
    part = work.repartition(spark.sparkContext.defaultParallelism).mapInPandas(brandes, "i long, s double")
    names = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(ids)), "id": ids}), "i long, id string") if len(ids) else spark.createDataFrame([], "i long, id string")
    s = part.groupBy("i").agg((F.sum("s") * scale).alias("score")).join(names, "i").select("id", "score")
    return nodes.select("id").distinct().join(s, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def reach(seeds: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """``(seed, id, distance)`` by levels from every seed along ``(a, b)``; every level writes only what is new."""
    levels = [materialize(seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("distance", F.lit(0)), "reach")]

    def seen() -> DataFrame:
        out = levels[0].df
        for x in levels[1:]:
            out = out.unionByName(x.df)
        return out

    for k in range(1, depth + 1):
        f = levels[-1].df.select("seed", F.col("id").alias("a"))
        nxt = f.join(pairs, "a").select("seed", F.col("b").alias("id")).distinct().join(seen().select("seed", "id"), ["seed", "id"], "left_anti")
        new = materialize(nxt.withColumn("distance", F.lit(k)), "reach")
        if new.df.isEmpty():
            new.drop()
            break
        levels.append(new)
    return seen()


#: Redundancy factor by resource type: builders of a column over ``replicas`` (text as a number, 0 if none).
REDUNDANCY: dict[str, Callable[[Column], Column]] = {
    "deployment": lambda n: F.when(n > 1, 1 / n).otherwise(F.lit(1.0)),
    "replica_set": lambda n: F.when(n > 1, 1 / n).otherwise(F.lit(1.0)),
    "stateful_set": lambda n: F.when(n > 1, 1 / n).otherwise(F.lit(1.0)),
}


def register_redundancy(kind: str, rule: Callable[[Column], Column]) -> None:
    if kind in REDUNDANCY:
        raise ValueError(f"{kind} exists")
    REDUNDANCY[kind] = rule


@analyzer("blast_radius")
def blast_radius(nodes: DataFrame, edges: DataFrame, *, seeds: DataFrame, depth: int = 10) -> DataFrame:
    """``(seed, impacted, score)``: nodes that depend on a seed, each at its least depth d with factor/d; the factor is 1 or its redundancy rule's within [0.05, 1]."""
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b")).distinct()
    r = reach(seeds, back, depth).where("distance > 0")
    if "metadata" in nodes.columns:
        from sparkloom.functions.scalars import finite, meta

        k, n = meta("resource_type"), F.coalesce(finite(meta("replicas")), F.lit(0.0))
        f = F.lit(1.0)
        for kind, rule in REDUNDANCY.items():
            f = F.when(k == kind, rule(n)).otherwise(f)
        r = r.join(nodes.select("id", F.when(F.isnan(f), F.lit(0.05)).otherwise(F.least(F.greatest(f, F.lit(0.05)), F.lit(1.0))).alias("f")), "id")
    else:
        r = r.withColumn("f", F.lit(1.0))
    return r.groupBy("seed").agg(F.count(F.lit(1)).alias("impacted"), F.sum(F.col("f") / F.col("distance")).alias("score"))


def _strong_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(id, c)``: strong components of the links of one task, by Tarjan's algorithm without recursion; c is any member."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    ids, adj = _adjacency(pd.concat(held), False)
    n = len(ids)
    number, low, on, comp, stack, count = [-1] * n, [0] * n, [False] * n, [-1] * n, [], 0
    for root in range(n):
        if number[root] >= 0:
            continue
        todo = [(root, 0)]
        while todo:
            v, k = todo.pop()
            if k == 0:
                number[v] = low[v] = count
                count += 1
                stack.append(v)
                on[v] = True
            down = False
            for j in range(k, len(adj[v])):
                w = adj[v][j]
                if number[w] < 0:
                    todo += [(v, j + 1), (w, 0)]
                    down = True
                    break
                if on[w]:
                    low[v] = min(low[v], number[w])
            if down:
                continue
            if low[v] == number[v]:
                while True:
                    w = stack.pop()
                    on[w] = False
                    comp[w] = v
                    if w == v:
                        break
            if todo:
                up = todo[-1][0]
                low[up] = min(low[up], low[v])
    yield pd.DataFrame({"id": ids, "c": ids[comp]})


@analyzer("scc")
def scc(nodes: DataFrame, edges: DataFrame, *, least: int = 2) -> DataFrame:
    """``(id, scc, size)`` of strongly connected components of ``least`` nodes or more, named by their smallest member.

    Forward-backward colouring: nodes without a way in or out are trimmed; every node takes the greatest id
    that reaches it; what a colour's own node is reached back from within the colour is a component. A node takes
    its colour's colour once a round (a pointer jump), so colours cross long chains in few rounds. Once at most SMALL_GRAPH links are left, one task finishes them.
    """
    e = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "scc-e")
    left = e.df.count()
    found: list[DataFrame] = []
    while left:
        if left <= SMALL_GRAPH:
            found.append(materialize(e.df.coalesce(1).mapInPandas(_strong_parts, "id string, c string"), "scc-small").df)
            break
        while True:  # trim
            core = e.df.select(F.col("src").alias("id")).intersect(e.df.select(F.col("dst").alias("id")))
            ne = materialize(e.df.join(core.withColumnRenamed("id", "src"), "src", "left_semi").join(core.withColumnRenamed("id", "dst"), "dst", "left_semi"), "scc-e")
            was, left = left, ne.df.count()
            e.drop()
            e = ne
            if left == was or left <= SMALL_GRAPH:
                break
        if left <= SMALL_GRAPH:
            continue
        col = materialize(e.df.select(F.col("src").alias("id")).distinct().withColumn("c", F.col("id")), "scc-c")
        while True:
            up = e.df.join(col.df.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("m"))
            cur = col.df.join(up, "id").select("id", F.greatest("c", "m").alias("c"))
            # what reaches a node's colour reaches the node
            far = cur.select(F.col("id").alias("c"), F.col("c").alias("m"))
            cur = cur.join(far, "c", "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("c"))
            n = materialize(cur.join(col.df.select("id", F.col("c").alias("old")), "id").select("id", "c", (F.col("c") > F.col("old")).alias("ch")), "scc-c")
            stop = n.df.where("ch").isEmpty()
            col.drop()
            col = type(n)(n.df.select("id", "c"), n.path)
            if stop:
                break
        inside = e.df.join(col.df.select(F.col("id").alias("src"), F.col("c").alias("c1")), "src").join(col.df.select(F.col("id").alias("dst"), F.col("c").alias("c2")), "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("c"))
        inside = materialize(inside, "scc-i")
        # backwards from the colours' own nodes
        hit = materialize(col.df.withColumn("in", F.col("id") == F.col("c")), "scc-h")
        while True:
            back = inside.df.join(hit.df.where("in").select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct().withColumn("b", F.lit(True))
            n = materialize(hit.df.join(back, "id", "left").select("id", "c", (F.col("in") | F.coalesce("b", F.lit(False))).alias("in"), F.col("in").alias("old")), "scc-h")
            stop = n.df.where("in and not old").isEmpty()
            hit.drop()
            hit = type(n)(n.df.select("id", "c", "in"), n.path)
            if stop:
                break
        found.append(hit.df.where("in").select("id", "c"))
        done = found[-1].select("id")
        ne = materialize(e.df.join(done.withColumnRenamed("id", "src"), "src", "left_anti").join(done.withColumnRenamed("id", "dst"), "dst", "left_anti"), "scc-e")
        for x in (e, col, inside):
            x.drop()
        e = ne
        left = e.df.count()
    if not found:
        return nodes.select("id", F.col("id").alias("scc"), F.lit(1).cast("long").alias("size")).limit(0)
    a = found[0]
    for x in found[1:]:
        a = a.unionByName(x)
    k = a.groupBy("c").agg(F.min("id").alias("scc"), F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return a.join(k, "c").select("id", "scc", "size")


@analyzer("cycles")
def cycles(nodes: DataFrame, edges: DataFrame, *, top: int = TOP, longest: int = CYCLE_SCC) -> DataFrame:
    """``(scc, cycle, length, severity)``: elementary cycles inside components of 2 to 40 nodes, at most 10 ``top`` of each, begun at their smallest id; larger components are named with length 0."""
    s = scc(nodes, edges)
    e = edges.select("src", "dst").join(s.select(F.col("id").alias("src"), "scc", "size"), "src").join(s.select(F.col("id").alias("dst"), F.col("scc").alias("s2")), "dst").where("scc = s2 and src <> dst").distinct()
    cap = 10 * top

    def johnson(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["scc"].iloc[0]
        ids, adj = _adjacency(pdf, False)
        found: list[list[int]] = []
        for s0 in range(len(ids)):
            blocked, block_map, path = {s0}, {}, [s0]
            stack = [(s0, [w for w in adj[s0] if w >= s0])]
            closed: set[int] = set()
            while stack and len(found) < cap:
                v, nb = stack[-1]
                if nb:
                    w = nb.pop()
                    if w == s0:
                        found.append(path[:])
                        closed.update(path)
                    elif w not in blocked:
                        path.append(w)
                        stack.append((w, [x for x in adj[w] if x >= s0]))
                        closed.discard(w)
                        blocked.add(w)
                        continue
                if not nb:
                    if v in closed:
                        free = {v}
                        while free:
                            x = free.pop()
                            if x in blocked:
                                blocked.remove(x)
                                free |= block_map.pop(x, set())
                    else:
                        for w in adj[v]:
                            if w >= s0:
                                block_map.setdefault(w, set()).add(v)
                    stack.pop()
                    path.pop()
            if len(found) >= cap:
                break
        return pd.DataFrame({"scc": name, "cycle": ["->".join(ids[c]) for c in found], "length": [len(c) for c in found]}, columns=["scc", "cycle", "length"])

    small = e.where(F.col("size") <= longest).groupBy("scc").applyInPandas(johnson, "scc string, cycle string, length long")
    big = e.where(F.col("size") > longest).select("scc", F.lit("").alias("cycle"), F.lit(0).cast("long").alias("length")).distinct()
    sev = F.when(F.col("length") == 0, F.lit("critical")).when(F.col("length") == 2, F.lit("warning")).when(F.col("length") <= 5, F.lit("notice")).otherwise(F.lit("info"))
    return small.unionByName(big).withColumn("severity", sev)


@analyzer("dsm")
def dsm(nodes: DataFrame, edges: DataFrame, *, bottom: tuple[str, ...] = ("util", "utils", "common", "types"), top: tuple[str, ...] = ("cmd", "main", "app")) -> DataFrame:
    """``(from_pkg, to_pkg, n, from_layer, to_layer)``: dependencies ``(src, dst, n)`` of packages that point to a higher layer, or lie in a cycle.

    Layers: packages without dependencies are 0, others one above the highest they depend on, a cycle counting
    as one; well-known names go to the bottom or above all.
    """
    p = nodes.select("id").distinct()
    s = scc(p, edges)
    m = materialize(p.join(s.select("id", "scc"), "id", "left").select("id", F.coalesce("scc", "id").alias("g")), "dsm").df
    e = edges.join(m.select(F.col("id").alias("src"), F.col("g").alias("gs")), "src").join(m.select(F.col("id").alias("dst"), F.col("g").alias("gd")), "dst")
    ge = materialize(e.where("gs <> gd").select("gs", "gd").distinct(), "dsm-e").df
    lay = materialize(m.select("g").distinct().withColumn("layer", F.lit(0)), "dsm-l")
    while True:
        up = ge.join(lay.df.withColumnRenamed("g", "gd"), "gd").groupBy(F.col("gs").alias("g")).agg((F.max("layer") + 1).alias("u"))
        n = materialize(lay.df.join(up, "g", "left").select("g", F.greatest("layer", F.coalesce("u", F.lit(0))).alias("layer"), (F.coalesce("u", F.lit(0)) > F.col("layer")).alias("ch")), "dsm-l")
        stop = n.df.where("ch").isEmpty()
        lay.drop()
        lay = type(n)(n.df.select("g", "layer"), n.path)
        if stop:
            break
    most = lay.df.agg(F.max("layer")).first()[0] or 0
    last = F.element_at(F.split("id", "/"), -1)
    l2 = m.join(lay.df, "g").select("id", "g", F.when(last.isin(*bottom), F.lit(0)).when(last.isin(*top), F.lit(most + 1)).otherwise(F.col("layer")).alias("layer"))
    d = edges.join(l2.select(F.col("id").alias("src"), F.col("g").alias("g1"), F.col("layer").alias("from_layer")), "src").join(l2.select(F.col("id").alias("dst"), F.col("g").alias("g2"), F.col("layer").alias("to_layer")), "dst")
    d = d.where((F.col("to_layer") > F.col("from_layer")) | (F.col("g1") == F.col("g2")))
    return d.select(F.col("src").alias("from_pkg"), F.col("dst").alias("to_pkg"), "n", "from_layer", "to_layer", (F.col("g1") == F.col("g2")).alias("in_cycle"))


def motifs(g: G.Graph, edge: str, roots: list[str], depth: int = 3, least: int = 3) -> DataFrame:
    """``(motif, members, sample)``: groups of equal subtree shapes: pre-order ``(type:depth)`` tokens, children by type then id, hashed; built from the deepest level up."""
    n = g.live.select("id", "type")
    e = g.edges.where((F.col("type") == edge) & (F.col("from_id") != F.col("to_id"))).select(F.col("from_id").alias("id"), F.col("to_id").alias("child")).distinct()
    tok = lambda k: F.format_string("(%s:%d)", "type", F.lit(k))
    level = n.select("id", "type", tok(depth).alias("s"))
    for k in range(depth - 1, -1, -1):
        kids = e.join(level.select(F.col("id").alias("child"), F.col("type").alias("ct"), F.col("s").alias("cs")), "child").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ct", "child", "cs"))), lambda x: x["cs"]), "").alias("below"))
        level = n.join(kids, "id", "left").select("id", "type", F.concat(tok(k), F.coalesce("below", F.lit(""))).alias("s"))
    r = level.where(F.col("type").isin(*roots)).groupBy(F.substring(F.sha2("s", 256), 1, 16).alias("motif")).agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("sample"))
    return r.where(F.col("members") >= least)


def corpus_scan(g: G.Graph, checks: list[dict]) -> DataFrame:
    """Findings ``(check, id, degree)`` of stored checks over degrees: ``require`` present or absent, or ``max``/``min``; each has node_type, edge_type and direction."""
    out = None
    for c in checks:
        end = "from_id" if G.check_direction(c["direction"]) == "out" else "to_id"
        deg = g.edges.where(F.col("type") == c["edge_type"]).groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        d = g.live.where(F.col("type") == c["node_type"]).select("id").join(deg, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
        if c.get("require") == "present":
            d = d.where("degree = 0")
        elif c.get("require") == "absent":
            d = d.where("degree > 0")
        elif "max" in c:
            d = d.where(F.col("degree") > c["max"])
        elif "min" in c:
            d = d.where(F.col("degree") < c["min"])
        else:
            raise ValueError(f"check {c.get('name')} asks for nothing")
        d = d.select(F.lit(c["name"]).alias("check"), "id", "degree")
        out = d if out is None else out.unionByName(d)
    return out


def fixture_gate(check: dict, bad: G.Graph, good: G.Graph) -> bool:
    """A check may be stored if it finds something in its bad fixture and nothing in its good one."""
    return not corpus_scan(bad, [check]).isEmpty() and corpus_scan(good, [check]).isEmpty()


CHECK_SCHEMA = "name string, node_type string, edge_type string, direction string, require string, max long, min long"


def create_check(store: DataFrame | None, check: dict, bad: G.Graph, good: G.Graph) -> DataFrame:
    """The stored checks with one more; refused if the name is taken, it asks for nothing, or its fixtures do not tell it apart."""
    spark = bad.nodes.sparkSession
    G.check_direction(check["direction"])
    if store is not None and not store.where(F.col("name") == check["name"]).isEmpty():
        raise ValueError(f"check {check['name']} exists")
    if not fixture_gate(check, bad, good):
        raise ValueError(f"check {check['name']} does not tell its fixtures apart")
    row = spark.createDataFrame([tuple(check.get(c.split()[0]) for c in CHECK_SCHEMA.split(", "))], CHECK_SCHEMA)
    return row if store is None else store.unionByName(row)


def list_checks(store: DataFrame, node_type: str | None = None) -> DataFrame:
    return (store if node_type is None else store.where(F.col("node_type") == node_type)).orderBy("name")


def run_checks(store: DataFrame, g: G.Graph) -> DataFrame:
    """Findings of all stored checks; the checks themselves, a short configuration, are read."""
    checks = [{k: v for k, v in r.asDict().items() if v is not None} for r in store.toLocalIterator()]
    return corpus_scan(g, checks)


def findings(scores: DataFrame, algorithm: str, score: str = "score", top: int = TOP) -> DataFrame:
    """The uniform output of an analyzer: ``(algorithm, rank, id, severity, title, metrics)`` of the best ``top`` by score."""
    d = G.percent_rank_below(scores.select("id", F.col(score).cast("double").alias("score")), "score", "percentile")
    d = d.orderBy(F.desc("score"), "id").limit(top)
    from pyspark.sql.window import Window as W

    d = d.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))  # at most ``top`` rows
    return d.select(F.lit(algorithm).alias("algorithm"), "rank", "id", severity(F.col("percentile")).alias("severity"), F.format_string("%s #%d", F.lit(algorithm), "rank").alias("title"),
                    F.create_map(F.lit("score"), F.round("score", 9), F.lit("percentile"), F.round("percentile", 6)).alias("metrics"))


def render(f: DataFrame) -> DataFrame:
    """Findings as JSON lines."""
    return f.select("algorithm", "rank", F.to_json(F.struct(*[c for c in f.columns if c != "metrics"])).alias("line"))

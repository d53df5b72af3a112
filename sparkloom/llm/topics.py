"""Problem 3: topics of mutually similar binary vectors, by hierarchical density clustering."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.llm.blocks import latest, parts_for, sorted_groups
from sparkloom.llm.components import connected_groups
from sparkloom.runtime import Materialized, materialize

BITS = 256
#: Rows of one order that a record is compared with on either side at least, and the share of pairs at the very
#: threshold that these comparisons are to meet; neighbours of neighbours give most of the rest.
WINDOW, SHARE = 512, 0.7
#: The same for one record of every topic, compared over the borders of components.
ACROSS_WINDOW, ACROSS_SHARE = 4096, 0.99
#: Neighbours kept per record; density is taken at the (MIN_SIZE-1)-th.
KEEP = 8
MIN_SIZE = 5
#: Distinct vectors of one component that one task holds; a larger component is cut where its tree is weakest.
COMPONENT_ROWS = 50_000
#: Bits of a record number where it shares a long with a distance.
SHIFT = 55


def _packed(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype=np.uint8).reshape(-1, BITS // 8)


def _signs(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of packed rows; exact, as the products are small integers. The second side is unpacked in blocks."""
    out, x = np.empty((len(a), len(b)), dtype=np.float32), _signs(a)
    for s in range(0, len(b), 65_536):
        out[:, s : s + 65_536] = (BITS - x @ _signs(b[s : s + 65_536]).T) / 2
    return out


def _blocks(n: int, width: int) -> list[slice]:
    """Slices of n rows such that a block against ``width`` rows holds at most some 16 million distances."""
    k = max(1, min(1024, (1 << 24) // max(1, width)))
    return [slice(s, s + k) for s in range(0, n, k)]


def _majority(x: np.ndarray, members: np.ndarray) -> np.ndarray:
    """The packed majority bits of some rows, as one row; a tie sets the bit."""
    total = np.zeros(BITS, dtype=np.int64)
    for s in range(0, len(members), 65_536):
        total += np.unpackbits(x[members[s : s + 65_536]], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * total >= len(members))[None, :]


def orders_for(n: int, radius: int, window: int, share: float) -> int:
    """Orders in which two of ``n`` records ``radius`` apart meet with a chance of ``share``.

    They stand within ``window`` rows of each other in one order at least if they agree in its first log2(n/window)
    bits. The number grows with n to the power of -log2(1 - radius/BITS), 0.42 at a similarity of 0.75.
    """
    meet = (1 - radius / BITS) ** max(0.0, math.log2(max(n, 1) / window))
    return 1 if meet >= 1 else max(8, math.ceil(math.log(1 - share) / math.log(1 - meet)))


def _hits(dots: np.ndarray, least: float, keep: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the entries of at least ``least``; of every row the ``keep`` greatest, if told."""
    ok = dots >= least
    if keep is None:
        return ok.nonzero()
    count = ok.sum(1)
    few = ((count > 0) & (count <= keep)).nonzero()[0]
    many = (count > keep).nonzero()[0]
    r, c = ok[few].nonzero()
    r = few[r]
    if len(many):
        near = np.argpartition(-dots[many], keep - 1, axis=1)[:, :keep]
        r, c = np.concatenate([r, np.repeat(many, keep)]), np.concatenate([c, near.ravel()])
    return r, c


def side_by_side(points: DataFrame, radius: int, *, window: int, share: float, keep: int | None) -> DataFrame:
    """``(q, near array<long>)``: rows ``(nid, vector)`` within ``radius`` that stand side by side in some order, as distance << SHIFT | record.

    Every record is laid into several sorted orders, each by another random permutation of its bits, and compared
    with at least ``window`` rows on either side: similar records share long prefixes in some order. The number of
    orders grows with that of the records (:func:`orders_for`). A block has the same size however many records
    share a prefix, so neither a hot prefix nor a huge topic makes a large task. Distances are exact. With a column
    ``c`` only records of different c count. A record gives one list an order, of the ``keep`` nearest if told.
    """
    spark, apart = points.sparkSession, "c" in points.columns
    n = points.count()
    orders = orders_for(n, radius, window, share)
    perms = np.stack([np.random.default_rng(100 + t).permutation(BITS)[:63] for t in range(orders)])
    least = BITS - 2 * radius - 0.5
    columns = ["nid", "vector", *(["c"] if apart else [])]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.unpackbits(_codes(b["vector"]), axis=1)
            k = np.empty((b.num_rows, orders), dtype=np.int64)
            for t, p in enumerate(perms):
                k[:, t] = np.ascontiguousarray(np.packbits(np.pad(bits[:, p], ((0, 0), (1, 0))), axis=1)).view(">i8")[:, 0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * orders), pa.array(k.ravel()))
            yield pa.RecordBatch.from_arrays([*[b[c] for c in columns], lists], names=[*columns, "k"])

    rows = points.select(*columns).mapInArrow(keys, "nid long, vector binary, " + ("c long, " if apart else "") + "k array<long>").select(*columns, F.posexplode("k").alias("t", "key"))
    # rows of two tasks do not meet, so a task holds many blocks; a single order of at most one block is one task
    parts = min(parts_for(spark, n * orders, 100_000), n * orders // (16 * window) + 1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_hits = None, []
        for t, nid, c, packed in _cut(batches, window, apart):
            x = _signs(packed)
            dots = x @ x.T
            np.fill_diagonal(dots, -BITS)
            mine = [_within(dots, nid, c, c, least, keep, apart)]
            if last is not None and last[0] == t:
                dots = last[3] @ x.T
                open_hits.append(_within(dots, nid, last[2], c, least, keep, apart))
                mine.append(_within(dots.T, last[1], c, last[2], least, keep, apart))
            if last is not None:
                yield from _emit(last[1], open_hits, keep)
            last, open_hits = (t, nid, c, x), mine
        if last is not None:
            yield from _emit(last[1], open_hits, keep)

    return rows.repartitionByRange(parts, "t", "key").sortWithinPartitions("t", "key", "nid").drop("key").mapInArrow(compare, "q long, near array<long>")


def _codes(a: pa.Array) -> np.ndarray:
    """The packed rows of a binary column of BITS // 8 bytes each, without a copy."""
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].reshape(-1, BITS // 8) if len(a) else np.empty((0, BITS // 8), dtype=np.uint8)


def _within(dots: np.ndarray, other: np.ndarray, cq: np.ndarray, cr: np.ndarray, least: float, keep: int | None, apart: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows and packed hits: the columns whose products reach ``least``, of a different c if asked."""
    if apart:
        dots = np.where(cq[:, None] == cr[None, :], np.float32(-BITS), dots)
    if dots.max() < least:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    i, j = _hits(dots, least, keep)
    return i, ((BITS - dots[i, j]) / 2).astype(np.int64) << SHIFT | other[j]


def _emit(nid: np.ndarray, hits: list[tuple[np.ndarray, np.ndarray]], keep: int | None) -> Iterator[pa.RecordBatch]:
    """One list for every row of a block that has hits, nearest first."""
    i, x = (np.concatenate(h) for h in zip(*hits))
    if not len(i):
        return
    order = np.lexsort((x, i))
    i, x = i[order], x[order]
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    sizes = np.diff(np.r_[starts, len(i)])
    if keep is not None and sizes.max() > keep:
        x = x[np.arange(len(i)) - np.repeat(starts, sizes) < keep]
        sizes = np.minimum(sizes, keep)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(x))
    yield pa.RecordBatch.from_arrays([pa.array(nid[i[starts]]), lists], names=["q", "near"])


def _cut(batches: Iterator[pa.RecordBatch], window: int, apart: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of at most ``window`` rows in a row inside one order: order, numbers, components, packed vectors."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size, now = 0, -1
    for b in batches:
        if not b.num_rows:
            continue
        t, nid = b["t"].to_numpy(), b["nid"].to_numpy()
        c, x = b["c"].to_numpy() if apart else nid, _codes(b["vector"])
        borders = [0, *(np.flatnonzero(t[1:] != t[:-1]) + 1), len(t)]
        for s, e in zip(borders, borders[1:]):
            if held and now != t[s]:
                yield now, *(np.concatenate(h) for h in zip(*held))
                held, size = [], 0
            now = int(t[s])
            while s < e:
                k = min(e - s, window - size)
                held.append((nid[s : s + k], c[s : s + k], x[s : s + k]))
                s, size = s + k, size + k
                if size == window:
                    yield now, *(np.concatenate(h) for h in zip(*held))
                    held, size = [], 0
    if held:
        yield now, *(np.concatenate(h) for h in zip(*held))


def _lists(found: DataFrame) -> DataFrame:
    """``(q, near)`` of lists ``(q, near)``: the KEEP nearest of all of a record's."""
    return found.groupBy("q").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, KEEP).alias("near"))


def neighbour_lists(points: DataFrame, radius: int) -> DataFrame:
    """``(q, near array<long>)``: for rows ``(nid, vector)`` the KEEP nearest found within ``radius``, as distance << SHIFT | record.

    Candidates stand side by side in sorted orders; then, round by round until none is new, records whose list is
    not full are held against the neighbours of their neighbours. Distances are exact; a pair that neither step
    brings together is missed.
    """
    packed = lambda r: F.array(F.shiftleft(F.col("d").cast("long"), SHIFT).bitwiseOR(F.col(r))).alias("near")
    lists = materialize(_lists(side_by_side(points, radius, window=WINDOW, share=SHARE, keep=KEEP)), "p3-lists")
    vectors = points.select("nid", "vector")
    while True:
        l = lists.df
        number = lambda x: x.bitwiseAND(F.lit((1 << SHIFT) - 1))
        own = l.where(F.size("near") < KEEP).select("q", F.transform("near", number).alias("known"))
        step = own.select("q", "known", F.explode("known").alias("via"))
        beyond = step.join(l.select(F.col("q").alias("via"), F.transform("near", number).alias("next")), "via").select("q", F.explode(F.array_except("next", F.array_append("known", F.col("q")))).alias("r")).distinct()
        pairs = beyond.join(vectors.select(F.col("nid").alias("q"), F.col("vector").alias("vq")), "q").join(vectors.select(F.col("nid").alias("r"), F.col("vector").alias("vr")), "r")

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    d = np.bitwise_count(_packed(list(b["vq"])) ^ _packed(list(b["vr"]))).sum(1, dtype=np.int32)
                    yield b[["q", "r"]].assign(d=d)[d <= radius]

        new = materialize(pairs.select("q", "r", "vq", "vr").mapInPandas(measure, "q long, r long, d int"), "p3-new")
        if new.df.isEmpty():
            new.drop()
            return l
        grown = new.df.select("q", packed("r")).unionByName(new.df.select(F.col("r").alias("q"), packed("q")))
        nxt = materialize(_lists(l.unionByName(grown)), "p3-lists")
        lists.drop()
        new.drop()
        lists = nxt


def reachability(lists: DataFrame, sizes: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """Mutual-reachability edges ``(u, v, w)``, u < v, with integer w = max(core of u, core of v, distance).

    A record's core is the distance at which it has ``min_size - 1`` other records, copies of its own vector
    included; records that never have as many within their list are left out.
    """
    e = lists.select("q", F.explode("near").alias("x")).select(
        "q", F.shiftrightunsigned("x", SHIFT).cast("int").alias("d"), F.col("x").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("r")
    )
    s = sizes.select("nid", "size")
    reach = e.join(s.withColumnRenamed("nid", "r").withColumnRenamed("size", "rs"), "r").groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct("d", "rs"))).alias("l")
    )
    folded = F.expr(
        f"aggregate(l, struct(size - 1L AS have, CASE WHEN size >= {min_size}L THEN 0 ELSE -1 END AS core), "
        f"(a, x) -> struct(a.have + x.rs AS have, CASE WHEN a.core >= 0 THEN a.core WHEN a.have + x.rs >= {min_size - 1}L THEN x.d ELSE -1 END AS core)).core"
    )
    core = materialize(
        s.join(reach.withColumnRenamed("q", "nid"), "nid", "left").where(F.col("l").isNotNull())
        .select("nid", folded.alias("core")).where("core >= 0"), "p3-core"
    ).df
    both = e.select(F.least("q", "r").alias("u"), F.greatest("q", "r").alias("v"), "d").distinct()
    return (
        both.join(core.select(F.col("nid").alias("u"), F.col("core").alias("cu")), "u")
        .join(core.select(F.col("nid").alias("v"), F.col("core").alias("cv")), "v")
        .select("u", "v", F.greatest("d", "cu", "cv").cast("int").alias("w"))
    )


def minimum_spanning_forest(edges: DataFrame) -> tuple[Materialized, Materialized]:
    """Borůvka's algorithm on ``(u, v, w)``: the forest ``(c, u, v, w)`` and the components ``(nid, c)``.

    Each round every component takes its least edge in the order (w, u, v), the components hooked by these
    edges become one by pointer jumping, and edges are reduced to the least between two components. Rounds
    are written to the shared folder.
    """
    now = materialize(edges.select("u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv")), "p3-edges")
    label = materialize(edges.select(F.explode(F.array("u", "v")).alias("nid")).distinct().withColumn("c", F.col("nid")), "p3-label")
    tree: list[Materialized] = []
    while not now.df.isEmpty():
        e = now.df
        both = e.select("cu", F.struct("w", "u", "v", F.col("cv").alias("to")).alias("x")).unionByName(
            e.select(F.col("cv").alias("cu"), F.struct("w", "u", "v", F.col("cu").alias("to")).alias("x")))
        pick = materialize(both.groupBy("cu").agg(F.min("x").alias("x")).select(F.col("cu").alias("c"), "x.*"), "p3-pick")
        tree.append(materialize(pick.df.select("u", "v", "w").distinct(), "p3-tree"))
        # the only cycles are two components that took the same edge; the smaller of them becomes the root
        back = pick.df.select(F.col("c").alias("to"), F.col("to").alias("c2"))
        hop = materialize(
            pick.df.select("c", "to").join(back, "to", "left")
            .select("c", F.when((F.col("c2") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to")), "p3-hop")
        while True:
            nxt = hop.df
            for _ in range(2):
                up = nxt.select(F.col("c").alias("to"), F.col("to").alias("up"))
                nxt = nxt.join(up, "to").select("c", F.col("up").alias("to"), (F.col("up") != F.col("to")).alias("moved"))
            nxt_m = materialize(nxt, "p3-hop")
            hop.drop()
            hop = Materialized(nxt_m.df.select("c", "to"), nxt_m.path)
            if nxt_m.df.where("moved").isEmpty():
                break
        root = hop.df
        nl = materialize(label.df.join(root, "c", "left").select("nid", F.coalesce("to", "c").alias("c")), "p3-label")
        ne = (
            e.join(root.select(F.col("c").alias("cu"), F.col("to").alias("ru")), "cu").join(root.select(F.col("c").alias("cv"), F.col("to").alias("rv")), "cv")
            .where("ru <> rv").groupBy(F.least("ru", "rv").alias("cu"), F.greatest("ru", "rv").alias("cv")).agg(F.min(F.struct("w", "u", "v")).alias("x"))
            .select("x.u", "x.v", "x.w", "cu", "cv")
        )
        nxt_e = materialize(ne, "p3-edges")
        for old in (now, label, pick, hop):
            old.drop()
        now, label = nxt_e, nl
    now.drop()
    if not tree:
        return materialize(edges.select(F.col("u").alias("c"), "u", "v", "w"), "p3-forest"), label
    all_e = tree[0].df
    for t in tree[1:]:
        all_e = all_e.unionByName(t.df)
    forest = materialize(all_e.join(label.df.withColumnRenamed("nid", "u"), "u").select("c", "u", "v", "w"), "p3-forest")
    for t in tree:
        t.drop()
    return forest, label


def cut_large(forest: Materialized, label: Materialized) -> tuple[Materialized, Materialized]:
    """Forest and components with a column ``cut``, in which no component has more than COMPONENT_ROWS records.

    A larger one loses the heaviest edges of its tree, those of more than four fifths of its greatest weight, until
    its parts are small enough: a part is a component of the graph at that smaller distance. ``cut`` marks the
    records of such parts, which have similar ones beyond their borders.
    """
    label = Materialized(label.df.withColumn("cut", F.lit(False)), label.path)
    while True:
        large = materialize(label.df.groupBy("c").count().where(F.col("count") > COMPONENT_ROWS).select("c"), "p3-large")
        if large.df.isEmpty():
            large.drop()
            return forest, label
        most = forest.df.join(large.df, "c").groupBy("c").agg((F.max("w") * 4 / 5).alias("most"))
        kept = materialize(forest.df.join(large.df, "c").join(most, "c").where("w <= most").select("u", "v", "w"), "p3-kept")
        groups = connected_groups(kept.df, "u", "v").select(F.col("node").alias("nid"), F.col("group_id").alias("c"))
        parts = label.df.join(large.df, "c").select("nid").join(groups, "nid", "left").select("nid", F.coalesce("c", "nid").alias("c"), F.lit(True).alias("cut"))
        new_label = materialize(label.df.join(large.df, "c", "left_anti").select("nid", "c", "cut").unionByName(parts), "p3-label")
        moved = kept.df.join(groups.select(F.col("nid").alias("u"), "c"), "u").select("c", "u", "v", "w")
        new_forest = materialize(forest.df.join(large.df, "c", "left_anti").select("c", "u", "v", "w").unionByName(moved), "p3-forest")
        for old in (forest, label, large, kept):
            old.drop()
        forest, label = new_forest, new_label


def condensed_clusters(n: int, size: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, min_size: int = MIN_SIZE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Stability-selected clusters of one spanning tree: ``(members, persistence)`` per cluster.

    The single-linkage hierarchy is condensed to splits in which both sides hold ``min_size`` records; a
    cluster's stability sums over its records the span of density 1/(1+w) they stay in it, and a cluster
    is selected if it is more stable than its selected descendants together. Persistence is the density
    at which a member leaves.
    """
    order = np.lexsort((v, u, w))
    parent, weight = list(range(2 * n - 1)), [int(x) for x in size] + [0] * (n - 1)
    kids: list[tuple[int, int, float]] = [(-1, -1, 0.0)] * (2 * n - 1)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    top = n
    for k in order:
        a, b = find(int(u[k])), find(int(v[k]))
        parent[a] = parent[b] = top
        weight[top] = weight[a] + weight[b]
        kids[top] = (a, b, 1.0 / (1.0 + float(w[k])))
        top += 1
    if weight[top - 1] < min_size:
        return []

    def leaves(x: int) -> list[int]:
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            if y < n:
                out.append(y)
            else:
                todo += kids[y][:2]
        return out

    # clusters of the condensed tree: birth density, points with the density they leave at, children
    clusters: list[dict] = [{"birth": 0.0, "pts": [], "lam": [], "kids": [], "up": -1}]
    todo = [(top - 1, 0)]
    while todo:
        node, c = todo.pop()
        cl = clusters[c]
        while node >= n:
            a, b, lam = kids[node]
            if weight[a] >= min_size and weight[b] >= min_size:
                for x in (a, b):
                    clusters.append({"birth": lam, "pts": [], "lam": [], "kids": [], "up": c})
                    cl["kids"].append(len(clusters) - 1)
                    todo.append((x, len(clusters) - 1))
                cl["split"] = (lam, weight[node])
                node = -1
                break
            small, node = (a, b) if weight[a] < weight[b] else (b, a)
            ls = leaves(small)
            cl["pts"] += ls
            cl["lam"] += [lam] * len(ls)
        if node >= 0:
            cl["pts"].append(node)
            cl["lam"].append(1.0)
    stab = [0.0] * len(clusters)
    for i, cl in enumerate(clusters):
        stab[i] = sum((x - cl["birth"]) * float(size[p]) for p, x in zip(cl["pts"], cl["lam"]))
        if "split" in cl:
            stab[i] += (cl["split"][0] - cl["birth"]) * cl["split"][1]
    chosen = [False] * len(clusters)
    for i in range(len(clusters) - 1, -1, -1):
        below = sum(stab[k] for k in clusters[i]["kids"])
        if stab[i] >= below:
            chosen[i] = True
        else:
            stab[i] = below
    out, todo2 = [], [0]
    while todo2:
        i = todo2.pop()
        if chosen[i]:
            pts, lam, sub = [], [], [i]
            while sub:
                j = sub.pop()
                pts += clusters[j]["pts"]
                lam += clusters[j]["lam"]
                sub += clusters[j]["kids"]
            out.append((np.array(pts), np.array(lam)))
        else:
            todo2 += clusters[i]["kids"]
    return out


def _misses(x: np.ndarray, members: np.ndarray, radius: int) -> np.ndarray:
    """For every member the number of members it is not similar to.

    Two members that lie within a and b of the majority vector differ in at most a+b bits, so only members
    whose distance to it plus the greatest one exceeds the radius are held against all.
    """
    m = x[members]
    r = _distance(_majority(x, members), m)[0]
    out = np.zeros(len(members), dtype=np.int64)
    unsure = (r + r.max() > radius).nonzero()[0]
    certain = np.ones(len(m), dtype=bool)
    certain[unsure] = False
    for b in _blocks(len(unsure), len(m)):
        far = _distance(m[unsure[b]], m) > radius
        out[unsure[b]] = far.sum(1)
        out[certain] += far[:, certain].sum(0)
    return out


def clique_of(x: np.ndarray, members: np.ndarray, radius: int) -> np.ndarray:
    """Drop members until all are similar to one another, the one similar to the fewest first (ties: the largest number)."""
    members = np.sort(members)
    miss = _misses(x, members, radius)
    while len(members) and miss.max() > 0:
        worst = len(miss) - 1 - int(np.argmax(miss[::-1]))
        far = (_distance(x[members[worst]][None, :], x[members]) > radius)[0]
        miss = miss - far
        keep = np.arange(len(members)) != worst
        members, miss = members[keep], miss[keep]
    return members


def topics_of(x: np.ndarray, size: np.ndarray, clusters: list[np.ndarray], radius: int, min_size: int = MIN_SIZE) -> list[np.ndarray]:
    """Exact topics of one component from its proposed clusters.

    Clusters are trimmed to mutual similarity, joined where their union is mutually similar, completed by
    outside records similar to all members, and what is left over is searched for further topics.
    """
    found: list[np.ndarray] = []
    for c in sorted((clique_of(x, m, radius) for m in clusters), key=lambda m: (-int(size[m].sum()), m.min() if len(m) else 0)):
        if not len(c):
            continue
        for i, f in enumerate(found):
            if _distance(x[c[:1]], x[f[:1]])[0, 0] <= radius and all((_distance(x[c[b]], x[f]) <= radius).all() for b in _blocks(len(c), len(f))):
                found[i] = np.concatenate([f, c])
                break
        else:
            found.append(c)
    used = np.zeros(len(x), dtype=bool)
    for f in found:
        used[f] = True
    out = []
    for f in sorted(found, key=lambda m: (-int(size[m].sum()), m.min())):
        free = (~used).nonzero()[0]
        if len(free):
            free = free[_distance(x[f[:1]], x[free])[0] <= radius]
        for b in _blocks(len(free), len(f)):
            part = free[b]
            whole = part[(_distance(x[part], x[f]) <= radius).all(1)]
            for p in whole:
                if (_distance(x[p][None, :], x[f]) <= radius).all():
                    f = np.append(f, p)
                    used[p] = True
        if size[f].sum() >= min_size:
            out.append(f)
        else:
            used[f] = False
    # leftovers: grow from the record with most free similar ones
    tried = used.copy()
    while True:
        free = (~used).nonzero()[0]
        seeds = (~tried).nonzero()[0]
        if size[free].sum() < min_size or not len(seeds):
            return out
        seeds = seeds[_blocks(len(seeds), len(free))[0]]
        near = _distance(x[seeds], x[free]) <= radius
        tot = near @ size[free]
        tried[seeds[tot < min_size]] = True
        if tot.max() < min_size:
            continue
        s = seeds[int(np.argmax(tot))]
        tried[s] = True
        c = clique_of(x, free[near[int(np.argmax(tot))]], radius)
        if size[c].sum() >= min_size:
            out.append(c)
            used[c] = True
            tried[c] = True


def cluster_topics(points: DataFrame, radius: int) -> DataFrame:
    """``(nid, topic, persistence)`` for rows ``(nid, vector, size)`` of distinct vectors; topic is the smallest nid of it.

    One task holds one component of the reachability graph, of at most COMPONENT_ROWS distinct vectors: about 200
    bytes for each of them, and blocks of distances of a fixed size. Topics that reach over components, found or cut,
    are joined and completed afterwards.
    """
    lists = neighbour_lists(points.select("nid", "vector"), radius)
    edges = materialize(reachability(lists, points).where(F.col("w") <= radius), "p3-reach")
    forest, label = cut_large(*minimum_spanning_forest(edges.df))
    # vectors of five copies that have no neighbour are topics of their own; they are no end of an edge
    alone = points.where(F.col("size") >= MIN_SIZE).join(label.df.select("nid"), "nid", "left_anti").select("nid", F.col("nid").alias("c"), F.col("nid").alias("topic"), F.lit(1.0).alias("persistence"))
    p = label.df.join(points, "nid").select("c", "nid", F.lit(-1).cast("long").alias("v"), F.lit(0).alias("w"), "vector", "size")
    e = forest.df.select("c", F.col("u").alias("nid"), "v", "w", F.lit(None).cast("binary").alias("vector"), F.lit(0).cast("long").alias("size"))
    rows = p.unionByName(e)
    parts = parts_for(points.sparkSession, rows.count(), COMPONENT_ROWS)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for grp in sorted_groups(batches, "c"):
            is_p = grp["v"].to_numpy() < 0
            pts, es = grp[is_p].sort_values("nid"), grp[~is_p]
            nid, size = pts["nid"].to_numpy(), pts["size"].to_numpy()
            cl, found, x = [], [], _packed(list(pts["vector"]))
            if size.sum() >= MIN_SIZE:
                cl = condensed_clusters(len(nid), size, np.searchsorted(nid, es["nid"].to_numpy()), np.searchsorted(nid, es["v"].to_numpy()), es["w"].to_numpy())
                found = topics_of(x, size, [m for m, _ in cl], radius)
            lasts = np.zeros(len(nid))
            for m, lam in cl:
                lasts[m] = lam
            held.append(pd.DataFrame({"nid": nid, "c": int(grp["c"].iloc[0]), "topic": _numbers(nid, found), "persistence": lasts}))
            if len(held) > 500:
                yield pd.concat(held)
                held = []
        if held:
            yield pd.concat(held)

    solved = rows.repartition(parts, "c").sortWithinPartitions("c").mapInPandas(solve, "nid long, c long, topic long, persistence double")
    solved = materialize(solved.unionByName(alone), "p3-solved").df
    return across_components(points, lists, label.df.where("cut").select("nid"), solved, radius)


def _numbers(nid: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """Of every record the smallest number in its topic, or -1."""
    out = np.full(len(nid), -1, dtype=np.int64)
    for t in found:
        out[t] = nid[t].min()
    return out


def across_components(points: DataFrame, lists: DataFrame, cut: DataFrame, solved: DataFrame, radius: int) -> DataFrame:
    """``(nid, topic, persistence)``: the topics of all components, joined and completed over their borders.

    A list of fewer than KEEP holds all records found similar to its own, so two similar records in different
    components both have full lists, or belong to a component that was ``cut``. Hence only topics whose members all
    are such records, and such records in no topic, can belong together over a border. One record of each of these
    is compared side by side with those of other components, and what meets is compared in full. Where all topics
    and records linked in this way are similar throughout, they are one topic; else they are solved again as one
    component, with their topics as proposals.
    """
    full = lists.where(F.size("near") >= KEEP).select(F.col("q").alias("nid")).unionByName(cut).distinct()
    p = points.join(full, "nid").join(solved, "nid", "left").select("nid", "vector", "size", F.coalesce("c", "nid").alias("c"), F.coalesce("topic", F.lit(-1)).alias("topic"), F.coalesce("persistence", F.lit(0.0)).alias("persistence"))
    sizes = solved.where("topic >= 0").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    whole = p.where("topic >= 0").groupBy("topic").agg(F.count(F.lit(1)).alias("k")).join(sizes, "topic").where("k = n").select("topic")
    m = materialize(p.where("topic < 0").unionByName(p.join(whole, "topic", "left_semi")).withColumn("item", F.when(F.col("topic") < 0, F.col("nid")).otherwise(F.col("topic"))), "p3-border").df
    result = solved.where("topic >= 0").select("nid", "topic", "persistence")
    near = side_by_side(m.where("nid = item").select("nid", "vector", "c"), radius, window=ACROSS_WINDOW, share=ACROSS_SHARE, keep=None)
    near = near.select("q", F.explode("near").alias("x")).select("q", F.col("x").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("r"))
    pairs = materialize(near.select(F.least("q", "r").alias("a"), F.greatest("q", "r").alias("b")).distinct(), "p3-pairs").df
    if pairs.isEmpty():
        return result
    ends = pairs.join(m.select(F.col("item").alias("a"), "vector"), "a").select("a", "b", F.lit(0).alias("side"), "vector").unionByName(
        pairs.join(m.select(F.col("item").alias("b"), "vector"), "b").select("a", "b", F.lit(1).alias("side"), "vector"))

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for grp in sorted_groups(batches, ["a", "b"]):
            side = grp["side"].to_numpy()
            x = _packed(list(grp["vector"]))
            y, z = x[side == 0], x[side == 1]
            centre = _majority(x, np.arange(len(x)))
            # what lies within a and b of one vector differs in at most a+b bits
            if _distance(centre, y).max() + _distance(centre, z).max() <= radius or all((_distance(y[b], z) <= radius).all() for b in _blocks(len(y), len(z))):
                yield grp[["a", "b"]].head(1)

    links = materialize(ends.repartition("a", "b").sortWithinPartitions("a", "b").mapInPandas(alike, "a long, b long"), "p3-links").df
    if links.isEmpty():
        return result
    groups = materialize(connected_groups(links).select(F.col("node").alias("item"), "group_id"), "p3-groups").df
    # a group in which every two items of different components are linked, and no two of one component stand, is one topic
    of = groups.join(m.select("item", "c", "topic").distinct(), "item")
    pairs_of = links.join(groups.withColumnRenamed("item", "a"), "a").groupBy("group_id").agg(F.count(F.lit(1)).alias("links"))
    one = of.groupBy("group_id").agg(F.count(F.lit(1)).alias("k"), F.countDistinct("c").alias("cs"), F.min(F.when(F.col("topic") >= 0, F.col("topic"))).alias("least"))
    one = materialize(one.join(pairs_of, "group_id").where("links = k * (k - 1) / 2 and k = cs"), "p3-one").df
    rows = m.join(groups, "item").select("group_id", "nid", "vector", "size", "topic", "persistence")
    weights = rows.join(one.select("group_id"), "group_id").groupBy("group_id").agg(F.sum("size").alias("total"), F.min("nid").alias("first")).select("group_id", F.when(F.col("total") >= MIN_SIZE, F.col("first")).otherwise(-1).alias("new"))
    joined = rows.join(weights, "group_id").select("nid", F.col("new").alias("topic"), "persistence")
    again = rows.join(one.select("group_id"), "group_id", "left_anti")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for grp in sorted_groups(batches, "group_id"):
            grp = grp.sort_values("nid", ignore_index=True)
            nid, was = grp["nid"].to_numpy(), grp["topic"].to_numpy()
            order = np.argsort(was, kind="stable")
            proposed = [t for t in np.split(order, np.flatnonzero(np.diff(was[order])) + 1) if was[t[0]] >= 0]
            found = topics_of(_packed(list(grp["vector"])), grp["size"].to_numpy(), proposed, radius)
            yield pd.DataFrame({"nid": nid, "topic": _numbers(nid, found), "persistence": grp["persistence"]})

    solved_again = again.repartition("group_id").sortWithinPartitions("group_id").mapInPandas(solve, "nid long, topic long, persistence double")
    changed = materialize(joined.unionByName(solved_again), "p3-again").df
    return result.join(changed.select("nid"), "nid", "left_anti").unionByName(changed.where("topic >= 0"))


def topics(docs: DataFrame, *, similarity: float = 0.75) -> DataFrame:
    """``(node_id, topic_key, persistence)`` of every record in a topic.

    Input columns ``id, vector, updated_at``; only the latest row of an id counts, and a vector that is
    missing, not 32 bytes or all zero belongs nowhere. Records of equal vectors are one point of a weight.
    Every topic has at least five records that are all similar to one another; its key is the smallest id.
    An empty table gives an empty result; other columns are ignored.
    """
    radius = int(BITS * (1 - similarity))
    v = latest(docs.select("id", "vector", "updated_at"), "id", "vector", "updated_at")
    v = v.where((F.octet_length("vector") == BITS // 8) & (F.col("vector") != F.lit(bytes(BITS // 8))))
    members = materialize(v, "p3-members")
    firsts = members.df.groupBy("vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size"))
    points = materialize(firsts.orderBy("first").select(F.monotonically_increasing_id().alias("nid"), "vector", "first", "size"), "p3-points").df
    # numbers of the points ascend with their smallest id and stay below 2**SHIFT
    t = materialize(cluster_topics(points.select("nid", "vector", "size"), radius), "p3-topics").df
    keyed = t.join(points.select(F.col("nid").alias("topic"), F.col("first").alias("topic_key")), "topic").join(points.select("nid", "vector"), "nid")
    return members.df.join(keyed, "vector").select(F.col("id").alias("node_id"), "topic_key", "persistence")


def topic_report(docs: DataFrame, *, exemplars: int = 3, similarity: float = 0.75) -> DataFrame:
    """``(topic_key, size, exemplars)``: of every topic its size and the ids of its most persistent members (ties: smallest id)."""
    t = topics(docs, similarity=similarity)
    salted = t.withColumn("salt", F.pmod(F.xxhash64("node_id"), F.lit(32)))
    sizes = t.groupBy("topic_key").agg(F.count(F.lit(1)).alias("size"))
    by = [F.desc("persistence"), "node_id"]
    best = salted.withColumn("rn", F.row_number().over(W.partitionBy("topic_key", "salt").orderBy(*by))).where(F.col("rn") <= exemplars)
    best = best.withColumn("rn", F.row_number().over(W.partitionBy("topic_key").orderBy(*by))).where(F.col("rn") <= exemplars)
    ex = best.groupBy("topic_key").agg(F.array_sort(F.collect_list(F.struct("rn", "node_id"))).alias("x")).select("topic_key", F.col("x.node_id").alias("exemplars"))
    return sizes.join(ex, "topic_key")

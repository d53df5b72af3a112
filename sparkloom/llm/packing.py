"""Problem 6: texts into containers of a fixed number of tokens with little room left over."""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.runtime import materialize

#: Ranks of a public byte-level tokenizer for many languages; any file of this format may be named instead.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Pieces a text is cut into before merging; the usual pattern of byte-level tokenizers.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Classes of length over a window, and items of a combination, in the least-squares step.
CLASSES, DEPTH = 96, 3
#: About how many items of one length are numbered in one task; more are cut into slices.
SLICE_ROWS = 100_000
#: Share of the room that is to be used where there are items enough to choose from.
FILL_FLOOR = 0.97


def encoder(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``(doc_id, n_tokens)`` of every text that is not null, empty or blank; the driver sends the tokenizer's file to the executors."""

    documents.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(SparkFiles.get(name))
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) for t in b["text"]]})

    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S")).select(F.col("doc_id").cast("long"), "text")
    return texts.mapInPandas(run, "doc_id long, n_tokens long").where("n_tokens > 0")


def combinations(classes: int, depth: int) -> list[tuple[int, ...]]:
    """All ways to fill ``classes`` units with at most ``depth`` parts, largest first."""
    out: list[tuple[int, ...]] = []

    def go(left: int, most: int, parts: tuple[int, ...]) -> None:
        if left == 0:
            out.append(parts)
        elif len(parts) < depth:
            for p in range(min(left, most), 0, -1):
                if p * (depth - len(parts)) < left:
                    break
                go(left - p, p, (*parts, p))

    go(classes, classes, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Non-negative x of least |ax - b|, by the active-set method of Lawson and Hanson on the normal equations."""
    g, c = a.T @ a, a.T @ b
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    tol = 1e-9 * max(1.0, float(np.abs(c).max(initial=0.0)))
    for _ in range(rounds or 3 * a.shape[0]):
        w = c - g @ x
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tol:
            break
        passive[j] = True
        while True:
            p = passive.nonzero()[0]
            z = np.linalg.lstsq(g[np.ix_(p, p)], c[p], rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[p] = z
                break
            bad = z <= 0
            step = np.min(x[p][bad] / np.maximum(x[p][bad] - z[bad], 1e-300))
            x[p] += step * (z - x[p])
            drop = p[(x[p] <= 1e-12) & bad]
            if not len(drop):
                drop = p[bad]
            passive[drop] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def plan_containers(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Containers as ``(lengths, how many)`` that take every item of a histogram of lengths 1..capacity.

    Lengths are put into CLASSES classes by their upper bounds; combinations of up to DEPTH classes that fill
    the window get repeat counts by non-negative least squares against the histogram, rounded down. Their
    items are drawn from the classes, longest first. What remains is packed greedily, longest first into the
    container with the least sufficient room, so it also closes the gaps of the first step. Work and result
    depend on the capacity and the lengths that occur, not on the number of items.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    q = min(CLASSES, capacity)
    cls = {k: -(-k * q // capacity) for k in left}
    count = np.zeros(q + 1)
    for k, v in left.items():
        count[cls[k]] += v
    combos = combinations(q, DEPTH)
    a = np.zeros((q, len(combos)))
    for j, parts in enumerate(combos):
        for p in parts:
            a[p - 1, j] += 1
    # weights by length: leftover long items cost more than short ones
    wt = np.sqrt(np.arange(1, q + 1) / q)[:, None]
    x = np.floor(nnls(a * wt, count[1:] * wt[:, 0]) + 1e-6).astype(np.int64)
    by_class: dict[int, list[list[int]]] = {}
    for k in sorted(left, reverse=True):
        by_class.setdefault(cls[k], []).append([k, left[k]])
    rooms: list[int] = []
    open_: dict[int, list[list]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        room = capacity - sum(lengths)
        if room == 0:
            done.append((lengths, n))
            return
        if room not in open_:
            insort(rooms, room)
            open_[room] = []
        open_[room].append([lengths, n])

    for j in np.argsort(-x, kind="stable"):
        n = int(x[j])
        if n <= 0:
            break
        parts = combos[j]
        while n > 0:
            heads, lim, need = [], n, {}
            for p in parts:
                need[p] = need.get(p, 0) + 1
            ok = True
            for p, times in need.items():
                runs = by_class.get(p, [])
                if sum(r[1] for r in runs[:times]) < times:
                    ok = False
                    break
                if runs[0][1] >= times:
                    heads += [runs[0][0]] * times
                    lim = min(lim, runs[0][1] // times)
                else:
                    taken = 0
                    for r in runs:
                        t = min(r[1], times - taken)
                        heads += [r[0]] * t
                        taken += t
                        if taken == times:
                            break
                    lim = 1
            if not ok:
                break
            use: dict[int, int] = {}
            for k in heads:
                use[k] = use.get(k, 0) + 1
            for p in need:
                for r in by_class[p]:
                    if r[0] in use:
                        r[1] -= use[r[0]] * lim
                by_class[p] = [r for r in by_class[p] if r[1] > 0]
            put(tuple(sorted(heads, reverse=True)), lim)
            n -= lim
    for k, n in sorted(((r[0], r[1]) for runs in by_class.values() for r in runs), reverse=True):
        while n > 0:
            at = bisect_left(rooms, k)
            if at == len(rooms):
                times = capacity // k
                if n >= times:
                    put((k,) * times, n // times)
                    n %= times
                if n:
                    put((k,) * n, 1)
                    n = 0
                continue
            room = rooms[at]
            lengths, m = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            times = min(room // k, n)
            full = min(m, n // times)
            if m > full:
                put(lengths, m - full)
            put(lengths + (k,) * times, full)
            n -= full * times
    return done + [(t[0], t[1]) for room in rooms for t in open_[room]]


def pack(documents: DataFrame, specs: DataFrame, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(spec_id, container_id, position, doc_id, piece, start_token, n_tokens)``: every token of every text once per spec.

    A text goes undivided into one container unless it alone exceeds the capacity; then it is cut into full
    containers and a rest. Null, empty and blank texts have no tokens to place; specs without a positive
    capacity are dropped; empty tables give an empty result; other columns are ignored.

    Only a histogram reaches the driver, at most ``capacity`` rows per spec, and the plan that goes back has
    one row per run of equal containers. Items are numbered within (length, slice) and slices by their counts,
    so a length of many items, such as the full pieces of long texts, is many tasks.
    """
    spark: SparkSession = documents.sparkSession
    sizes = materialize(token_counts(documents, tokenizer), "p6-sizes").df
    todo = {r.spec_id: int(r.capacity_tokens) for r in specs.where("spec_id is not null and capacity_tokens > 0").select("spec_id", "capacity_tokens").toLocalIterator()}
    full = F.floor(F.col("n_tokens") / F.col("capacity"))
    pieces = F.when(F.col("n_tokens") <= F.col("capacity"), F.lit(1)).otherwise(F.ceil(F.col("n_tokens") / F.col("capacity"))).cast("int")
    caps = F.array(*[F.struct(F.lit(i).alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for i, c in todo.items()]) if todo else F.expr("cast(array() as array<struct<spec_id: int, capacity: bigint>>)")
    items = sizes.select("doc_id", "n_tokens", F.inline(caps))
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    items = items.select(
        "spec_id", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start_token"),
        F.when(F.col("piece") < full, F.col("capacity")).otherwise(F.col("n_tokens") - F.col("piece") * F.col("capacity")).alias("n_tokens"),
    )
    hist: dict[int, dict[int, int]] = {s: {} for s in todo}
    for r in items.groupBy("spec_id", "n_tokens").count().toLocalIterator():
        hist[r.spec_id][int(r.n_tokens)] = int(r["count"])
    # lengths with more items than one task numbers, at most as many rows as there are items over SLICE_ROWS
    many = [(s, k, -(-n // SLICE_ROWS)) for s, h in hist.items() for k, n in h.items() if n > SLICE_ROWS]
    cuts = spark.createDataFrame(many, "spec_id int, n_tokens long, cuts long")
    key = ["spec_id", "n_tokens", "slice"]
    items = items.join(F.broadcast(cuts), ["spec_id", "n_tokens"], "left").withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.coalesce("cuts", F.lit(1))).cast("int")).drop("cuts")
    counts = items.groupBy(*key).count()
    plan: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for s, cap in todo.items():
        base, used = 0, {}
        for lengths, n in plan_containers(hist[s], cap):
            for pos, k in enumerate(lengths):
                start = used.get(k, 0)
                plan.setdefault((s, k), []).append((start, base, pos))
                used[k] = start + n
            base += n
    offsets = counts.withColumn("before", F.sum("count").over(W.partitionBy("spec_id", "n_tokens").orderBy("slice")) - F.col("count")).drop("count")
    ranked = items.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(offsets, key).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays = {k: np.array(v, dtype=np.int64) for k, v in plan.items()}
        for b in batches:
            out = []
            for (s, k), g in b.groupby(["spec_id", "n_tokens"], sort=False):
                p = arrays[s, k]
                at = np.searchsorted(p[:, 0], g["rank"].to_numpy(), side="right") - 1
                out.append(g.assign(container_id=p[at, 1] + g["rank"].to_numpy() - p[at, 0], position=p[at, 2]))
            if out:
                yield pd.concat(out)[["spec_id", "container_id", "position", "doc_id", "piece", "start_token", "n_tokens"]]

    cols = ["spec_id", "doc_id", "piece", "start_token", "n_tokens", "rank"]
    return ranked.select(*cols).mapInPandas(place, "spec_id int, container_id long, position int, doc_id long, piece int, start_token long, n_tokens long")


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """``(spec_id, capacity_tokens, containers, tokens, fill, enough)`` per spec; fill is the share of all room that is used.

    ``enough`` tells whether that is FILL_FLOOR at least, or whether the containers are as few as the tokens allow.
    """
    t = packed.groupBy("spec_id").agg((F.max("container_id") + 1).alias("containers"), F.sum("n_tokens").alias("tokens"))
    return t.join(specs.select("spec_id", "capacity_tokens"), "spec_id").select(
        "spec_id", "capacity_tokens", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"),
        ((F.col("tokens") >= FILL_FLOOR * F.col("containers") * F.col("capacity_tokens")) | (F.col("containers") == F.ceil(F.col("tokens") / F.col("capacity_tokens")))).alias("enough"))

"""The evidence graph: thoughts with weighted charges, trust, propagation, tensions, blind spots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.functions.scalars import DAY_NS, longs_of, meta, recency
from sparkloom.operators.graph import Graph, k_hop, steps
from sparkloom.runtime import materialize

# Fixed values of the model.
BASE_TRUST = 0.1
VALENCE_STEP, VALENCE_EPS, MAX_ITER = 0.5, 1e-4, 100
#: Rounds of a propagation that are one plan; convergence is looked at after them.
ROUNDS = 4
DECAY = 0.7
INFLUENCE_EPS = 1e-6
TENSION_MAGNITUDE = TENSION_DELTA = 0.5
TENSION_CAP, FACET_CAP = 25, 10
HIGH_MAGNITUDE, HIGH_CONSISTENCY = 1.5, 0.8
STALE_DAYS, REVERSAL_DAYS, REVERSAL_MASS = 7, 30, 6.0
TOPIC_MIN, TOPIC_DRIFT = 5, 0.20
THOUGHT_LINKS = ["relates-to", "supports", "contradicts", "informed-by"]


def leading_number(c: Column) -> Column:
    """The number a text begins with, 0 where it begins with none."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def thoughts(g: Graph) -> DataFrame:
    return g.live.where("type = 'thought'")


def charges(g: Graph) -> DataFrame:
    """``(thought, charge, polarity, weight, created_at, updated_at)``: live charges of live thoughts, each pair once."""
    c = g.live.where("type = 'charge'").select(F.col("id").alias("charge"), meta("polarity").alias("polarity"), leading_number(meta("weight")).alias("weight"), "created_at", "updated_at")
    e = g.edges.where("type = 'charged-by'").select(F.col("from_id").alias("thought"), F.col("to_id").alias("charge")).distinct()
    return e.join(c, "charge").join(thoughts(g).select(F.col("id").alias("thought")), "thought", "left_semi")


def _props(d: DataFrame) -> DataFrame:
    """Valence, magnitude, consistency and self-trust from positive and negative sums ``p, n`` and ``charges``."""
    t = F.col("p") + F.col("n")
    d = d.withColumns({
        "valence": F.when(t > 0, (F.col("p") - F.col("n")) / t).otherwise(F.lit(0.0)),
        "magnitude": F.when(t > 0, F.log1p(t)).otherwise(F.lit(0.0)),
        "consistency": F.when(t > 0, 1 - F.least("p", "n") / F.greatest("p", "n")).otherwise(F.lit(0.0)),
    })
    return d.withColumn("self_trust", BASE_TRUST + F.col("consistency") * F.log1p(F.col("charges").cast("double")))


def fold(g: Graph, now_ns: int, ch: DataFrame | None = None) -> DataFrame:
    """``(id, p, n, charges, valence, magnitude, consistency, self_trust)`` of every thought; charges of another polarity only count."""
    ch = charges(g) if ch is None else ch
    w = F.col("weight") * recency(now_ns, F.col("updated_at"))
    s = ch.groupBy(F.col("thought").alias("id")).agg(
        F.sum(F.when(F.col("polarity") == "positive", w).otherwise(F.lit(0.0))).alias("p"), F.sum(F.when(F.col("polarity") == "negative", w).otherwise(F.lit(0.0))).alias("n"), F.count(F.lit(1)).alias("charges"))
    d = thoughts(g).select("id").join(s, "id", "left").fillna({"p": 0.0, "n": 0.0, "charges": 0})
    return _props(d)


def trust_matrix(g: Graph, folded: DataFrame) -> DataFrame:
    """Row-stochastic ``(i, j, w)``: neighbours weigh 1, the diagonal the self-trust."""
    ids = folded.select("id")
    nb = steps(g.edges, "both", THOUGHT_LINKS).where("a <> b").join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    m = nb.select(F.col("a").alias("i"), F.col("b").alias("j"), F.lit(1.0).alias("w")).unionByName(folded.select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("self_trust").alias("w")))
    s = m.groupBy("i").agg(F.sum("w").alias("t"))
    return m.join(s, "i").select("i", "j", F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(F.lit(1.0)).alias("w"))


def propagate_valence(matrix: DataFrame, start: DataFrame, *, max_iter: int = MAX_ITER, eps: float = VALENCE_EPS) -> tuple[DataFrame, int, bool]:
    """Repeats v <- v/2 + Tv/2 until no value moves by eps: (values ``(id, v)``, rounds, converged). ROUNDS rounds are one plan and are written once."""
    m = materialize(matrix, "trust").df
    v = materialize(start.select("id", "v"), "valence")
    k = 0
    while k < max_iter:
        cur = v.df.select("id", "v")
        for _ in range(min(ROUNDS, max_iter - k)):
            tv = m.join(cur.select(F.col("id").alias("j"), "v"), "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("w") * F.col("v")).alias("t"))
            cur = cur.select("id", "v").join(tv, "id").select("id", (VALENCE_STEP * F.col("v") + (1 - VALENCE_STEP) * F.col("t")).alias("v"), F.abs((1 - VALENCE_STEP) * (F.col("t") - F.col("v"))).alias("d"))
            k += 1
        n = materialize(cur, "valence")
        v.drop()
        v = n
        if (n.df.agg(F.max("d")).first()[0] or 0.0) < eps:
            return n.df.select("id", "v"), k, True
    return v.df.select("id", "v"), max_iter, False


def propagate_magnitude(matrix: DataFrame, local: DataFrame, *, max_iter: int = MAX_ITER, eps: float = VALENCE_EPS) -> DataFrame:
    """``(id, m)``: fixpoint of m = max(local, 0.7 max of the neighbours); the order of updates does not matter to it."""
    nb = materialize(matrix.where("i <> j").select("i", "j"), "near").df
    m = materialize(local.select("id", "m"), "magnitude")
    for _ in range(max_iter):
        best = nb.join(m.df.withColumnRenamed("id", "j"), "j").groupBy(F.col("i").alias("id")).agg((DECAY * F.max("m")).alias("b"))
        n = materialize(m.df.join(best, "id", "left").select("id", F.greatest("m", F.coalesce("b", F.lit(0.0))).alias("m"), F.greatest(F.lit(0.0), F.coalesce("b", F.lit(0.0)) - F.col("m")).alias("d")), "magnitude")
        m.drop()
        m = n
        if (n.df.agg(F.max("d")).first()[0] or 0.0) < eps:
            break
    return m.df.select("id", "m")


def influence(matrix: DataFrame, *, max_iter: int = MAX_ITER, eps: float = INFLUENCE_EPS) -> DataFrame:
    """``(id, influence)``: left eigenvector of the trust matrix by power iteration, entries summing to 1."""
    m = materialize(matrix, "trust").df
    n = m.select("i").distinct().count()
    if not n:
        return m.select(F.col("i").alias("id"), F.lit(0.0).alias("influence"))
    x = materialize(m.select(F.col("i").alias("id")).distinct().withColumn("x", F.lit(1.0 / n)), "influence")
    k = 0
    while k < max_iter:
        cur = x.df.select("id", "x")
        for _ in range(min(ROUNDS, max_iter - k)):  # one plan; the length is set right after it
            y = m.join(cur.select(F.col("id").alias("i"), "x"), "i").groupBy(F.col("j").alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("y"))
            cur = cur.select("id", "x").join(y, "id", "left").select("id", F.coalesce("y", F.lit(0.0)).alias("x"), F.abs(F.coalesce("y", F.lit(0.0)) - F.col("x")).alias("d"))
            k += 1
        nx = materialize(cur, "influence")
        x.drop()
        r = nx.df.agg(F.sum("x").alias("s"), F.max("d").alias("d")).first()
        x = nx if not r.s else type(nx)(nx.df.select("id", (F.col("x") / F.lit(r.s)).alias("x")), nx.path)
        if r.d < eps:
            break
    return x.df.select("id", F.col("x").alias("influence"))


def personality(matrix: DataFrame, clusters: DataFrame, scale: DataFrame, defaults: DataFrame) -> DataFrame:
    """Trust rows scaled by ``(cluster_a, cluster_b, factor)``, else by the row default ``(cluster_a, factor)``, and normalised again."""
    c = clusters.select("id", "cluster")
    m = matrix.join(c.select(F.col("id").alias("i"), F.col("cluster").alias("cluster_a")), "i", "left").join(c.select(F.col("id").alias("j"), F.col("cluster").alias("cluster_b")), "j", "left")
    m = m.join(scale.withColumnRenamed("factor", "f1"), ["cluster_a", "cluster_b"], "left").join(defaults.withColumnRenamed("factor", "f0"), "cluster_a", "left")
    m = m.withColumn("w", F.col("w") * F.coalesce("f1", "f0", F.lit(1.0))).select("i", "j", "w")
    s = m.groupBy("i").agg(F.sum("w").alias("t"))
    return m.join(s, "i").select("i", "j", F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise((F.col("i") == F.col("j")).cast("double")).alias("w"))


def tensions(g: Graph, now_ns: int, method: str | None = "human", cap: int = TENSION_CAP) -> DataFrame:
    """Linked thoughts of strong and opposed valence; the greatest difference per pair of clusters, ranked by it times 1 + distinct evidence."""
    f = fold(g, now_ns).select("id", "valence", "magnitude")
    e = g.edges.where(F.col("type").isin(*THOUGHT_LINKS) & (F.col("from_id") != F.col("to_id")))
    if method:
        e = e.where(F.col("method") == method)
    p = e.select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).distinct()
    side = lambda x: f.join(thoughts(g).select("id", meta("cluster_id").alias("c")), "id").select(F.col("id").alias(x), F.col("valence").alias(f"v{x}"), F.col("magnitude").alias(f"m{x}"), F.when(F.col("c") == "", F.concat(F.lit("thought:"), "id")).otherwise(F.col("c")).alias(f"c{x}"))
    d = p.join(side("a"), "a").join(side("b"), "b").withColumn("delta", F.abs(F.col("va") - F.col("vb")))
    d = d.where((F.col("ma") >= TENSION_MAGNITUDE) & (F.col("mb") >= TENSION_MAGNITUDE) & (F.col("delta") >= TENSION_DELTA))
    ch = charges(g).select(F.col("thought"), "charge")
    ev = d.select("a", "b", F.explode(F.array("a", "b")).alias("thought")).join(ch, "thought").groupBy("a", "b").agg(F.countDistinct("charge").alias("evidence"))
    d = d.join(ev, ["a", "b"], "left").withColumn("evidence", F.coalesce("evidence", F.lit(0)))
    key = [F.least("ca", "cb").alias("ka"), F.greatest("ca", "cb").alias("kb")]
    best = d.groupBy(*key).agg(F.count(F.lit(1)).alias("pairs"), F.min(F.struct((-F.round("delta", 9)).alias("d"), "a", "b", "evidence")).alias("x"))
    r = best.select("ka", "kb", "pairs", "x.a", "x.b", F.round(-F.col("x.d"), 6).alias("delta"), F.col("x.evidence").alias("evidence"), F.round(-F.col("x.d") * (1 + F.col("x.evidence")), 6).alias("score"))
    return r.orderBy(F.desc("score"), "a", "b").limit(cap) if cap else r


def influence_ranking(folded: DataFrame, infl: DataFrame, limit: int = 10, sort: str = "influence") -> DataFrame:
    """Evidenced thoughts by influence times 1 + weights (or magnitude: ``composite``), the rest by influence alone; each section cut."""
    d = folded.join(infl, "id").withColumn("section", F.when(F.col("charges") > 0, F.lit("evidenced")).otherwise(F.lit("backfill")))
    s = F.col("influence") * (F.col("magnitude") if sort == "composite" else 1 + F.col("p") + F.col("n"))
    d = d.withColumn("score", F.round(F.when(F.col("charges") > 0, s).otherwise(F.col("influence")), 12)).withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(16)))
    by = [F.desc("score"), "id"]
    d = d.withColumn("_r", F.row_number().over(W.partitionBy("section", "_s").orderBy(*by))).where(F.col("_r") <= limit)
    return d.withColumn("rank", F.row_number().over(W.partitionBy("section").orderBy(*by))).where(F.col("rank") <= limit).select("section", "rank", "id", "score")


def reversals(ch: DataFrame, key: list[str], now_ns: int) -> DataFrame:
    """``(*key, old_net, recent_net)``: raw signed weight before and after now - 30 days; charges without an instant are skipped."""
    cut = now_ns - REVERSAL_DAYS * DAY_NS
    w = F.when(F.col("polarity") == "negative", -F.col("weight")).when(F.col("polarity") == "positive", F.col("weight"))
    d = ch.where(F.col("created_at") != 0)
    return d.groupBy(*key).agg(F.coalesce(F.sum(F.when(F.col("created_at") < cut, w)), F.lit(0.0)).alias("old_net"), F.coalesce(F.sum(F.when(F.col("created_at") >= cut, w)), F.lit(0.0)).alias("recent_net"))


def reversed_sign() -> Column:
    return (F.col("old_net") != 0) & (F.col("recent_net") != 0) & ((F.col("old_net") < 0) != (F.col("recent_net") < 0))


def cluster_reversals(g: Graph, now_ns: int, cap: int = FACET_CAP) -> DataFrame:
    c = thoughts(g).where(meta("cluster_id") != "").select(F.col("id").alias("thought"), meta("cluster_id").alias("cluster"))
    r = reversals(charges(g).join(c, "thought"), ["cluster"], now_ns).where(reversed_sign() & (F.abs("old_net") >= REVERSAL_MASS))
    r = r.select("cluster", F.round("old_net", 6).alias("old_net"), F.round("recent_net", 6).alias("recent_net"))
    return r.orderBy(F.desc(F.abs("old_net")), "cluster").limit(cap) if cap else r


def fragile(g: Graph, now_ns: int) -> DataFrame:
    """Thoughts of at most one charge, or whose valence changes its sign when one charge is left out: sums less the charge, without a self-join."""
    w = F.col("weight") * recency(now_ns, F.col("updated_at"))
    ch = charges(g).withColumns({"cp": F.when(F.col("polarity") == "positive", w).otherwise(F.lit(0.0)), "cn": F.when(F.col("polarity") == "negative", w).otherwise(F.lit(0.0))})
    s = ch.groupBy("thought").agg(F.sum("cp").alias("p"), F.sum("cn").alias("n"), F.count(F.lit(1)).alias("k"))
    x = ch.join(s, "thought").withColumn("before", F.signum(F.round(F.col("p") - F.col("n"), 12))).withColumn("after", F.signum(F.round((F.col("p") - F.col("cp")) - (F.col("n") - F.col("cn")), 12)))
    per = x.groupBy(F.col("thought").alias("id")).agg(F.max((F.expr("before <> 0 and after <> 0 and before <> after")).cast("int")).alias("flip"), F.count(F.lit(1)).alias("k"))
    return thoughts(g).select("id").join(per, "id", "left").where("coalesce(k, 0) <= 1 or flip = 1").select("id")


def cited_code(g: Graph) -> DataFrame:
    """Greatest updated_at of live code a thought refers to: ``(id, code_at)``."""
    code = g.live.where("type in ('file', 'function', 'method', 'type')").select(F.col("id").alias("to_id"), "updated_at")
    e = g.edges.join(thoughts(g).select(F.col("id").alias("from_id")), "from_id", "left_semi").join(code, "to_id")
    return e.groupBy(F.col("from_id").alias("id")).agg(F.max("updated_at").alias("code_at"))


def machine_made() -> Column:
    return F.col("source").startswith("machine") | F.lower("symbol_name").rlike("^(auto|exported)")


def human_thoughts(g: Graph) -> DataFrame:
    """Ids of the thoughts that no machine made."""
    return thoughts(g).where(~machine_made()).select("id")


def blind_spots(g: Graph, now_ns: int, infl: DataFrame | None = None, cap: int | None = FACET_CAP) -> DataFrame:
    """``(facet, id)`` of thoughts that are not machine-made; a thought may match several facets."""
    ch = charges(g)
    newest = ch.groupBy(F.col("thought").alias("id")).agg(F.max("updated_at").alias("newest"))
    rev = reversals(ch, ["thought"], now_ns).where(reversed_sign()).select(F.col("thought").alias("id"), F.lit(True).alias("rev"))
    d = fold(g, now_ns).join(thoughts(g).where(~machine_made()).select("id"), "id", "left_semi").join(newest, "id", "left").join(rev, "id", "left").join(cited_code(g), "id", "left").join(fragile(g, now_ns).withColumn("frag", F.lit(True)), "id", "left")
    d = d.join(infl, "id", "left") if infl is not None else d.withColumn("influence", F.lit(1.0))
    facets = F.filter(F.array(
        F.when((F.col("magnitude") >= HIGH_MAGNITUDE) & (F.col("consistency") >= HIGH_CONSISTENCY) & (F.col("charges") <= 1), F.lit("confident_untested")),
        F.when((F.coalesce("influence", F.lit(0.0)) > 0) & (F.col("charges") == 0), F.lit("foundational_unexamined")),
        F.when(F.col("frag"), F.lit("fragile_single_point")),
        F.when(F.col("newest") < now_ns - STALE_DAYS * DAY_NS, F.lit("stale_confidence")),
        F.when(F.coalesce("code_at", F.lit(0)) > F.col("newest"), F.lit("code_changed")),
        F.when(F.col("rev"), F.lit("belief_reversal")),
    ), lambda x: x.isNotNull())
    r = d.select(F.explode(facets).alias("facet"), "id", F.round("magnitude", 9).alias("magnitude"))
    if cap is None:
        return r.select("facet", "id")
    by = [F.desc("magnitude"), "id"]
    r = r.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(16))).withColumn("_r", F.row_number().over(W.partitionBy("facet", "_s").orderBy(*by))).where(F.col("_r") <= cap)
    return r.withColumn("_r", F.row_number().over(W.partitionBy("facet").orderBy(*by))).where(F.col("_r") <= cap).select("facet", "id")


def simulate(g: Graph, now_ns: int, action: str, target: str, *, polarity: str = "positive", weight: float = 1.0) -> DataFrame:
    """``(id, state, ...)`` before and after: ``remove`` a charge, ``add`` a charge of a raw weight to a thought, or ``invalidate`` a thought."""
    ch = charges(g)
    cols = ["id", "p", "n", "charges", "valence", "magnitude", "consistency", "self_trust"]
    if action == "remove":
        hit = ch.where(F.col("charge") == target).select(F.col("thought").alias("id")).distinct()
        before, after = fold(g, now_ns, ch).join(hit, "id", "left_semi"), fold(g, now_ns, ch.where(F.col("charge") != target)).join(hit, "id", "left_semi")
    else:
        before = fold(g, now_ns, ch).where(F.col("id") == target)
        if action == "add":
            if polarity not in ("positive", "negative"):
                raise ValueError(f"bad polarity {polarity!r}")
            side = "p" if polarity == "positive" else "n"
            after = _props(before.select("id", "p", "n", "charges").withColumn(side, F.col(side) + weight).withColumn("charges", F.col("charges") + 1))
        elif action == "invalidate":
            z = F.lit(0.0)
            after = before.select("id", z.alias("p"), z.alias("n"), F.lit(0).cast("long").alias("charges"), F.lit(-1.0).alias("valence"), z.alias("magnitude"), z.alias("consistency"), F.lit(BASE_TRUST).alias("self_trust"))
        else:
            raise ValueError(f"unknown action {action!r}")
    return before.select(F.lit("before").alias("state"), *cols).unionByName(after.select(F.lit("after").alias("state"), *cols))


def trace(g: Graph, start: DataFrame, direction: str = "both", depth: int = 5, types: list[str] | None = None) -> DataFrame:
    return k_hop(g, start, direction, types or THOUGHT_LINKS, depth)


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """Majority bits of the 32-byte vectors of every cluster: ``(key, centroid)``; a bit is set in more than half. Counts are combined before the shuffle."""
    v = vectors.where(F.octet_length("vector") == 32).select(key, longs_of(F.col("vector")).alias("x"))
    bits = [F.sum(F.shiftrightunsigned(F.col("x")[i // 64], 63 - i % 64).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(256)]
    c = v.groupBy(key).agg(F.count(F.lit(1)).alias("k"), *bits)
    h = F.concat(*[F.lpad(F.hex(sum((F.when(2 * F.col(f"b{8 * j + i}") > F.col("k"), F.lit(1 << (7 - i))).otherwise(F.lit(0)) for i in range(1, 8)), F.when(2 * F.col(f"b{8 * j}") > F.col("k"), F.lit(128)).otherwise(F.lit(0)))), 2, "0") for j in range(32)])
    return c.select(key, F.unhex(h).alias("centroid"))


def medoids(vectors: DataFrame, cents: DataFrame, key: str) -> DataFrame:
    """Member most similar to the centroid of its cluster, the smallest id first."""
    from sparkloom.functions.scalars import hamming

    d = vectors.join(cents, key).withColumn("d", hamming(F.col("vector"), F.col("centroid"))).where(F.col("d").isNotNull())
    return d.groupBy(key).agg(F.min(F.struct("d", "id")).alias("x")).select(key, F.col("x.id").alias("medoid"), F.col("x.d").alias("distance"))


def topic_rollup(clusters: DataFrame, topic_of: DataFrame) -> DataFrame:
    """Clusters ``(cluster, size)`` merged by topic label ``(cluster, topic)``; a cluster without one is its own topic."""
    return clusters.join(topic_of, "cluster", "left").groupBy(F.coalesce("topic", "cluster").alias("topic")).agg(F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("size"))


def topic_lifecycle(topics: DataFrame) -> DataFrame:
    """``create`` for topics of five or more without a summary, ``refresh`` where the centroid drifted by more than a fifth, else ``keep``; input ``(topic, size, has_summary, drift)``."""
    return topics.select("topic", F.when(~F.col("has_summary") & (F.col("size") >= TOPIC_MIN), F.lit("create")).when(F.col("has_summary") & (F.coalesce("drift", F.lit(0.0)) > TOPIC_DRIFT), F.lit("refresh")).otherwise(F.lit("keep")).alias("action"))


def charges_of(g: Graph) -> DataFrame:
    """Charges per thought as one text of sorted ids; a thought's charges are gathered per thought only."""
    return charges(g).groupBy(F.col("thought").alias("id")).agg(F.count(F.lit(1)).alias("charges"), F.array_join(F.array_sort(F.collect_set("charge")), ",").alias("ids"))


def lineage(g: Graph, start: DataFrame, hops: int = 10) -> DataFrame:
    """Up to ``hops`` steps upward from every start: at each the first of incoming contains, incoming implements, outgoing informed-by (smallest id)."""
    up = lambda t, a, b, p: g.edges.where(F.col("type") == t).select(F.col(a).alias("id"), F.struct(F.lit(p).alias("p"), F.col(b).alias("up")).alias("x"))
    nxt = up("contains", "to_id", "from_id", 0).unionByName(up("implements", "to_id", "from_id", 1)).unionByName(up("informed-by", "from_id", "to_id", 2))
    nxt = materialize(nxt.join(g.live.select(F.col("id").alias("_u")), F.col("x.up") == F.col("_u"), "left_semi").groupBy("id").agg(F.min("x").alias("x")).select("id", F.col("x.up").alias("up")), "lineage").df
    now = materialize(start.select(F.col("id").alias("start"), "id").withColumn("hop", F.lit(0)), "lineage")
    for k in range(1, hops + 1):
        step = now.df.where(F.col("hop") == k - 1).join(nxt, "id").select("start", F.col("up").alias("id"), F.lit(k).alias("hop")).join(now.df.select("start", "id"), ["start", "id"], "left_anti")
        new = materialize(now.df.unionByName(step.select("start", "id", "hop")), "lineage")
        stop = new.df.where(F.col("hop") == k).isEmpty()
        now.drop()
        now = new
        if stop:
            break
    return now.df


def summary(g: Graph, now_ns: int) -> DataFrame:
    """One row: thoughts, charged thoughts, mean valence and greatest magnitude."""
    f = fold(g, now_ns)
    return f.agg(F.count(F.lit(1)).alias("thoughts"), F.sum((F.col("charges") > 0).cast("long")).alias("charged"), F.round(F.avg("valence"), 6).alias("valence"), F.round(F.max("magnitude"), 6).alias("magnitude"))


def recall(g: Graph, now_ns: int, *, min_valence: float = -1.0, min_magnitude: float = 0.0, status: str | None = None, since_ns: int | None = None, limit: int = 20) -> DataFrame:
    """Thoughts filtered by evidence, status and time, the newest first; at most 50."""
    d = thoughts(g).join(fold(g, now_ns), "id").where((F.col("valence") >= min_valence) & (F.col("magnitude") >= min_magnitude))
    if status is not None:
        d = d.where(F.col("status") == status)
    if since_ns is not None:
        d = d.where(F.col("updated_at") >= since_ns)
    return d.orderBy(F.desc("updated_at"), "id").limit(min(limit, 50)).select("id", "symbol_name", F.round("valence", 6).alias("valence"), F.round("magnitude", 6).alias("magnitude"))

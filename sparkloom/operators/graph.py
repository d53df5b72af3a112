"""The relational layer of the property graph: browse, predicates, traversal, joins, pivots, timelines, statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.functions.scalars import meta, parse_instant
from sparkloom.runtime import materialize

NODE_TEXTS = "type symbol_name file_path language content signature summary description source status keywords test_kind".split()
PROJECTION_KEYS = ("id type symbol_name file_path language start_line end_line content signature summary description source status metadata created_at updated_at keywords "
                   "is_exported is_test test_kind tombstoned_at graph graph_instance score").split()
DIRECTIONS = ("out", "in", "both")
DEFAULT_BROWSE, SEARCH_CLAMP = 10, 50
UNSETTLED = ("", "open", "active", "pending", "in_progress")


@dataclass
class Graph:
    """Normalised nodes and edges: latest row per id, no nulls, edges distinct."""

    nodes: DataFrame
    edges: DataFrame

    @property
    def live(self) -> DataFrame:
        return self.nodes.where("tombstoned_at = 0")


def load(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Of repeated rows of an id the one with the greatest updated_at counts; nulls become empty, 0 or false; edges without an end go."""
    n = nodes.where("id is not null")
    n = n.withColumn("_rn", F.row_number().over(W.partitionBy("id").orderBy(F.desc("updated_at"), F.desc("tombstoned_at")))).where("_rn = 1").drop("_rn")
    n = n.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in NODE_TEXTS} | {c: F.coalesce(F.col(c), F.lit(0)) for c in ("start_line", "end_line")}
                      | {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("created_at", "updated_at", "tombstoned_at")}
                      | {c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_exported", "is_test")}
                      | {"metadata": F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))})
    e = edges.where("from_id is not null and to_id is not null").select(
        "from_id", "to_id", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("method", F.lit("")).alias("method"), F.coalesce("evidence", F.lit("")).alias("evidence"), F.coalesce("last_validated", F.lit(0).cast("long")).alias("last_validated")).distinct()
    return Graph(n, e)


# --- predicates -------------------------------------------------------------------------------
def metadata_predicate(wanted: dict[str, str]) -> Column:
    """All keys must match: ``*`` is any value of a present key, else the values are equal."""
    p = F.lit(True)
    for k, v in wanted.items():
        p = p & (F.map_contains_key("metadata", F.lit(k)) if v == "*" else meta(k) == v)
    return p


def field_predicate(fields: list[tuple[str, str, object]]) -> Column:
    """``(field, op, value)`` with op EQ, EXISTS or GTE, all of which must hold."""
    p = F.lit(True)
    for f, op, v in fields:
        if f not in PROJECTION_KEYS:
            raise ValueError(f"unknown field {f!r}")
        c = F.col(f)
        if op == "EQ":
            p = p & (c == F.lit(v))
        elif op == "EXISTS":
            p = p & (c.cast("string") != "")
        elif op == "GTE":
            p = p & (c >= F.lit(v))
        else:
            raise ValueError(f"unknown operator {op!r}")
    return p


def project(d: DataFrame, keys: list[str]) -> DataFrame:
    """Columns by name in the order asked for; an unknown name is refused."""
    bad = [k for k in keys if k not in PROJECTION_KEYS or k not in d.columns]
    if bad:
        raise ValueError(f"unknown keys {bad}")
    return d.select(*keys)


def resolve_edge_types(edges: DataFrame, want: list[str]) -> list[str]:
    """Stored spellings of edge types asked for in any case; unknown or ambiguous ones are refused. Only spellings of what is asked for are read."""
    vocab = {r.type for r in edges.where(F.lower("type").isin(*[w.lower() for w in want])).select("type").distinct().toLocalIterator()} if want else set()
    out = []
    for w in want:
        if w in vocab:
            out.append(w)
            continue
        hit = sorted(v for v in vocab if v.lower() == w.lower())
        if len(hit) != 1:
            raise ValueError(f"edge type {w!r} is {'ambiguous: ' + ', '.join(hit) if hit else 'unknown'}")
        out.append(hit[0])
    return out


def check_direction(direction: str) -> str:
    if direction not in DIRECTIONS:
        raise ValueError(f"bad direction {direction!r}; one of {DIRECTIONS}")
    return direction


def check_consumed(given: dict, consumed: set[str], mode: str) -> None:
    """Refuses parameters that a mode does not use."""
    extra = sorted(k for k, v in given.items() if v is not None and k not in consumed)
    if extra:
        raise ValueError(f"mode {mode!r} does not use {extra}")


# --- scans ------------------------------------------------------------------------------------
def browse(g: Graph, types: list[str], *, statuses: list[str] | None = None, metadata: dict[str, str] | None = None, fields: list[tuple[str, str, object]] | None = None,
           limit: int | None = DEFAULT_BROWSE, offset: int = 0, tombstones: bool = False) -> DataFrame:
    """Nodes of the types, by id; limit 0 is all."""
    d = (g.nodes if tombstones else g.live).where(F.col("type").isin(*types))
    if statuses:
        d = d.where(F.col("status").isin(*statuses))
    if metadata:
        d = d.where(metadata_predicate(metadata))
    if fields:
        d = d.where(field_predicate(fields))
    if not limit and not offset:
        return d
    d = d.orderBy("id").offset(offset)
    return d.limit(limit) if limit else d


def by_ids(g: Graph, ids: DataFrame, tombstones: bool = False) -> DataFrame:
    return (g.nodes if tombstones else g.live).join(ids.select("id").distinct(), "id", "left_semi")


def keyset_page(d: DataFrame, after: str, size: int) -> DataFrame:
    return d.where(F.col("id") > after).orderBy("id").limit(size)


def pivot_edges(g: Graph, ids: DataFrame) -> DataFrame:
    """Edges with an end among the ids, each once."""
    i = ids.select("id").distinct()
    a = g.edges.join(i.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    b = g.edges.join(i.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return a.unionByName(b.select(*a.columns)).distinct()


def banded_edges(g: Graph, types: list[str], bands: int) -> DataFrame:
    """Edges of the types, ranged by from_id into bands."""
    return g.edges.where(F.col("type").isin(*types)).repartitionByRange(bands, "from_id")


def totals(g: Graph) -> DataFrame:
    return g.live.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("kind"), "n").unionByName(g.edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("kind"), "n"))


# --- joins and traversal ----------------------------------------------------------------------
def steps(edges: DataFrame, direction: str, types: list[str] | None = None) -> DataFrame:
    """``(a, b)``: one step in the direction along edges of the types."""
    check_direction(direction)
    e = edges.where(F.col("type").isin(*types)) if types else edges
    out = e.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    back = e.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))
    return (out if direction == "out" else back if direction == "in" else out.unionByName(back)).distinct()


def _union(parts: list) -> DataFrame:
    out = parts[0].df
    for p in parts[1:]:
        out = out.unionByName(p.df)
    return out


def k_hop(g: Graph, start: DataFrame, direction: str = "out", types: list[str] | None = None, depth: int = 1, live_only: bool = True) -> DataFrame:
    """``(id, distance)`` of nodes within ``depth`` steps of the start ids, by their least distance; dangling ends are no nodes.

    Breadth first; every level joins only the frontier, drops what was seen and writes only what is new.
    """
    s = steps(g.edges, direction, types)
    ids = (g.live if live_only else g.nodes).select("id")
    levels = [materialize(start.select("id").distinct().join(ids, "id", "left_semi").withColumn("distance", F.lit(0)), "hop")]
    for k in range(1, depth + 1):
        front = levels[-1].df.select(F.col("id").alias("a"))
        nxt = s.join(front, "a", "left_semi").select(F.col("b").alias("id")).distinct().join(_union(levels).select("id"), "id", "left_anti").join(ids, "id", "left_semi")
        new = materialize(nxt.withColumn("distance", F.lit(k)), "hop")
        if new.df.isEmpty():
            new.drop()
            break
        levels.append(new)
    return _union(levels)


def closure(pairs: DataFrame, depth: int | None = None) -> DataFrame:
    """``(a, b, distance)``: transitive closure of ``(a, b)``, start excluded unless on a cycle, least distance; ``depth`` ends it after so many steps.

    Every level writes only the pairs that are new.
    """
    base = pairs.select("a", "b").distinct()
    levels = [materialize(base.withColumn("distance", F.lit(1)), "closure")]
    k = 1
    while depth is None or k < depth:
        k += 1
        front = levels[-1].df.select("a", F.col("b").alias("m"))
        nxt = front.join(base.withColumnRenamed("a", "m"), "m").select("a", "b").distinct().join(_union(levels).select("a", "b"), ["a", "b"], "left_anti")
        new = materialize(nxt.withColumn("distance", F.lit(k)), "closure")
        if new.df.isEmpty():
            new.drop()
            break
        levels.append(new)
    return _union(levels)


def analyzer_edges(g: Graph, types: list[str] | None = None) -> DataFrame:
    """``(src, dst, weight)``: edges between live nodes, loops dropped, one row for a pair with its greatest weight, weight 0 is 1."""
    e = g.edges.where(F.col("type").isin(*types)) if types else g.edges
    ids = g.live.select("id")
    e = e.where("from_id <> to_id").join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return e.groupBy(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).agg(F.max(F.when(F.col("weight") == 0, F.lit(1.0)).otherwise(F.col("weight"))).alias("weight"))


def hydrate_edges(g: Graph) -> DataFrame:
    """Edges with the names and types of their ends; a missing name is the id."""
    n = g.live.select("id", F.col("symbol_name").alias("name"), F.col("type").alias("kind"))
    name = lambda c, i: F.when(F.coalesce(c, F.lit("")) == "", i).otherwise(c)
    d = g.edges.join(n.select(F.col("id").alias("from_id"), F.col("name").alias("_fn"), F.col("kind").alias("from_type")), "from_id", "left")
    d = d.join(n.select(F.col("id").alias("to_id"), F.col("name").alias("_tn"), F.col("kind").alias("to_type")), "to_id", "left")
    return d.select("from_id", "to_id", "type", "weight", "confidence", "method", "evidence", name(F.col("_fn"), F.col("from_id")).alias("from_name"), name(F.col("_tn"), F.col("to_id")).alias("to_name"),
                    F.coalesce("from_type", F.lit("")).alias("from_type"), F.coalesce("to_type", F.lit("")).alias("to_type"))


def hydrate_hits(hits: DataFrame, g: Graph) -> DataFrame:
    """Ranked hits ``(id, score)`` with their nodes, misses dropped."""
    return hits.join(g.live.select("id", "type", "symbol_name", "file_path"), "id")


def overlay(base: DataFrame, over: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the overlay, and those of the base that it does not shadow."""
    return over.unionByName(base.join(over.select(key).distinct(), key, "left_anti").select(*over.columns))


def has_edge(g: Graph, d: DataFrame, edge_type: str, direction: str) -> DataFrame:
    end = "from_id" if check_direction(direction) == "out" else "to_id"
    return d.join(g.edges.where(F.col("type") == edge_type).select(F.col(end).alias("id")).distinct(), "id", "left_semi")


def unreachable(g: Graph, roots: DataFrame, types: list[str], kinds: list[str]) -> DataFrame:
    """Nodes of the kinds that no path from the roots along the edge types reaches."""
    seen = k_hop(g, roots, "out", types, depth=10_000)
    return g.live.where(F.col("type").isin(*kinds)).join(seen.select("id"), "id", "left_anti")


def by_position(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` with those of ``b`` at the same file and line."""
    return a.join(b, (a.file_path == b.path) & (a.start_line == b.line))


def candidate_groups(g: Graph) -> DataFrame:
    """Edges of an uncertain method by (from, evidence): members, declared size round(1/confidence), closed and complete; edges without evidence are groups of one."""
    e = g.edges.where(F.col("method").isin("ambiguous-name", "dynamic", "heuristic"))
    key = F.when(F.col("evidence") == "", F.concat_ws("\0", "to_id", "type")).otherwise(F.col("evidence"))
    d = e.withColumn("_k", key).groupBy("from_id", "_k").agg(F.count(F.lit(1)).alias("members"), F.max("confidence").alias("confidence"), F.min("method").alias("method"), F.max(F.col("evidence") == "").alias("single"))
    declared = F.when(F.col("confidence") > 0, F.round(1 / F.col("confidence"))).otherwise(F.lit(0)).cast("long")
    return d.select("from_id", F.when(F.col("single"), F.lit("")).otherwise(F.col("_k")).alias("evidence"), "members", "confidence", declared.alias("declared"), (F.col("method") == "ambiguous-name").alias("closed"), (F.col("members") == declared).alias("complete"))


def shared_artifact_groups(members: DataFrame, existing: DataFrame, per: str = "artifact") -> DataFrame:
    """``(artifact, thought, members, links)``: the thoughts that share an artifact, as groups.

    Input ``(artifact, thought)`` pairs. All members of an artifact are linked to one another unless they are joined
    already, in either direction: ``links`` counts a member's partners that are not. An artifact of any number of
    members is as many rows, counted before the shuffle; its pairs are never expanded. An artifact of one member and
    members without a partner left stay with 0 links; nulls are no members.
    """
    m = members.select(per, "thought").where(F.col(per).isNotNull() & F.col("thought").isNotNull()).distinct()
    x = existing.where("from_id <> to_id").select(F.col("from_id").alias("thought"), F.col("to_id").alias("other"))
    x = x.unionByName(x.select(F.col("other").alias("thought"), F.col("thought").alias("other"))).distinct()
    joined = x.join(m, "thought").join(m.select(per, F.col("thought").alias("other")), [per, "other"]).groupBy(per, "thought").agg(F.count(F.lit(1)).alias("joined"))
    d = m.join(m.groupBy(per).agg(F.count(F.lit(1)).alias("members")), per).join(joined, [per, "thought"], "left")
    return d.select(per, "thought", "members", (F.col("members") - 1 - F.coalesce("joined", F.lit(0))).alias("links"))


def score_alerts(findings: DataFrame, alerts: DataFrame) -> DataFrame:
    """Precision per check at line and at file granularity: findings ``(check, path, line)``, alerts ``(rule, path, line)``."""
    f = findings.select("check", "path", "line").distinct()
    at_line = f.join(alerts.select("path", "line").distinct().withColumn("hit_line", F.lit(1)), ["path", "line"], "left")
    both = at_line.join(alerts.select("path").distinct().withColumn("hit_file", F.lit(1)), "path", "left")
    return both.groupBy("check").agg(
        F.count(F.lit(1)).alias("findings"), F.round(F.avg(F.coalesce("hit_line", F.lit(0))), 6).alias("precision_line"), F.round(F.avg(F.coalesce("hit_file", F.lit(0))), 6).alias("precision_file"))


def recall_alerts(findings: DataFrame, alerts: DataFrame) -> DataFrame:
    a = alerts.select("rule", "path", "line").distinct()
    at = a.join(findings.select("path", "line").distinct().withColumn("hit_line", F.lit(1)), ["path", "line"], "left")
    at = at.join(findings.select("path").distinct().withColumn("hit_file", F.lit(1)), "path", "left")
    return at.groupBy("rule").agg(F.count(F.lit(1)).alias("alerts"), F.round(F.avg(F.coalesce("hit_line", F.lit(0))), 6).alias("recall_line"), F.round(F.avg(F.coalesce("hit_file", F.lit(0))), 6).alias("recall_file"))


def conformance(methods: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Types whose methods cover all of an interface's: relational division of ``(type_id, sig)`` by ``(interface_id, sig)``."""
    i = interfaces.select("interface_id", "sig").distinct()
    need = i.groupBy("interface_id").agg(F.count(F.lit(1)).alias("need"))
    m = methods.select("type_id", "sig").distinct()
    got = m.join(i, "sig").groupBy("type_id", "interface_id").agg(F.count(F.lit(1)).alias("got"))
    return got.join(need, "interface_id").where("got = need").select("type_id", "interface_id", F.col("need").alias("methods"))


def resolution_ladder(refs: DataFrame, decls: DataFrame) -> DataFrame:
    """References ``(ref_id, name, file, package)`` to declarations ``(decl_id, name, file, package)``: the first rung that has a candidate (file, package, anywhere) wins.

    Several candidates of a rung share its confidence equally.
    """
    d = decls.select("decl_id", "name", F.col("file").alias("dfile"), F.col("package").alias("dpackage"))
    c = refs.join(d, "name").withColumn("rung", F.when(F.col("file") == F.col("dfile"), 0).when(F.col("package") == F.col("dpackage"), 1).otherwise(2))
    best = c.groupBy("ref_id").agg(F.min("rung").alias("rung"))
    c = c.join(best, ["ref_id", "rung"])
    n = c.groupBy("ref_id").agg(F.count(F.lit(1)).alias("candidates"))
    return c.join(n, "ref_id").select("ref_id", "decl_id", "rung", "candidates", F.round(1.0 / F.col("candidates"), 6).alias("confidence"), F.when(F.col("candidates") > 1, F.lit("ambiguous-name")).otherwise(F.lit("static")).alias("method"))


def dockerfile_links(files: DataFrame) -> DataFrame:
    """BUILDS pairs of Dockerfiles ``(id, file_path, content)`` to the files, else directories, that their COPY and ADD lines name."""
    docker = files.where(F.col("file_path").rlike(r"(^|/)Dockerfile[^/]*$"))
    base = F.regexp_extract("file_path", r"^(.*?)[^/]*$", 1)
    args = F.explode(F.regexp_extract_all("content", F.lit(r"(?im)^\s*(?:COPY|ADD)\s+(?:--\S+\s+)*(\S+)\s+\S+"), 1))
    want = docker.select(F.col("id").alias("docker_id"), base.alias("base"), args.alias("arg")).where(~F.col("arg").startswith("http"))
    want = want.select("docker_id", F.regexp_replace(F.concat("base", F.regexp_replace("arg", r"^\./", "")), r"/+$", "").alias("path"))
    exact = want.join(files.select(F.col("id").alias("target_id"), F.col("file_path").alias("path")), "path").select("docker_id", "path", "target_id")
    rest = want.join(exact.select("docker_id", "path"), ["docker_id", "path"], "left_anti")
    dirs = files.select(F.col("id").alias("target_id"), F.col("file_path").alias("fp")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.greatest(F.size(F.split("fp", "/")) - 1, F.lit(1)))))
    dirs = dirs.select("target_id", F.array_join(F.slice(F.split("fp", "/"), 1, F.col("cut")), "/").alias("path"))
    return exact.unionByName(rest.join(dirs, "path").select("docker_id", "path", "target_id")).distinct()


# --- aggregations -----------------------------------------------------------------------------
def pivot_matrix(d: DataFrame, row: Column, col: Column) -> DataFrame:
    """``(r, c, n)`` with totals as nulls; rows missing either key are skipped. One pass of grouping sets."""
    x = d.select(row.alias("r"), col.alias("c")).where("r <> '' and c <> ''")
    return x.cube("r", "c").agg(F.count(F.lit(1)).alias("n"))


def graph_stats(g: Graph) -> DataFrame:
    a = g.live.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("symbol_name") != "", F.col("symbol_name"))).alias("sample")).select(F.lit("node").alias("kind"), "type", "n", F.coalesce("sample", F.lit("")).alias("sample"))
    return a.unionByName(g.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "type", "n", F.lit("").alias("sample")))


def metadata_stats(g: Graph) -> DataFrame:
    """Per key: distinct values, writes and the upper median of nodes per value, with advice: few values shared by many nodes are better edges.

    The median comes from a histogram of counts, so a key with many values is not gathered in one place.
    """
    v = g.live.select(F.explode("metadata").alias("key", "value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("c"))
    h = v.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    w = W.partitionBy("key")
    h = h.withColumn("below", F.coalesce(F.sum("m").over(w.orderBy("c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("m").over(w)).withColumn("writes", F.sum(F.col("m") * F.col("c")).over(w))
    mid = F.floor(F.col("n") / 2)
    d = h.where((F.col("below") <= mid) & (mid < F.col("below") + F.col("m")))
    advice = F.when((F.col("c") >= 5) & (F.col("n") <= 1000) & (F.col("n") > 1), F.lit("promote")).otherwise(F.lit("keep"))
    return d.select("key", F.col("n").alias("distinct_values"), "writes", F.col("c").alias("median_nodes"), advice.alias("advice"))


def degrees(e: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, fan_in, fan_out, total)`` over ``(src, dst)`` for every id."""
    x = e.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    d = x.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return ids.select("id").distinct().join(d, "id", "left").select("id", z("fan_in").alias("fan_in"), z("fan_out").alias("fan_out"), (z("fan_in") + z("fan_out")).alias("total"))


def degree_by_type(g: Graph) -> DataFrame:
    """``(id, fan_in, fan_out, by_type)``: degrees with counts per edge type."""
    e = g.edges.where("from_id <> to_id")
    x = e.select(F.col("from_id").alias("id"), "type", F.lit(0).alias("i")).unionByName(e.select(F.col("to_id").alias("id"), "type", F.lit(1).alias("i")))
    t = x.groupBy("id", "type").agg(F.sum("i").alias("i"), F.sum(1 - F.col("i")).alias("o"))
    d = t.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "type", (F.col("i") + F.col("o")).cast("string")))), ";").alias("by_type"))
    return d.join(g.live.select("id"), "id", "left_semi")


# Lower bounds of the buckets of a degree histogram, with their names.
DEGREE_BUCKETS = [(0, "0"), (1, "1"), (2, "2"), (3, "3-5"), (6, "6-10"), (11, "11-25"), (26, "26-100"), (101, "101-1000"), (1001, "1001+")]


def degree_histogram(deg: DataFrame) -> DataFrame:
    """``(measure, bucket, n)`` over nine fixed buckets, empty ones kept."""

    def name(c: Column) -> Column:
        out = F.lit(DEGREE_BUCKETS[0][1])
        for low, b in DEGREE_BUCKETS[1:]:
            out = F.when(c >= low, F.lit(b)).otherwise(out)
        return out

    x = deg.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), name(F.col(m)).alias("bucket")) for m in ("fan_in", "fan_out", "total")])).alias("x")).select("x.*")
    got = x.groupBy("measure", "bucket").agg(F.count(F.lit(1)).alias("n"))
    dim = deg.sparkSession.createDataFrame([(m, b) for m in ("fan_in", "fan_out", "total") for _, b in DEGREE_BUCKETS], "measure string, bucket string")
    return dim.join(got, ["measure", "bucket"], "left").select("measure", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def content_ratio(g: Graph) -> DataFrame:
    """Share of every node type."""
    c = g.live.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("t"))
    return c.crossJoin(F.broadcast(t)).select("type", "n", F.round(F.col("n") / F.col("t"), 6).alias("ratio"))  # t is one row


def subtree_ratio(g: Graph, root_types: list[str], edge: str, depth: int | None = None) -> DataFrame:
    """Node types inside the subtree of every root along containment."""
    roots = g.live.where(F.col("type").isin(*root_types)).select(F.col("id").alias("a"))
    c = closure(steps(g.edges, "out", [edge]), depth).join(roots, "a", "left_semi")
    t = c.join(g.live.select(F.col("id").alias("b"), "type"), "b").groupBy(F.col("a").alias("root"), "type").agg(F.count(F.lit(1)).alias("n"))
    s = t.groupBy("root").agg(F.sum("n").alias("t"))
    return t.join(s, "root").select("root", "type", "n", F.round(F.col("n") / F.col("t"), 6).alias("ratio"))


def keyword_density(d: DataFrame, pattern: str, target: str) -> DataFrame:
    """Share of non-empty texts of a column that match."""
    hit = F.col(target).rlike(pattern).cast("int")
    return d.where(F.col(target) != "").agg(F.coalesce(F.sum(hit), F.lit(0)).cast("long").alias("hits"), F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg(hit), F.lit(0.0)), 6).alias("density"))


def title_shape(g: Graph, kind: str, pattern: str = r"^[A-Z][^?]*\(") -> DataFrame:
    """Share of the titles of a node type that have a shape; untitled nodes do not count."""
    return keyword_density(g.live.where(F.col("type") == kind), pattern, "symbol_name")


def code_results(g: Graph, prefix: str, *, tests: bool = False) -> DataFrame:
    """Declarations under a path prefix; test code only if asked."""
    d = g.live.where(F.col("type").isin("function", "method", "type") & F.col("file_path").startswith(prefix))
    return (d if tests else d.where((F.lower("test_kind") == "") & ~F.col("is_test"))).select("id", "file_path")


def rule_index(runs: DataFrame, warn_above: int = 2) -> DataFrame:
    """``(id, severity, repo, summary)``: one record for every rule of a discovery report that left files out."""
    d = runs.select("repo", F.explode("excluded_by_rule").alias("rule", "n")).where("n > 0")
    return d.select(F.concat_ws(":", "repo", "rule").alias("id"), F.when(F.col("n") > warn_above, F.lit("warning")).otherwise(F.lit("notice")).alias("severity"), "repo", F.concat(F.col("n").cast("string"), F.lit(" files left out by "), "rule").alias("summary"))


def collect_staleness(g: Graph, runs: DataFrame) -> DataFrame:
    """``(repo, stale)``: whether a repository's files changed after its discovery ran."""
    newest = g.live.where("type = 'file'").groupBy(F.col("source").alias("repo")).agg(F.max("updated_at").alias("newest"))
    return runs.join(newest, "repo").select("repo", (F.col("newest") > F.unix_micros(F.col("run_at").cast("timestamp")) * 1000).alias("stale"))


def package_matrix(g: Graph, edge_types: list[str]) -> DataFrame:
    """Edges rolled up from nodes to the directories of their files: count and a representative file; edges within a package go."""
    pk = g.live.where("file_path <> ''").select("id", F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("pkg"), "file_path")
    e = g.edges.where(F.col("type").isin(*edge_types))
    d = e.join(pk.select(F.col("id").alias("from_id"), F.col("pkg").alias("from_pkg"), F.col("file_path").alias("rep")), "from_id").join(pk.select(F.col("id").alias("to_id"), F.col("pkg").alias("to_pkg")), "to_id")
    return d.where("from_pkg <> to_pkg").groupBy("from_pkg", "to_pkg").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("rep"))


def ck_metrics(g: Graph, kinds: list[str]) -> DataFrame:
    """CBO (distinct outgoing USES_TYPE and CALLS targets), RFC (methods and their callees), WMC (contained methods) and fan-in of nodes of the kinds."""
    c = g.live.where(F.col("type").isin(*kinds)).select("id")
    e = g.edges.where("from_id <> to_id")
    cbo = e.where("type in ('USES_TYPE', 'CALLS')").groupBy(F.col("from_id").alias("id")).agg(F.countDistinct("to_id").alias("cbo"))
    methods = e.where("type = 'CONTAINS'").select(F.col("from_id").alias("id"), F.col("to_id").alias("m")).distinct().join(g.live.where("type in ('method', 'function')").select(F.col("id").alias("m")), "m", "left_semi")
    wmc = methods.groupBy("id").agg(F.count(F.lit(1)).alias("wmc"))
    callees = methods.join(e.where("type = 'CALLS'").select(F.col("from_id").alias("m"), "to_id"), "m").select("id", F.col("to_id").alias("x"))
    rfc = methods.select("id", F.col("m").alias("x")).unionByName(callees).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("rfc"))
    fan = e.groupBy(F.col("to_id").alias("id")).agg(F.countDistinct("from_id").alias("fan_in"))
    d = c.join(cbo, "id", "left").join(rfc, "id", "left").join(wmc, "id", "left").join(fan, "id", "left")
    return d.select("id", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("cbo", "rfc", "wmc", "fan_in")])


def percent_rank_below(d: DataFrame, score: str, out: str) -> DataFrame:
    """Adds 100 times the share of rows with a strictly smaller score, from a histogram of scores: no window over all rows."""
    h = d.groupBy(F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_m"))
    # running count over distinct scores in range partitions: within one, and over the totals of those before
    r = h.repartitionByRange("_s").withColumn("_p", F.spark_partition_id())
    r = materialize(r, "ranks").df
    w = W.partitionBy("_p").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    t = r.groupBy("_p").agg(F.sum("_m").alias("_t"), F.min("_s").alias("_lo"))
    o = t.withColumn("_o", F.coalesce(F.sum("_t").over(W.orderBy("_lo").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_t").over(W.partitionBy()))
    r = r.withColumn("_b", F.coalesce(F.sum("_m").over(w), F.lit(0))).join(o.select("_p", "_o", "_all"), "_p").select("_s", (100.0 * (F.col("_b") + F.col("_o")) / F.col("_all")).alias(out))
    return d.join(r, F.col(score) == F.col("_s")).drop("_s")


def god_objects(ck: DataFrame) -> DataFrame:
    """Mean of the percentile ranks of the four measures, with severity."""
    from sparkloom.functions.scalars import severity

    d = ck
    for c in ("cbo", "rfc", "wmc", "fan_in"):
        d = percent_rank_below(d, c, f"p_{c}")
    score = (F.col("p_cbo") + F.col("p_rfc") + F.col("p_wmc") + F.col("p_fan_in")) / 4
    return d.select("id", "cbo", "rfc", "wmc", "fan_in", F.round(score, 6).alias("score"), severity(score).alias("severity"))


def composition(g: Graph) -> DataFrame:
    return g.live.groupBy("type", F.when(F.col("status") == "", F.lit("unset")).otherwise(F.col("status")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def proxy_breakdown(g: Graph) -> DataFrame:
    return g.live.where(metadata_predicate({"repo": "*"})).groupBy(meta("repo").alias("foreign_graph")).agg(F.count(F.lit(1)).alias("n"))


def resolve_proxies(g: Graph, foreign: Graph, key: str = "foreign_id") -> DataFrame:
    """Stand-ins and the nodes of another graph that their metadata name."""
    p = g.live.where(meta(key) != "").select(F.col("id").alias("proxy_id"), meta(key).alias("id"))
    return p.join(foreign.live.select("id", "type", "symbol_name"), "id")


def rollup(g: Graph, root: DataFrame, edge: str, status: str, containers: list[str], criterion: str = "criterion") -> DataFrame:
    """``(id, action)``: cascade for the root and unsettled containers below it, hold for containers with an unsettled criterion child when the status is completed, list for others."""
    down = k_hop(g, root, "out", [edge], depth=32).where("distance > 0")
    n = down.join(g.live.select("id", "type", "status"), "id")
    open_criteria = g.edges.where(F.col("type") == edge).join(g.live.where((F.col("type") == criterion) & F.col("status").isin(*UNSETTLED)).select(F.col("id").alias("to_id")), "to_id").select(F.col("from_id").alias("id")).distinct().withColumn("crit", F.lit(True))
    n = n.join(open_criteria, "id", "left")
    act = F.when(~F.col("type").isin(*containers), F.lit("list")).when(~F.col("status").isin(*UNSETTLED), F.lit("settled"))
    act = act.when(F.col("crit") & F.lit(status == "completed"), F.lit("hold")).otherwise(F.lit("cascade"))
    return root.select("id").withColumn("action", F.lit("cascade")).unionByName(n.select("id", act.alias("action")))


# --- order, top and time ----------------------------------------------------------------------
def top_k(d: DataFrame, k: int, score: str = "score") -> DataFrame:
    return d.orderBy(F.desc(score), "id").limit(k)


def correlations(g: Graph, types: list[str], limit: int = 100) -> DataFrame:
    e = hydrate_edges(g).where(F.col("type").isin(*types))
    return e.orderBy(F.desc("confidence"), "from_id", "to_id", "type", "evidence", "weight").limit(min(limit, 1000))


def timeline(d: DataFrame, instant: Column, name: str = "symbol_name", limit: int = 500) -> DataFrame:
    """The earliest rows with their offset in seconds from the first."""
    x = d.withColumn("at", instant).where(F.col("at").isNotNull())
    t0 = x.agg(F.min("at").alias("t0"))
    return x.crossJoin(F.broadcast(t0)).select("id", F.col(name).alias("name"), "at", (F.unix_micros("at") - F.unix_micros("t0")).alias("offset_us")).orderBy("at", "id").limit(min(limit, 5000))  # t0 is one row


def tumbling(d: DataFrame, us: str, seconds: int) -> DataFrame:
    """Buckets from the first instant on that are not empty: start offset, rows and up to five names."""
    t0 = d.agg(F.min(us).alias("t0"))
    x = d.where(F.col(us).isNotNull()).crossJoin(F.broadcast(t0)).withColumn("bucket", F.floor((F.col(us) - F.col("t0")) / (seconds * 1_000_000)))  # t0 is one row
    w = W.partitionBy("bucket", "_salt").orderBy(us, "id")
    x = x.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(16))).withColumn("_r", F.row_number().over(w))
    few = x.where("_r <= 5").withColumn("_r2", F.row_number().over(W.partitionBy("bucket").orderBy(us, "id"))).where("_r2 <= 5")
    names = few.groupBy("bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r2", "name"))), lambda s: s["name"]), ", ").alias("names"))
    return x.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).join(names, "bucket")


def instant_of(field: str) -> Column:
    """created_at or updated_at in nanoseconds, or a metadata key as text, as a timestamp."""
    if field in ("created_at", "updated_at"):
        return F.when(F.col(field) > 0, F.timestamp_micros(F.expr(f"{field} div 1000")))
    return parse_instant(meta(field))


def recent(g: Graph, now_ns: int, types: list[str], k: int, since_ns: int | None = None) -> DataFrame:
    from sparkloom.functions.scalars import temporal_boost

    d = g.live.where(F.col("type").isin(*types))
    if since_ns is not None:
        d = d.where(F.col("updated_at") >= since_ns)
    return top_k(d.select("id", "type", F.round(temporal_boost(F.lit(1.0), now_ns, F.col("updated_at")), 9).alias("score")), k)


def edge_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Symmetric difference of two sets of edges ``(a, b)`` as adds and removes."""
    return new.subtract(old).withColumn("change", F.lit("add")).unionByName(old.subtract(new).withColumn("change", F.lit("remove")))


def ordered_children(g: Graph, edge: str) -> DataFrame:
    """Children of every parent by position in the edge's evidence, those without one last, by id."""
    e = g.edges.where(F.col("type") == edge).select(F.col("from_id").alias("parent"), F.col("to_id").alias("id"), F.get_json_object("evidence", "$.position").try_cast("long").alias("position"))
    e = e.groupBy("parent", "id").agg(F.min("position").alias("position")).join(g.live.select("id"), "id", "left_semi")
    return e.withColumn("no", F.row_number().over(W.partitionBy("parent").orderBy(F.col("position").asc_nulls_last(), "id")))


def analyze_node(g: Graph, node: str) -> DataFrame:
    """Callers and callees of a node with the least certain and most certain edge of each."""
    e = g.edges.where("type = 'CALLS'")
    out = e.where(F.col("from_id") == node).select(F.lit("callee").alias("role"), F.col("to_id").alias("id"), "confidence")
    inn = e.where(F.col("to_id") == node).select(F.lit("caller").alias("role"), F.col("from_id").alias("id"), "confidence")
    d = out.unionByName(inn).groupBy("role", "id").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("edges"))
    return d.join(g.live.select("id", "symbol_name", "type"), "id")


def file_symbols(g: Graph, paths: DataFrame) -> DataFrame:
    """Declarations of files asked for by path, exactly, else by the end of the path at a segment."""
    decl = g.live.where("type in ('function', 'method', 'type')").select("id", "symbol_name", "type", "file_path", "start_line")
    exact = paths.select(F.col("path").alias("asked")).join(decl, F.col("asked") == F.col("file_path"))
    rest = paths.select(F.col("path").alias("asked")).join(exact.select("asked").distinct(), "asked", "left_anti")
    cut = decl.withColumn("_s", F.explode(F.sequence(F.lit(2), F.greatest(F.size(F.split("file_path", "/")), F.lit(2)))))
    cut = cut.withColumn("asked", F.array_join(F.slice(F.split("file_path", "/"), F.col("_s"), F.lit(100)), "/")).drop("_s")
    return exact.unionByName(rest.join(cut, "asked").select(*exact.columns))


def module_listing(g: Graph, prefix: str = "") -> DataFrame:
    d = g.live.where((F.col("type") == "file") & F.col("file_path").startswith(prefix))
    return d.groupBy(F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("module")).agg(F.count(F.lit(1)).alias("files"))


def adjacency(g: Graph, types: list[str]) -> DataFrame:
    """Undirected neighbours as a sorted list joined by commas."""
    s = steps(g.edges, "both", types).where("a <> b")
    ids = g.live.select("id")
    s = s.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    return s.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.array_join(F.array_sort(F.collect_set("b")), ",").alias("neighbours"))


def graph_counts(g: Graph) -> DataFrame:
    """Nodes per graph instance (family and source)."""
    fam = F.when(F.col("type").isin("file", "function", "method", "type"), F.lit("code")).otherwise(F.lit("knowledge"))
    return g.live.groupBy(fam.alias("family"), F.col("source").alias("instance")).agg(F.count(F.lit(1)).alias("nodes"))


def explain(g: Graph, a: str, b: str | None = None) -> DataFrame:
    e = hydrate_edges(g)
    one = (F.col("from_id") == a) | (F.col("to_id") == a)
    return e.where(one if b is None else one & ((F.col("from_id") == b) | (F.col("to_id") == b)))


def rule_scope(rules: DataFrame, repo: str, path: str) -> DataFrame:
    """Rules ``(id, repo, prefixes)`` that apply: an empty scope, or the repository and any prefix at a segment boundary."""
    p = F.lit(path)
    hit = F.exists("prefixes", lambda x: (p == F.rtrim(x)) | p.startswith(F.concat(F.regexp_replace(x, "/+$", ""), F.lit("/"))) | (p == F.regexp_replace(x, "/+$", "")))
    return rules.where((F.coalesce("repo", F.lit("")) == "") | ((F.col("repo") == repo) & ((F.size("prefixes") <= 0) | hit)))


def intersect_prefixes(run: DataFrame, check: DataFrame) -> DataFrame:
    """The narrower of every two prefixes of which one holds the other. Every prefix meets those above it by an equal join on its own leading segments."""
    r, c = run.select("prefix").where(F.col("prefix").isNotNull()).distinct(), check.select("prefix").where(F.col("prefix").isNotNull()).distinct()

    def inside(a: DataFrame, b: DataFrame) -> DataFrame:
        parts = F.split("prefix", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
        up = a.select("prefix", F.explode(F.array_append(above, F.lit(""))).alias("above")).distinct()
        return up.join(b.select(F.col("prefix").alias("above")), "above").select("prefix")

    return inside(r, c).unionByName(inside(c, r)).distinct()

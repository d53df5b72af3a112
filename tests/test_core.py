from __future__ import annotations

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scalars as S
from sparkloom.operators import analyzers as A
from sparkloom.operators import evidence as V
from sparkloom.operators import graph as G
from sparkloom.operators import mutations as M
from sparkloom.operators import search as X
from sparkloom.operators import usage as U
from sparkloom.plans import recipe as R
from sparkloom.sources import documents as D
from sparkloom.sources import sessions

NODES = "id string, type string, symbol_name string, file_path string, language string, start_line int, end_line int, content string, signature string, summary string, description string, source string, status string, metadata map<string,string>, created_at long, updated_at long, keywords string, is_exported boolean, tombstoned_at long, is_test boolean, test_kind string"
EDGES = "from_id string, to_id string, type string, weight double, confidence double, method string, evidence string, last_validated long"


def node(i, kind="t", **k):
    d = {"symbol_name": i, "metadata": {}, "created_at": 1, "updated_at": 1, "tombstoned_at": 0} | k
    names = [x.split()[0] for x in NODES.split(", ")]
    return tuple({"id": i, "type": kind, **d}.get(n) for n in names)


def graph_of(spark, nodes, edges):
    n = spark.createDataFrame(nodes, NODES)
    e = spark.createDataFrame([(a, b, t, w, 0.5, "human", ev, 0) for a, b, t, w, ev in [(*x, "R", 1.0, "")[:5] if len(x) == 2 else (*x, 1.0, "")[:5] if len(x) == 3 else (*x, "")[:5] for x in edges]], EDGES)
    return G.load(n, e)


def pairs(spark, es):
    return spark.createDataFrame([(a, b, 1.0) for a, b in es], "src string, dst string, weight double")


def ids(spark, n):
    return spark.createDataFrame([(x,) for x in n], "id string")


# --- scalars
def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, S.byte_slice(F.lit("héllo"), F.lit("0"), F.lit("3"))) == "hé"
    assert one(spark, S.byte_slice(F.lit("abc"), F.lit("2"), F.lit("1"))) == "" and one(spark, S.byte_length(F.lit("é"))) == "2"
    assert one(spark, S.match_group(F.lit("a12b"), r"a(\d+)", 1)) == "12"
    with pytest.raises(ValueError):
        S.check_pattern("(?<=a)b")
    assert one(spark, S.tokens(F.lit("parseHTTPRequest snake_case x é9"))) == ["parsehttprequest", "parse", "http", "request", "snake_case", "snake", "case", "é9"]
    assert one(spark, S.canonical_url(F.lit(" HTTP://A.com/b/?Q=1#f"))) == "http://a.com/b?Q=1" and one(spark, S.canonical_url(F.lit("nope"))) == ""
    assert one(spark, S.intent(F.lit("how does the cache work"))) == "impl" and one(spark, S.intent(F.lit("cache test"))) == "test" and one(spark, S.intent(F.lit("ab"))) == "unknown"
    assert S.parse_duration("1h30m") == 5400 and S.parse_duration("7d") == 604800
    with pytest.raises(ValueError):
        S.parse_duration("7 days")
    assert one(spark, S.hamming(F.lit(bytes(32)), F.lit(b"\xff" + bytes(31)))) == 8 and one(spark, S.bit_similarity(F.lit(b"a"), F.lit(bytes(32)))) == 0
    assert one(spark, S.fingerprint(F.lit("Annual  Report - page 12"))) == one(spark, S.fingerprint(F.lit("annual report - page 3")))
    import hashlib

    assert one(spark, S.stable_id(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))) == hashlib.sha256(b"a\0b\0c\0d").hexdigest()[:16]
    d = spark.createDataFrame([("1",), ("x",)], "v string")
    with pytest.raises(Exception, match="not a number"):
        d.where(S.compare("gt", F.col("v"), 0)).collect()


# --- usage
def usage_rows(spark, rows):
    return U.intake(spark.createDataFrame([tuple(r.get(f.name) for f in sessions.SCHEMA) for r in rows], sessions.SCHEMA))


def test_histogram_percentiles(spark):
    for h, want in (({9: 2}, (1023, 1023)), ({11: 1}, (4095, 4095)), ({9: 2, 11: 1}, (1023, 4095))):
        d = spark.createDataFrame([("t", b, n) for b, n in h.items()], "k string, bucket int, n long")
        r = U.hist_percentiles(d, ["k"], {"p50": 0.5, "p90": 0.9}).first()
        assert (r.p50, r.p90) == want
    b = spark.createDataFrame([(x,) for x in (0, -5, 1, 2, 3, 1000, 3000, 2**40)], "v long").select(U.bucket(F.col("v")).alias("b")).collect()
    assert [r.b for r in b] == [0, 0, 0, 1, 1, 9, 11, 31]


def test_usage_scenario(spark):
    t = "2026-01-01T10:{:02d}:{:02d}Z".format
    base = {"session_id": "s", "agent_id": "", "uuid": "u"}
    rows = [base | {"record_ts": t(0, 0), "tool_name": "Bash", "tool_input_hash": "h", "duration_ms": 1000, "tool_result_bytes": 36}, base | {"record_ts": t(0, 1), "tool_name": "Bash", "tool_input_hash": "h", "duration_ms": 1000},
            base | {"record_ts": t(0, 1), "output_tokens": 5, "input_tokens": 10, "cache_read_tokens": 8}, base | {"record_ts": t(0, 2), "output_tokens": 4000, "stop_reason": "max_tokens", "duration_ms": 5000}, base | {"record_ts": t(0, 3), "is_api_error": True},
            base | {"record_ts": t(0, 4), "tool_name": "Read", "duration_ms": 900, "interrupted": True}, base | {"record_ts": t(0, 5), "is_meta": True, "output_tokens": 9}, base | {"record_ts": t(0, 5), "model": "<synthetic>", "output_tokens": 9}]
    rows += [base | {"agent_id": "a", "is_sidechain": True, "record_ts": x, "subagent_type": "k"} for x in (t(0, 0), t(2, 0), t(15, 0), "unknown")]
    d = usage_rows(spark, rows)
    g = U.duplicate_groups(d).first()
    assert (g.run_count, g.wasted_ms, g.per_call_ms, g.verdict) == (2, 2000, 1000, "undetermined")
    w = U.waste_summary(d).first()
    assert (w.api_errors, w.interrupted, w.truncated, w.truncated_output, w.truncated_ms) == (1, 1, 1, 4000, 5000)
    s = U.subagent_wall_time(d).first()
    assert (s.active_ms, s.span_ms) == (120_000, 900_000)
    r = {x.tool_name: x for x in U.result_residency(d).collect()}
    assert r["Bash"].result_tokens == 10 and r["Bash"].resident_tokens == 20 and "Read" not in r
    assert {x.tool_name: x.total_duration_ms for x in U.tool_time_totals(d).collect()} == {"Bash": 2000, "Read": 0}
    with pytest.raises(ValueError):
        U.intake(spark.createDataFrame([], sessions.SCHEMA), scope="all", session_id="s")
    e = usage_rows(spark, [])
    assert U.tool_latency(e).count() == 0 and U.cache_efficiency(e).first().ratio == 0


# --- graph
def test_load_and_predicates(spark):
    g = graph_of(spark, [node("a", updated_at=1, status="old"), node("a", updated_at=2, status=None, metadata={"k": "v"}), node("b", tombstoned_at=3), node("c", metadata=None)], [("a", "c"), ("a", "c"), ("a", "gone"), ("a", "a"), (None, "a")])
    assert sorted(r.id for r in g.live.collect()) == ["a", "c"] and g.live.where("id = 'a'").first().status == ""
    assert [r.id for r in G.browse(g, ["t"], metadata={"k": "*"}).collect()] == ["a"] and G.browse(g, ["t"], metadata={"k": "w"}).count() == 0
    assert [(r.src, r.dst, r.weight) for r in G.analyzer_edges(g).collect()] == [("a", "c", 1.0)]
    assert G.resolve_edge_types(g.edges, ["r"]) == ["R"]
    for bad in (lambda: G.resolve_edge_types(g.edges, ["zz"]), lambda: G.check_direction("up"), lambda: G.project(g.live, ["nope"]), lambda: G.field_predicate([("nope", "EQ", 1)]), lambda: G.check_consumed({"x": 1}, set(), "m")):
        with pytest.raises(ValueError):
            bad()
    assert {r.id: r.distance for r in G.k_hop(g, ids(spark, ["a"]), "both", None, 3).collect()} == {"a": 0, "c": 1}


def test_metadata_median_and_histogram(spark):
    g = graph_of(spark, [node(f"n{i}", metadata={"k": v}) for i, v in enumerate("aaabbc")], [])
    r = G.metadata_stats(g).first()
    assert (r.distinct_values, r.writes, r.median_nodes) == (3, 6, 2)
    h = G.degree_histogram(G.degrees(pairs(spark, []), g.live))
    assert h.count() == 27 and h.agg(F.sum("n")).first()[0] == 18


def test_components_and_scc(spark):
    rng = random.Random(2)
    n = [f"v{i:02d}" for i in range(40)]
    es = {(a, b) for a in n for b in n if a != b and rng.random() < 0.03}
    reach = {a: {a} for a in n}
    for _ in n:
        for a, b in es:
            reach[a] |= reach[b]
    want = {a: min(x for x in n if x in reach[a] and a in reach[x]) for a in n}
    size = defaultdict(int)
    for a in n:
        size[want[a]] += 1
    got = {r.id: (r.scc, r.size) for r in A.scc(ids(spark, n), pairs(spark, es)).collect()}
    assert got == {a: (want[a], size[want[a]]) for a in n if size[want[a]] > 1}
    par = {a: a for a in n}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in es:
        x, y = find(a), find(b)
        par[max(x, y)] = min(x, y)
    assert {r.id: r.comp for r in A.components(ids(spark, n), pairs(spark, es)).collect()} == {a: find(a) for a in n}


def dense_pagerank(n, es, damping=0.85):
    k = {x: i for i, x in enumerate(n)}
    m = np.zeros((len(n), len(n)))
    for a, b in es:
        m[k[b], k[a]] = 1
    out = m.sum(0)
    r = np.full(len(n), 1 / len(n))
    for _ in range(500):
        r = (1 - damping) / len(n) + damping * (m @ np.divide(r, out, out=np.zeros_like(r), where=out > 0) + r[out == 0].sum() / len(n))
    return dict(zip(n, r))


def test_pagerank_and_hits(spark):
    n = list("abcde")
    es = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    got = {r.id: r.score for r in A.pagerank(ids(spark, n), pairs(spark, es)).collect()}
    want = dense_pagerank(n, es)
    assert all(abs(got[x] - want[x]) < 1e-5 for x in n)
    with pytest.raises(RuntimeError):
        A.pagerank(ids(spark, n), pairs(spark, es), max_iter=1)
    h = {r.id: (round(r.hub, 4), round(r.authority, 4)) for r in A.hits(ids(spark, n), pairs(spark, [("a", "b"), ("a", "c"), ("d", "c")])).collect()}
    assert h["a"][0] > h["d"][0] > 0 and h["c"][1] > h["b"][1] > 0 and h["e"] == (0.0, 0.0)
    assert A.hits(ids(spark, n), pairs(spark, [])).agg(F.sum("hub")).first()[0] == 0


def test_hits_settles_beside_nearly_equal_parts(spark):
    star = lambda n, c: [(f"{c}{i}", c) for i in range(n)]
    # parts by themselves: two equal ones lead, one is a little less; and two nearly equal ones that hang together
    for es in (star(30, "p") + star(30, "q") + star(29, "w") + [("w0", "y")], star(30, "p") + star(29, "q") + [("p1", "q"), ("q2", "k")]):
        n = sorted({x for e in es for x in e} | {"lone"})
        m = np.zeros((len(n), len(n)))
        for a, b in es:
            m[n.index(a), n.index(b)] = 1
        v, x = np.linalg.eigh(m @ m.T)
        top = x[:, v > v[-1] * (1 - 1e-8)]
        hub = top @ top.sum(axis=0)
        auth = m.T @ hub
        got = {r.id: (r.hub, r.authority) for r in A.hits(ids(spark, n), pairs(spark, es)).collect()}
        for i, h, a in zip(n, hub / np.linalg.norm(hub), auth / np.linalg.norm(auth), strict=True):
            assert abs(got[i][0] - h) < 1e-7 and abs(got[i][1] - a) < 1e-7, i


def test_sequential_analyzers(spark):
    star = [("c", x) for x in "defg"]
    two = [(a, b) for k in ("abc", "xyz") for a, b in itertools.combinations(k, 2)] + [("c", "x")]
    n = ids(spark, "abcxyzdefg")
    assert {r.id: r.blast for r in A.articulation(ids(spark, "cdefg"), pairs(spark, star)).collect()} == {"c": 3}
    assert {r.id: r.blast for r in A.articulation(n, pairs(spark, two)).collect()} == {"c": 2, "x": 2}
    b = {r.id: r.score for r in A.betweenness(ids(spark, "abc"), pairs(spark, [("a", "b"), ("b", "c")])).collect()}
    assert b == {"a": 0.0, "b": 1.0, "c": 0.0}
    c = {r.cycle for r in A.cycles(n, pairs(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("x", "y")])).collect()}
    assert c == {"a->b", "a->b->c"}
    k5 = [(a, b) for k in ("abcde", "vwxyz") for a, b in itertools.combinations(k, 2)] + [("e", "v")]
    com = defaultdict(set)
    for r in A.community(ids(spark, "abcdevwxyz"), pairs(spark, k5)).collect():
        com[r.community].add(r.id)
    assert dict(com) == {"a": set("abcde"), "v": set("vwxyz")}
    r = {x.seed: (x.impacted, x.score) for x in A.blast_radius(n, pairs(spark, [("b", "a"), ("c", "b"), ("c", "a")]), seeds=ids(spark, "a")).collect()}
    assert r == {"a": (2, 2.0)}
    with pytest.raises(ValueError):
        A.run("nope", n, n)


def test_large_sessions_are_grouped_whole(spark, tmp_path):
    from sparkloom.plans import catalog

    held = [("s", f"m{i:02d}") for i in range(50)] + [("t", f"m{i:02d}") for i in range(3)]
    links = [("m01", "m00", "supports"), ("m02", "m49", "relates-to"), ("m03", "zz", "supports")]
    edges = [(a, b, "contains", 1.0, 0.5, "human", "", 0) for a, b in held] + [(a, b, t, 1.0, 0.5, "human", "", 0) for a, b, t in links]
    spark.createDataFrame([node("s")], NODES).write.parquet(f"{tmp_path}/nodes.parquet")
    e = spark.createDataFrame(edges, EDGES)
    e.write.parquet(f"{tmp_path}/edges.parquet")
    done = {tuple(sorted(x[:2])) for x in links}
    want = sorted((*p, s) for s in "st" for p in itertools.combinations(sorted(b for a, b in held if a == s), 2) if p not in done)
    links_of = defaultdict(int)
    for x, y, group in want:
        links_of[x, group] += 1
        links_of[y, group] += 1
    expected = sorted((group, m, sum(1 for g, _ in held if g == group), links_of[m, group]) for group, m in held)
    assert sorted(tuple(r) for r in catalog.QUERIES["shared_session_groups"](spark, str(tmp_path)).select("artifact", "thought", "members", "links").collect()) == expected
    members = e.where("type = 'contains'").select(F.col("from_id").alias("artifact"), F.col("to_id").alias("thought"))
    assert sum(r.links for r in G.shared_artifact_groups(members, e.where("type <> 'contains'")).collect()) == 2 * len(want)
    assert G.shared_artifact_groups(members.limit(0), e).count() == 0


def test_query_intent(spark):
    cases = {"latency-test-server host now": "impl", "two words": "unknown", "ab": "unknown", "cache Tests": "test", "run describe( here": "test", "an end-to-end test": "test", "where is the handler": "impl", "": "unknown", " \n ": "unknown", "this SHOULD hold": "test", "contextual shouldered testy": "impl"}
    d = spark.createDataFrame(list(cases.items()), "q string, want string").select("q", "want", S.intent(F.col("q")).alias("got"))
    assert [(r.q, r.got) for r in d.collect()] == list(cases.items())


def test_discovery_rules(spark):
    from sparkloom.sources import documents as D

    mark = "// Code generated by x. DO NOT EDIT.\npackage a\n"
    cases = {
        "a/README.md": "skip_extension", "vendor/README.md": "skip_extension", "a/go.sum": "skip_lockfile", "a/x.d.ts": "skip_dts", "a/x.pb.go": "skip_generated_go", "a/x_gen.go": "", "a/y_gen.go": "skip_generated_go", "a/z_generated.go": "", "testdata/a.go": "skip_path_component",
        "a/generated/b.go": "skip_path_component", "generatedx/b.go": "", "dist/a.js": "", "build/a.go": "", "a/b.png": "skip_unknown_lang", "a/Makefile": "", "a/big.go": "skip_too_large", "deps/big.go": "skip_path_component", "node_modules": "skip_unknown_lang",
    }
    text = {"a/y_gen.go": mark, "a/z_generated.go": "package a\n" + mark, "a/big.go": "x" * (500 * 1024 + 1), "deps/big.go": "x" * 600_000, "a/x_gen.go": None}
    f = spark.createDataFrame([(p, "r", p, text.get(p, "package a\n")) for p in cases] + [("l", "lifted", "vendor/x.go", ""), ("p", "narrow", "lib/a.go", ""), ("q", "narrow", "libx/a.go", ""), *((f"v{i}", "many", f"vendor/{i}.go", "") for i in range(9))], "id string, source string, file_path string, content string")
    runs = spark.createDataFrame([("r", None, False), ("lifted", [], True), ("narrow", ["lib/", None], None), ("many", [], False), (None, ["x"], False)], "source string, prefixes array<string>, lift boolean")
    kept, report = D.discover(f, runs)
    assert {r.id for r in kept.collect()} == {p for p, rule in cases.items() if not rule} | {"l", "p"}
    got = {(r.source, r.rule): r for r in report.collect()}
    assert len(got) == 4 * len(D.DISCOVERY_RULES)
    assert {rule: got["r", rule].n for rule in D.DISCOVERY_RULES} == {rule: sum(v == rule for v in cases.values()) for rule in D.DISCOVERY_RULES}
    many = got["many", "skip_path_component"]
    assert many.n == 9 and many.truncated and many.samples == [f"vendor/{i}.go" for i in range(5)] and not got["lifted", "skip_path_component"].truncated


def test_prefixes_narrowed(spark):
    of = lambda *x: spark.createDataFrame([(p,) for p in x], "prefix string")
    got = {r.prefix for r in G.intersect_prefixes(of("src", "lib/a", "x", None, *[f"p{i}/q" for i in range(1500)]), of("src/api", "lib", "y", "srcs", *[f"p{i}" for i in range(1500)])).collect()}
    assert got == {"src/api", "lib/a"} | {f"p{i}/q" for i in range(1500)}
    assert {r.prefix for r in G.intersect_prefixes(of(""), of("a", "b/c")).collect()} == {"a", "b/c"}


def test_walk_has_no_depth_limit(spark):
    from sparkloom.plans.recipe import Program

    n = [node(f"n{i:02d}", type="root" if i == 0 else "part") for i in range(45)]
    e = [(f"n{i:02d}", f"n{i + 1:02d}", "contains", 1.0, 1.0, "human", "", 0) for i in range(44)]
    g = G.load(spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES))
    out = Program('select root\nwalk contains as $r\nemit step {\n name := node.id\n depth := walk.depth\n}', g).run()["nodes"]
    assert out.count() == 44 and G.closure(G.steps(g.edges, "out")).where("a = 'n00'").count() == 44


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from sparkloom import runtime

    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    monkeypatch.setattr(Context, "_jsc", type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})())
    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())


def test_sampled_betweenness_counts_isolated_nodes(spark):
    # a ring through 1000 of 6000 nodes: each source adds 0 to k-2 at the nodes on its way round, the same sum from every one
    k, n = 1000, 6000
    e = spark.createDataFrame([(f"{i:04d}", f"{(i + 1) % k:04d}", 1.0) for i in range(k)], "src string, dst string, weight double")
    nodes = ids(spark, [f"{i:04d}" for i in range(n)])
    each = (k - 1) * (k - 2) / 2
    r = A.betweenness(nodes, e).agg(F.count("id").alias("n"), F.sum("score").alias("s")).first()
    drawn = r.s / each / (n / 120)  # of 6000/50 sources drawn from all nodes, those on the ring
    assert r.n == n and abs(drawn - round(drawn)) < 1e-6 and 5 <= round(drawn) <= 40


def test_imports_below_line_200():
    text = "use std::fmt;\n" + "// filler\n" * 300 + "mod tests {\n    use crate::late;\n    fn check() {\n        run();\n    }\n}\n"
    c = D.chunk_source("a.rs", "rust", text)
    assert c and all(any("late" in i for i in x[5]) and any("fmt" in i for i in x[5]) for x in c)


def test_dsm(spark):
    p = spark.createDataFrame([("app", "core", 3), ("core", "util", 2), ("util", "app", 1), ("x", "y", 1), ("y", "x", 1)], "src string, dst string, n long")
    r = {(x.from_pkg, x.to_pkg) for x in A.dsm(p.select(F.explode(F.array("src", "dst")).alias("id")), p).collect()}
    assert {("x", "y"), ("y", "x"), ("util", "app")} <= r


def test_empty_analyzers(spark):
    n, e = ids(spark, "ab").limit(0), pairs(spark, [])
    assert A.components(n, e).count() == A.scc(n, e).count() == A.community(n, e).count() == A.articulation(n, e).count() == A.betweenness(n, e).count() == A.pagerank(n, e).count() == 0


# --- evidence
NOW = 100 * S.DAY_NS


def evidence_graph(spark):
    nodes = [node(x, "thought") for x in "pqr"] + [node(f"c{i}", "charge", metadata={"polarity": pol, "weight": w}, created_at=at, updated_at=at) for i, (pol, w, at) in enumerate([("positive", "2", NOW), ("negative", "1", NOW), ("positive", "n/a", NOW), ("positive", "8", 10 * S.DAY_NS), ("negative", "7", NOW)])]
    return graph_of(spark, nodes, [("p", "c0", "charged-by"), ("p", "c1", "charged-by"), ("p", "c2", "charged-by"), ("q", "c3", "charged-by"), ("q", "c4", "charged-by"), ("p", "q", "supports"), ("q", "r", "supports")])


def test_evidence(spark):
    g = evidence_graph(spark)
    f = {r.id: r for r in V.fold(g, NOW).collect()}
    assert abs(f["p"].valence - 1 / 3) < 1e-12 and f["p"].charges == 3 and abs(f["p"].magnitude - np.log(4)) < 1e-12 and abs(f["p"].self_trust - (0.1 + 0.5 * np.log(4))) < 1e-12
    assert f["r"].self_trust == 0.1 and f["r"].valence == 0
    m = V.trust_matrix(g, V.fold(g, NOW))
    assert all(abs(r.s - 1) < 1e-12 for r in m.groupBy("i").agg(F.sum("w").alias("s")).collect())
    v, rounds, ok = V.propagate_valence(m, V.fold(g, NOW).select("id", F.col("valence").alias("v")))
    assert ok and rounds < 100 and v.count() == 3
    mag = {r.id: r.m for r in V.propagate_magnitude(m, V.fold(g, NOW).select("id", F.col("magnitude").alias("m"))).collect()}
    assert mag["r"] >= 0.7 * mag["q"] - 1e-9
    x = {r.id: r.influence for r in V.influence(m).collect()}
    assert abs(sum(x.values()) - 1) < 1e-9
    assert {r.id for r in V.reversals(V.charges(g), ["thought"], NOW).where(V.reversed_sign()).select(F.col("thought").alias("id")).collect()} == {"q"}
    s = {r.state: r for r in V.simulate(g, NOW, "remove", "c1").collect()}
    assert s["after"].valence == 1.0 and s["after"].charges == 2
    s = {r.state: r for r in V.simulate(g, NOW, "invalidate", "p").collect()}
    assert (s["after"].valence, s["after"].self_trust) == (-1.0, 0.1)
    with pytest.raises(ValueError):
        V.simulate(g, NOW, "nope", "p")


# --- search
def test_bm25_and_fusion(spark):
    d = spark.createDataFrame([("a", {"summary": "cache cache index"}), ("b", {"content": "the cache"}), ("c", {"keywords": "graph"}), ("d", {"other": "cache"}), ("e", None)], "id string, fields map<string,string>").withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))
    q = spark.createDataFrame([("1", "Cache cache"), ("2", None), ("3", "nothing")], "qid string, text string")
    r = {x.id: x.score for x in X.bm25(d, q).collect()}
    idf = np.log((5 - 2 + 0.5) / 2.5 + 1)
    assert set(r) == {"a", "b"} and abs(r["a"] - 2 * idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / (3 / 5)))) < 1e-6
    l1 = spark.createDataFrame([("1", "a", 1), ("1", "b", 2)], "qid string, id string, rank int")
    l2 = spark.createDataFrame([("1", "b", 1), ("1", "c", 2)], "qid string, id string, rank int")
    assert [x.id for x in X.fuse([l1, l2], 10).orderBy("rank").collect()] == ["b", "a", "c"]
    with pytest.raises(ValueError):
        X.arms("text", True)
    v = spark.createDataFrame([("a", bytearray(32)), ("b", bytearray(b"\x01" + bytes(31))), ("c", bytearray(b"x")), ("d", None)], "id string, vector binary")
    assert [(x.id, x.score) for x in X.similar(v, ids(spark, ["a"]), 3).collect()] == [("b", 1 - 1 / 256)]


# --- recipes
@pytest.mark.parametrize(("src", "at"), [("emit pattern {\n    type = \"x\"\n}", "2:10"), ("link $a --> $b", "1:9"), ("select page where\n", "1:18"), ("select page\nbind $t := page.title ~= /oops\n", "2:26"), ("nosuchrule page", "1:1"), ("select a\nbind $x := nofn(a.name)", "2:12")])
def test_recipe_errors(src, at):
    with pytest.raises(R.RecipeError, match=f"^{at}"):
        R.parse(src)


def test_recipe_tree(spark):
    pos = '{{"position": {}}}'.format
    g = graph_of(spark, [node("p", "page"), node("s1", "section"), node("s2", "section"), node("x", "para", content="two"), node("y", "para", content="one"), node("z", "para", content="three")],
                 [("p", "s1", "contains", 1.0, pos(2)), ("p", "s2", "contains", 1.0, pos(1)), ("s1", "x", "contains", 1.0, pos(2)), ("s1", "y", "contains", 1.0, pos(1)), ("s2", "z", "contains", 1.0, "")])
    run = lambda src: R.Program(src, g).run()
    r = run('select para\nemit note {\n name := node.id\n path := heading_path("contains", "name", "/")\n}')["nodes"].collect()
    assert {x.name: x.fields["path"] for x in r} == {"x": "p/s1", "y": "p/s1", "z": "p/s2"}
    r = run('select page\nemit note {\n name := node.id\n text := subtree_concat("contains", "content", " ", "5")\n}')["nodes"].first()
    assert r.fields["text"] == "three one two"
    r = run('select section where {"ancestor": {"edge": "contains", "where": {"equals": {"of": "node.id", "value": "p"}}}}\ntraverse contains out as $c\nemit pair {\n name := concat(section.id, $c.id)\n at := edge.position\n}')["nodes"].collect()
    assert {x.name: x.fields.get("at") for x in r} == {"s1x": "2", "s1y": "1", "s2z": None}
    with pytest.raises(R.RecipeError, match="did you mean 'section'"):
        run("select sectoin")
    p = R.Program('select para\nemit same {\n name := "x"\n}', g)
    with pytest.raises(R.RecipeError, match="emitted 3 times"):
        p.check_unique(p.run()["nodes"])
    c = {x.what: x.n for x in run('select para\nemit note {\n name := ""\n} as $n\nlink $n --[a]--> node.id')["counts"].collect()}
    assert c == {"skipped": 3, "link_misses": 3}
    new, edges = R.land(spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a",), ("a@v2",)], "id string"))
    assert sorted(x.id for x in new.collect()) == ["a@v3", "b"] and [(e.from_id, e.to_id) for e in edges.collect()] == [("a@v2", "a@v3")]


# --- sources
def test_html():
    rows = D.page_tree("https://a.example/x", "<title>T</title><nav><ul><li><a href='/b'>b</a></li></ul></nav><h1>One</h1><p>para <b>bold</b></p><h2>Two</h2><pre><code class='language-go'>x := 1</code></pre><ul><li>i</li></ul><div style='display: none'>gone</div><table role='presentation'><tr><td>x</td></tr></table><h1>Three</h1>tail")
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    assert [r[3] for r in by["section"]] == ["One", "Two", "Three"] and by["section"][1][1] == by["section"][0][0]
    assert [r[4] for r in by["paragraph"]] == ["para bold", "tail"] and by["code"][0][7]["language"] == "go"
    assert [r[7]["class"] for r in by["list"]] == ["nav", "content"] and by["table"][0][7]["class"] == "layout"
    assert not any("gone" in r[4] for r in rows) and [r[4] for r in by["link"]] == ["/b"]
    assert len({r[0] for r in rows}) == len(rows)


def test_code():
    c = D.chunk_source("a.py", None, "import os\nclass A:\n    def m(self):\n        return f(1)\ndef g():\n    pass\n")
    assert [(x[0], x[1], x[2], x[3]) for x in c] == [("type", "A", 2, 4), ("method", "A.m", 3, 4), ("function", "g", 5, 6)] and c[1][4] == ["f"]
    c = D.chunk_source("a.go", "", "package a\nfunc (s *T) M() {\n\tif x {\n\t}\n\th()\n}\n\nfunc F() int { return 1 }\n")
    assert [(x[0], x[1], x[2], x[3]) for x in c] == [("method", "M", 2, 6), ("function", "F", 8, 8)]
    assert D.chunk_source("a.py", None, "def (") == []
    p = D.compile_pattern("f($X, $$$R)")
    assert [m[3] for m in D.search_text(p, "f(1)\nf(a, b, c)\ng(1)\n")] == [{"X": "1", "R": ""}, {"X": "a", "R": "b, c"}]
    assert D.search_text(D.compile_pattern("$X == $X"), "a == a\na == b\n")[0][2] == "a == a"


def test_ast_replace(spark):
    d = spark.createDataFrame([("a", "x = len(é)\ny = len(len(z))\n"), ("b", "def ("), ("c", None)], "id string, content string")
    r = {x.id: x for x in D.ast_replace(d, "len($X)", "size($X)").collect()}
    assert r["a"].new_text == "x = size(é)\ny = size(len(z))\n" and r["a"].ok and not r["b"].ok and r["c"].edits == 0


def test_layered_log(spark):
    lines = ['{"timestamp":"2026-01-01T00:00:00Z","type":"session_meta","payload":{"id":"s1","cwd":"/p","cli_version":"1"}}', "junk", '{"timestamp":"2026-01-01T00:00:01Z","type":"response_item","payload":{"type":"function_call","call_id":"c","name":"shell"}}',
             '{"timestamp":"2026-01-01T00:00:03Z","type":"response_item","payload":{"type":"function_call_output","call_id":"c","output":"exited with code 2"}}', '{"timestamp":"2026-01-01T00:00:04Z","type":"event_msg","payload":{"type":"token_count","info":{"last_token_usage":{"input_tokens":100,"cached_input_tokens":60,"output_tokens":7,"reasoning_output_tokens":3}}}}']
    d = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, value string")
    r = {x.record_type: x for x in sessions.parse_layered_log(d).collect()}
    assert (r["assistant"].duration_ms, r["assistant"].is_error, r["assistant"].session_id) == (2000, True, "s1")
    assert (r["token_count"].input_tokens, r["token_count"].output_tokens, r["token_count"].cache_read_tokens) == (40, 10, 60)
    c = spark.createDataFrame([('"héllo"',), ('[{"type":"text","text":"ab"},{"type":"image"}]',), ('"Output too large (1.5 KB). Saved"',)], "c string").select(sessions.result_size(F.col("c")).alias("r")).collect()
    assert [(x.r.bytes, x.r.images, x.r.spilled) for x in c] == [(6, 0, False), (2, 1, False), (1536, 0, True)]


def test_pdf(spark):
    import zlib

    from sparkloom.sources.pdf import runs_of, text_runs

    body = b"BT /F1 18 Tf 72 700 Td (Head\\(1\\)) Tj ET BT /F2 10 Tf 1 0 0 1 72 650 Tm [(Bo) -20 (dy) -300 (text)] TJ 0 -14 Td <6d6f7265> Tj ET"
    packed = zlib.compress(body)
    pdf = (b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R] /Count 1>> endobj\n3 0 obj <</Type /Page /MediaBox [0 0 612 792] /Contents 4 0 R /Resources <</Font <</F1 5 0 R /F2 6 0 R>>>>>> endobj\n"
           b"4 0 obj <</Filter /FlateDecode>> stream\n" + packed + b"\nendstream endobj\n5 0 obj <</Type /Font /BaseFont /Helv-Bold>> endobj\n6 0 obj <</Type /Font /BaseFont /Courier>> endobj\n")
    assert text_runs(pdf) == [(0, 72.0, 92.0, 18.0, "Helv-Bold", "Head(1)"), (0, 72.0, 142.0, 10.0, "Courier", "Body text"), (0, 72.0, 156.0, 10.0, "Courier", "more")]
    assert text_runs(b"no pdf") == []
    d = spark.createDataFrame([("a", bytearray(pdf)), ("b", None)], "path string, content binary")
    kinds = [r.kind for r in D.layout_blocks(runs_of(d)).orderBy("page", "block").collect()]
    assert kinds[0] == "heading" and "code" in kinds


def test_flow():
    src = "def f(a):\n    b = g(a)\n    for c in b:\n        d = c + 1\n    return d\ndef h(x):\n    y = 1\n"
    assert D.flow_reaches(src, "a", "d") and not D.flow_reaches(src, "d", "a") and not D.flow_reaches(src, "x", "y") and not D.flow_reaches("def (", "a", "b")


def test_densify(spark):
    v = spark.createDataFrame([("g", "a", bytearray(32)), ("g", "b", bytearray(b"\x01" + bytes(31))), ("g", "c", bytearray(b"\xff" * 32)), ("h", "d", bytearray(32)), ("g", "e", None)], "cluster string, id string, vector binary")
    for block in (2048, 1):
        assert [(r.a, r.b, r.score) for r in X.densify(v, "cluster", block=block).collect()] == [("a", "b", 1 - 1 / 256)]


# --- mutations and streams
def test_mutations(spark):
    g = graph_of(spark, [node("a", metadata={"x": "1", "y": "2"}), node("b")], [("a", "b")])
    u = M.update(g.nodes, spark.createDataFrame([("a", {"y": "3"})], "id string, metadata map<string,string>"), 9).where("id = 'a'").first()
    assert u.metadata == {"x": "1", "y": "3"} and u.updated_at == 9
    n, e = M.delete(g.nodes, g.edges, ids(spark, ["b"]), 7, hard=True)
    assert n.count() == 1 and e.count() == 0
    d = M.manifest_diff(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, hash string"), spark.createDataFrame([("b", "3"), ("c", "4")], "key string, hash string"))
    assert {(r.key, r.change) for r in d.collect()} == {("a", "insert"), ("b", "update"), ("c", "delete")}
    with pytest.raises(ValueError):
        M.guard_deletions(d, 1)
    f = spark.createDataFrame([("n", 1, 100), ("s", 1, 100), ("q", 2, 100), ("d", 2, 990), ("l", 2, 99_000)], "path string, size long, mtime long")
    m = spark.createDataFrame([("s", 1, 100, 1, False), ("q", 1, 90, 1, False), ("d", 1, 980, 1, False), ("l", 1, 100, 1, False)], "path string, size long, mtime long, version int, seed boolean")
    assert {r.path: r.action for r in M.upload_gate(f, m, 1000, 1).collect()} == {"n": "ship", "s": "skip", "q": "ship", "d": "defer", "l": "ship"}


def test_temporal_order(spark):
    d = spark.createDataFrame([("fresh", NOW), ("old", NOW - 90 * S.DAY_NS), ("zero", 0)], "id string, at long").select("id", S.temporal_boost(F.lit(1.0), NOW, F.col("at"), 30).alias("score"))
    assert [r.id for r in G.top_k(d, 3).collect()] == ["fresh", "zero", "old"]


def test_registered(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150
    assert e.entry(spark).columns == ["tool_name", "count", "p50", "p90", "p99"]


SAMPLE = ["usage_tool_latency", "usage_lane_summary", "metadata_stats", "k_hop_out", "god_objects", "bm25_top", "hamming_knn", "charge_fold", "blind_spots", "recipe_emit", "manifest_diff", "structural_motif", "corpus_scan"]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, data, name):
    import __spark_entry__ as e
    from tests.compare import compare, duck

    assert compare(spark, duck(data), data, name, e.queries()[name], e.oracle_sql()[name])[0] == "ok"


def test_change_feed_rewrites_touched_buckets_only(spark, tmp_path):
    from sparkloom.streaming import jobs

    schema = "id string, updated_at long, v int"
    base = f"file://{tmp_path}"

    def send(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/delta")
        jobs.change_feed(spark, f"{base}/delta", spark.createDataFrame([], schema).schema, f"{base}/t", f"{base}/c", bits=3).awaitTermination()

    assert jobs.current(spark, f"{base}/t") is None
    send([(f"k{i}", 1, i) for i in range(60)] + [(None, 1, 0)])
    send([("k3", 5, 33), ("k4", 0, 44), ("new", 2, 7)])
    got = {r.id: (r.updated_at, r.v) for r in jobs.current(spark, f"{base}/t").collect()}
    assert got == {f"k{i}": (1, i) for i in range(60)} | {"k3": (5, 33), "new": (2, 7)}
    versions = jobs.newest(spark, f"{base}/t")
    assert len(versions) == 8 and 1 <= sum(v == 1 for v in versions.values()) <= 3
    assert jobs.vacuum(spark, f"{base}/t") == sum(v == 1 for v in versions.values())
    assert jobs.current(spark, f"{base}/t").count() == 61


def test_activity_sessions_stay_off_the_driver(spark, data, tmp_path):
    import __spark_entry__ as e
    from sparkloom.streaming import jobs

    got = e.queries()["stream_activity_sessions"](spark, data)
    assert got.inputFiles() and got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{data}/events.parquet").count()
    base = f"file://{tmp_path}"
    events = lambda rows: spark.createDataFrame(rows, "user_id long, at string").select("user_id", F.col("at").cast("timestamp").alias("ts"))

    def send(rows):
        events([(u, t and f"2024-01-01 {t}:00") for u, t in rows]).coalesce(1).write.mode("append").parquet(f"{base}/in")
        jobs.activity_sessions(spark.readStream.schema("user_id long, ts timestamp").parquet(f"{base}/in"), f"{base}/t", f"{base}/c").awaitTermination()
        return sorted((r.user_id or 0, str(r.start)[11:16], str(r.end)[11:16], r.n) for r in jobs.sessions_of(spark, f"{base}/t").collect())

    assert jobs.sessions_of(spark, f"{base}/t") is None
    assert send([]) == []
    assert send([(1, "00:00"), (1, "00:14"), (1, "05:00"), (2, "00:00"), (None, "00:00")]) == [(0, "00:00", "00:15", 1), (1, "00:00", "00:29", 2), (1, "05:00", "05:15", 1), (2, "00:00", "00:15", 1)]
    assert send([(1, "00:28"), (2, "00:15")])[1:] == [(1, "00:00", "00:43", 3), (1, "05:00", "05:15", 1), (2, "00:00", "00:15", 1), (2, "00:15", "00:30", 1)]  # late, and just a gap apart
    assert send([(2, "00:05")])[-1] == (2, "00:00", "00:30", 3) and len(list(tmp_path.glob("t/v*"))) == 2


def test_binary_index(spark):
    from sparkloom.operators import binary_index as B

    rng = np.random.default_rng(8)
    centre = rng.integers(0, 2, 256, dtype=np.uint8)
    x = [centre ^ (rng.random(256) < 0.03) for _ in range(12)] + [rng.integers(0, 2, 256, dtype=np.uint8) for _ in range(80)]
    rows = [(f"v{i:03d}", bytearray(np.packbits(v).tobytes())) for i, v in enumerate(x)]
    d = spark.createDataFrame([*rows, ("bad", bytearray(b"x")), ("none", None)], "id string, vector binary")
    q = spark.createDataFrame([(i, v) for i, v in (rows[0], rows[50])], "qid string, vector binary")
    ix = B.build(d, 16)
    assert ix.count() == 16 * len(rows)
    exact = sorted((r.qid, r.id, r.score) for r in X.hamming_neighbours(d, q, 5).collect())
    assert sorted((r.qid, r.id, r.score) for r in B.nearest(d, ix, q, 5).collect()) == exact
    settled = {r.qid for r in B.probe(ix, q, 5).where("settled").collect()}
    assert settled == {"v000"}
    some = spark.createDataFrame([(f"v{i:03d}",) for i in range(4, 92)], "id string")
    want = sorted((r.qid, r.id) for r in X.hamming_neighbours(d.join(some, "id"), q, 5).collect())
    assert sorted((r.qid, r.id) for r in B.nearest(d, ix, q, 5, accept=some).collect()) == want
    assert B.nearest(d.limit(0), B.build(d.limit(0)), q, 5).count() == 0
    with pytest.raises(ValueError):
        B.register_format("flat", B.FORMATS["flat"])


def test_vector_scan_keeps_ties_by_id(spark):
    v = bytearray(32)
    d = spark.createDataFrame([(f"t{i:02d}", v) for i in range(30)] + [("z", bytearray(b"\xff" * 32))], "id string, vector binary").repartition(6)
    q = spark.createDataFrame([("q", v)], "qid string, vector binary")
    assert sorted(r.id for r in X.hamming_neighbours(d, q, 4).collect()) == ["t00", "t01", "t02", "t03"]
    assert X.hamming_neighbours(d, q, 40).count() == 31
    assert sorted(r.id for r in X.hamming_neighbours(d, q, 2, accept=F.col("id") > "t10").collect()) == ["t11", "t12"]


def test_exact_betweenness_on_request(spark, monkeypatch):
    monkeypatch.setattr(A, "EXACT_BETWEENNESS", 5)
    e = pairs(spark, [(f"n{i}", f"n{i + 1}") for i in range(150)])
    n = ids(spark, [f"n{i}" for i in range(151)])
    got = {r.id: r.score for r in A.betweenness(n, e, exact=True).collect()}
    assert all(got[f"n{i}"] == i * (150 - i) for i in range(151))


def test_pacing(spark):
    d = spark.createDataFrame([("a", f"c{i:03d}") for i in range(100)] + [("b", "x")], "axis string, id string")
    got = sorted(r.send_ms for r in M.pace(d, 60).where("axis = 'a'").collect())
    assert got == [i * 1000 for i in range(100)]
    w = [r.ms for r in spark.range(1, 12).select(M.backoff_ms(F.col("id").cast("int"), F.lit("k")).alias("ms")).collect()]
    assert all(0.5 * min(60_000, 1000 * 2**k) - 1 <= x <= min(60_000, 1000 * 2**k) for k, x in enumerate(w))
    assert [r.s for r in spark.createDataFrame([("1h30m",), ("7d",), ("x",), (None,), (" 1.5s ",)], "t string").select(S.duration_seconds(F.col("t")).alias("s")).collect()] == [5400.0, 604800.0, None, None, 1.5]


def test_stored_checks(spark):
    g = graph_of(spark, [node("a", "function"), node("b", "function")], [("a", "b", "CALLS")])
    empty = G.Graph(g.nodes.limit(0), g.edges.limit(0))
    check = {"name": "called", "node_type": "function", "edge_type": "CALLS", "direction": "in", "require": "present"}
    store = A.create_check(None, check, g, empty)
    assert [(r.check, r.id) for r in A.run_checks(store, g).collect()] == [("called", "a")]
    assert A.list_checks(store, "type").count() == 0
    with pytest.raises(ValueError):
        A.create_check(store, check, g, empty)
    with pytest.raises(ValueError):
        A.create_check(store, check | {"name": "other"}, g, g)


@pytest.mark.parametrize("small", [0, 200_000])
def test_strong_components_either_way(spark, monkeypatch, small):
    monkeypatch.setattr(A, "SMALL_GRAPH", small)
    rng = random.Random(11)
    es = {(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(95)} | {(f"r{i:02d}", f"r{(i + 1) % 40:02d}") for i in range(40)}
    reach = defaultdict(set)
    for a, b in es:
        reach[a].add(b)
    for _ in range(7):
        for a in list(reach):
            reach[a] |= set().union(*(reach.get(b, set()) for b in reach[a]))
    names = {x for e in es for x in e}
    want = {}
    for a in names:
        mine = {b for b in reach.get(a, ()) if a in reach.get(b, ())} | {a}
        if len(mine) > 1:
            want[a] = (min(mine), len(mine))
    got = {r.id: (r.scc, r["size"]) for r in A.scc(ids(spark, sorted(names)), pairs(spark, sorted(es))).collect()}
    assert got == want and got["r00"] == ("r00", 40)

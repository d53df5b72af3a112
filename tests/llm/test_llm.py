from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import components, conversations, leakage, neighbours, packing, sentences, sourcefiles, topics


# --- 1
def test_kinds_of_files():
    go = "package a\n\nimport \"fmt\"\n\n// Walk visits every node of the tree once.\nfunc Walk(x int) int {\n\tif x > 3 {\n\t\treturn x\n\t}\n\tfmt.Println(x)\n\treturn Walk(x + 1)\n}\n"
    k = sourcefiles.kind_of
    assert k("a/b.go", go) == ""
    assert k("a/b.go", "// This file is not generated; edit it freely.\n" + go) == ""
    assert k("a/b.go", go + 'const header = "// Code generated by x. DO NOT EDIT."\n') == ""
    assert k("a/b.go", "// Code generated by x. DO NOT EDIT.\n" + go) == "generated"
    assert k("a/b.go", go + "// end of output -- regenerate with `make x`, edits are overwritten\n") == "generated"
    assert k("third_party/x/b.go", go) == k("lib/x-1.2.3/b.go", go) == "vendored"
    assert k("a/b.go", "package a\n\n// Taken unmodified from x@1.2.3\n" + go) == "vendored"
    assert k("a/b.ts", "".join(f"export const r{i} = {{ op: {i}, path: '/v1/r{i}' }};\n" for i in range(12))) == "generated"
    assert k("a/b.js", "var a=1;" + "function f(x){return x?f(x-1):0};g.h=m=>t?!0:m.r;" * 60) == "minified"
    assert k("a/b.js", "module.exports = [\n" + "".join(f'{{"id": {i}, "name": "n{i}", "v": {i * 7}}},\n' for i in range(80)) + "];\n") == "data"
    assert k("a/b.go", "") == k("a/b.go", "  \n") == k("", "x") == ""


def test_notes_in_long_comments():
    go = "package a\n\n// Walk visits every node of the tree once.\nfunc Walk(x int) int {\n\tif x > 3 {\n\t\treturn x\n\t}\n\treturn Walk(x + 1)\n}\n"
    k, note = sourcefiles.kind_of, "Code generated by x. DO NOT EDIT."
    lines = [f"Permission is granted to use item {i} of these terms." for i in range(60)]
    long = "".join(f"// {x}\n" for x in lines)
    assert k("a/b.go", long + go) == k("a/b.go", go + long) == ""
    assert k("a/b.go", long + "\n// " + note + "\n" + go) == "generated"
    assert k("a/b.go", "/*\n" + "\n".join(lines) + "\n" + note + "\n*/\n" + go) == k("a/b.go", "/*\n" + note + "\n*/\n" + go) == "generated"
    assert k("a/b.go", go + "// " + note + "\n" + long) == k("a/b.go", go + "// " + note + "\n\n" + long) == "generated"
    assert k("a/b.go", go + "/*\n" + note + "\n" + "\n".join(lines) + "\n*/\n") == "generated"
    assert k("a/b.go", go + f'var s = "{note}"\n/* end */\n') == k("a/b.go", go + f'var g, s = "a/*", "{note}"\n/* end */\n') == ""


def test_layouts_told_apart():
    k = sourcefiles.kind_of
    chained = "var a=1," + ",".join(f"f{i}=function(x,y){{return x>y?x-{i}:g(y,x)}}" for i in range(40))
    assert k("a/b.js", chained) == "minified"
    assert k("a/b.js", "a=1," + ",".join(f"b[{i}]=c.d(e,f).g(h)" for i in range(60))) == "minified"
    assert k("a/b.py", "x=lambda a,b:[c for c in b if c!=a];" + ";".join(f"y{i}=x(z,{i}) if z else w.v(u)" for i in range(40))) == "minified"
    assert k("a/b.py", "import zlib,base64;exec(zlib.decompress(base64.b64decode('" + "aGVsbG8gd29ybGQx" * 60 + "')))") == "data"
    assert k("a/b.ts", "".join(f"export const ROUTE_{i} = makeRoute({i});\n" for i in range(12))) == ""
    assert k("a/b.rs", "".join(f"pub const LEVEL_{i}: u32 = {i};\n" for i in range(12))) == ""
    wide = "".join(f"  const total{i} = alpha.values.map((v) => v.size).filter((n) => n > {i}).reduce((p, q) => p + q, {i});\n  log('sum', total{i});\n  // step {i} of the sum ends here\n  if (total{i} > 9) return wrap(total{i}, other, third);\n" for i in range(9))
    assert k("a/b.js", "// Sums the sizes of all values.\nfunction f(alpha) {\n" + wide + "}\n") == ""
    assert sourcefiles.reemit("a;b{c;d}\ne") == ["a", "b", "c", "d", "e"]


def test_prefix_filter_is_exact():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(30, 60))]
        docs.append(base)
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = "new"
        docs.append(copy)
    s = [sourcefiles.shingles(d) for d in docs]
    common = np.array(sorted({x for a in s[:10] for x in a.tolist()}), dtype=np.int64)
    p = [set(sourcefiles.prefix(a, common).tolist()) for a in s]
    for i in range(len(s)):
        for j in range(i):
            a, b = set(s[i].tolist()), set(s[j].tolist())
            if len(a & b) >= sourcefiles.ALIKE * len(a | b):
                assert p[i] & p[j]


def _node(i, path, content, source="r", at=1, dead=0, kind="file"):
    return (i, kind, path, content, source, at, dead, "x")


NODES = "id string, type string, file_path string, content string, source string, updated_at long, tombstoned_at long, body string"


def test_file_kinds(spark):
    body = "package a\n\n" + "".join(f"// Note number {i} says what the step below does.\nfunc F{i}(a int) int {{\n\treturn a + {i}\n}}\n\n" for i in range(30))
    gen = "# Code generated by x. DO NOT EDIT.\na = 1\n"
    rows = [
        _node("a", "vendor/x/a.go", body), _node("b", "src/b.go", body), _node("c", "src/c.go", body.replace("Note number 7 ", "Note seven ")), _node("d", "src/d.go", body.replace("Note", "Remark").replace("step", "part")),
        _node("e", "gen/e.py", gen), _node("f", "src/f.py", gen, dead=5), _node("g", "src/g.py", gen, at=1), _node("g", "src/g.py", "x = compute(1)\n", at=2), _node("h", "srcx/h.py", gen), _node("i", "src/i.py", None),
        _node(None, "src/j.py", gen), _node("k", None, gen), _node("l", "any/l.py", gen, source="other"), _node("m", "src/m.py", gen, kind="thought"),
    ]
    n = spark.createDataFrame(rows, NODES)
    runs = spark.createDataFrame([("r", ["src/", None], {"vendor": ["./src/c.go", None, "gone.go"], "empty": None}), (None, ["x"], {"a": ["src/b.go"]}), ("other", None, None)], "repo string, package_prefixes array<string>, excluded_samples map<string,array<string>>")
    got = {r.node_id: (r.kind, r.caught_by) for r in sourcefiles.file_kinds(n, runs).collect()}
    assert got == {"b": ("vendored", None), "c": ("vendored", "vendor"), "l": ("generated", None)}
    assert sourcefiles.file_kinds(n.limit(0), runs).count() == 0


# --- 2
LANE = "session_id string, agent_id string, uuid string, parent_uuid string, record_type string, record_ts string, tool_name string, is_meta boolean, is_api_error boolean, model string, extra int"


def _row(u, p, kind, ts, s="s", a="", tool="", meta=False, err=False, model="m"):
    return (s, a, u, p, kind, ts, tool, meta, err, model, 1)


def test_conversations(spark):
    t = "2026-01-01T10:00:0{}Z".format
    rows = [
        _row("u1", None, " Human ", t(0)), _row("a1", "u1", "assistant", t(0)), _row("a1", "u1", "ASSISTANT", "2026-01-01T12:00:00+02:00"), _row("t1", "a1", "assistant", t(1), tool="Bash"), _row("u2", "t1", "user", t(2)), _row("a2", "u2", "agent_message", t(2)),
        _row("b1", "", "user", t(0), a="lost"), _row("b2", "gone", "assistant", t(1), a="lost"),
        _row("c1", "", "user", t(0), a="open"), _row("c2", "c1", "assistant", t(1), a="open"), _row("c3", "c2", "user", t(2), a="open"),
        _row("d1", "", "assistant", t(0), a="turned"), _row("d2", "", "user", t(1), a="turned"), _row("d3", "", "assistant", t(2), a="turned"),
        _row("e1", "", "user", "unknown", a="bad"), _row("e2", "", "assistant", t(1), a="bad"),
        _row("f1", "", "user", t(0), a="synth"), _row("f2", "f1", "assistant", t(1), a="synth", model="<synthetic>"),
        _row("g1", "", "user", t(0), s=None), _row("h1", "h2", "user", t(0), a="ring"), _row("h2", "h1", "assistant", t(0), a="ring"),
        _row("i1", "", "user", "2026-01-01T10:59:59Z", a="long"), _row("i2", "i1", "assistant", "2026-01-01T11:00:01Z", a="long"), _row("i3", "i2", "user", "2026-01-02T11:00:01Z", a="long"), _row("i4", "i3", "assistant", "2026-01-03T11:00:01Z", a="long"),
    ]
    d = spark.createDataFrame(rows, LANE)
    got = defaultdict(list)
    for r in conversations.conversations(d).orderBy("turn_no").collect():
        got[r.agent_id].append((r.turn_no, r.uuid))
    assert got == {"": [(1, "u1"), (2, "a1"), (3, "u2"), (4, "a2")], "ring": [(1, "h1"), (2, "h2")], "long": [(1, "i1"), (2, "i2"), (3, "i3"), (4, "i4")]}
    assert conversations.conversations(d.limit(0)).count() == 0


def test_rows_of_one_uuid_are_one_row(spark):
    rows = [
        _row("u1", "", "user", "2026-01-01T10:00:00Z"), _row("a1", "u1", "assistant", "2026-01-01T10:00:05Z"), _row("a1", "u1", "assistant", "2026-01-01T12:00:05Z"), _row("a1", "", "system", "2026-01-01T13:00:05Z"),
        _row("", "u1", "system", ""), _row("", None, "user", "2026-01-01T09:00:00Z"), _row(None, "gone", "system", "", a="x"), _row("x1", "", "user", "2026-01-01T10:00:00Z", a="x"), _row("x2", "x1", "assistant", "2026-01-01T10:00:01Z", a="x"),
    ]
    got = [(r.agent_id, r.turn_no, r.uuid) for r in conversations.conversations(spark.createDataFrame(rows, LANE)).orderBy("turn_no").collect()]
    assert got == [("", 1, "u1"), ("", 2, "a1")]


def test_cycles_are_told(spark):
    t = "2026-01-01T10:00:0{}Z".format
    rows = [_row("u1", "a1", "user", t(0)), _row("a1", "u1", "assistant", t(1)), _row("u2", "", "user", t(2)), _row("x", "u2", "system", t(3)), _row("a2", "x", "assistant", t(4)), _row("a3", "x", "assistant", t(4))]
    d = spark.createDataFrame(rows, LANE)
    assert [(r.uuid, r.depth, r.state) for r in conversations.conversations(d).orderBy("turn_no").collect()] == [("u1", None, "cycle"), ("a1", None, "cycle"), ("u2", 0, "root"), ("a2", 2, "root"), ("a3", 2, "root")]
    got = sorted((r.leaf, r.depth, r.uuid) for r in conversations.paths(d).collect())
    assert got == [("a2", 0, "u2"), ("a2", 2, "a2"), ("a3", 0, "u2"), ("a3", 2, "a3")]
    assert conversations.paths(d.limit(0)).count() == 0


@pytest.mark.parametrize("size", [100_000, 20])
def test_pointer_jumping(spark, monkeypatch, size):
    monkeypatch.setattr(conversations, "SLICE_ROWS", size)
    n = 300
    rows = [("g", f"n{i:04d}", f"n{i - 1:04d}" if i else "") for i in range(n)] + [("g", "x", "y"), ("g", "y", "z"), ("g", "z", "x"), ("g", "below", "x"), ("g", "a", "zz"), ("g", "zz", "a"), ("g", "o", "nowhere"), ("g", "q", "o"), ("h", "p", "n0001")]
    r = {(x.g, x.uuid): x for x in conversations.resolve_parents(spark.createDataFrame(rows, "g string, uuid string, parent string"), ["g"]).collect()}
    assert len(r) == len(rows)
    assert all(r["g", f"n{i:04d}"].depth == i and r["g", f"n{i:04d}"].root == "n0000" for i in range(n))
    assert {r["g", k].state for k in ("x", "y", "z", "below", "a", "zz")} == {"cycle"} and r["g", "o"].state == "orphan" and r["h", "p"].state == "orphan"
    assert r["g", "q"].state == "orphan" and r["g", "q"].depth == 1 and r["g", "q"].root == "o"


def test_long_lane_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SLICE_ROWS", 30)
    rows = [_row(f"m{i:03d}", f"m{i - 1:03d}" if i else "", "assistant" if i % 2 else "user", "2026-01-01T10:00:00Z") for i in range(400)]
    rng = random.Random(3)
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, LANE)
    assert [(r.turn_no, r.uuid) for r in conversations.conversations(d).orderBy("turn_no").collect()] == [(i + 1, f"m{i:03d}") for i in range(400)]
    assert conversations.paths(d).where("leaf = 'm399'").count() == 400


# --- 3
def test_topics(spark):
    rng = np.random.default_rng(1)
    rows, truth = [], {}

    def flip(v, k):
        w = v.copy()
        w[rng.choice(256, k, replace=False)] ^= 1
        return w

    for c in range(12):
        centre = rng.integers(0, 2, 256)
        members = [flip(centre, 12) for _ in range(4 + c)]
        for j, m in enumerate(members):
            rows.append((f"{c:02d}-{j:02d}", bytearray(np.packbits(m).tobytes()), 5, "p"))
            if len(members) >= 5:
                truth[f"{c:02d}-{j:02d}"] = f"{c:02d}-00"
    same = bytearray(np.packbits(rng.integers(0, 2, 256)).tobytes())
    for j in range(6):
        rows.append((f"z-{j}", same, 1, "p"))
        truth[f"z-{j}"] = "z-0"
    rows += [("00-00", bytearray(32), 1, "old"), ("n1", None, 1, "p"), ("n2", bytearray(b"ab"), 1, "p"), ("n3", bytearray(32), 1, "p"), (None, same, 1, "p"), ("04-00", rows[8][1], None, "p")]
    d = spark.createDataFrame(rows, "id string, vector binary, updated_at long, fields string")
    got = {r.node_id: r.topic_key for r in topics.topics(d).collect()}
    assert got == truth
    rep = {r.topic_key: r for r in topics.topic_report(d).collect()}
    assert rep["z-0"]["size"] == 6 and rep["z-0"].exemplars == ["z-0", "z-1", "z-2"]
    assert topics.topics(d.limit(0)).count() == 0


def test_topics_reach_over_components(spark):
    rng = np.random.default_rng(3)

    def group(centre, n, at):
        out = np.repeat(centre[None, :], n, axis=0)
        for i in range(n):
            out[i, at + 6 * i : at + 6 * i + 6] ^= 1
        return out

    rows, truth = [], {}
    for k in range(3):  # two tight sub-groups of 12, at most 32 apart
        a = rng.integers(0, 2, 256)
        b = a.copy()
        b[200:220] ^= 1
        for j, v in enumerate([*group(a, 12, 0), *group(b, 12, 80)]):
            rows.append((f"{k}-{j:02d}", bytearray(np.packbits(v).tobytes()), 1))
            truth[f"{k}-{j:02d}"] = f"{k}-00"
    # two tight groups of which only some are similar over the border stay two topics
    a = rng.integers(0, 2, 256)
    b = a.copy()
    b[200:255] ^= 1
    for k, g in (("x", group(a, 12, 0)), ("y", group(b, 12, 80))):
        for j, v in enumerate(g):
            rows.append((f"{k}-{j:02d}", bytearray(np.packbits(v).tobytes()), 1))
            truth[f"{k}-{j:02d}"] = f"{k}-00"
    d = spark.createDataFrame(rows, "id string, vector binary, updated_at long")
    assert {r.node_id: r.topic_key for r in topics.topics(d).collect()} == truth


def test_loose_topics_among_many_records(spark, monkeypatch):
    """Topics of five near the threshold: nearly all of their pairs are found although few meet in any one order."""
    monkeypatch.setattr(topics, "WINDOW", 64)
    rng = np.random.default_rng(5)
    n, k = 20_000, 150
    bits = rng.integers(0, 2, (n, 256), dtype=np.uint8)
    for t in range(k):
        bits[5 * t : 5 * t + 5] = bits[5 * t] ^ (rng.random((5, 256)) < 0.125)
    packed = np.packbits(bits, axis=1)
    d = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(packed)], "nid long, vector binary")
    near = {r.q: {x & ((1 << topics.SHIFT) - 1) for x in r.near} for r in topics.neighbour_lists(d.repartition(4), 64).collect()}
    pairs = [(a, b) for t in range(k) for a in range(5 * t, 5 * t + 5) for b in range(5 * t, a) if (bits[a] != bits[b]).sum() <= 64]
    assert sum(b in near.get(a, ()) for a, b in pairs) >= 0.95 * len(pairs)
    assert topics.orders_for(10**5, 64, 512, 0.7) <= 12 and topics.orders_for(10**6, 64, 512, 0.7) <= 30 and topics.orders_for(300, 64, 512, 0.7) == 1


def test_large_components_are_cut_and_joined(spark, monkeypatch):
    monkeypatch.setattr(topics, "COMPONENT_ROWS", 40)
    rng = np.random.default_rng(6)
    rows, truth = [], {}
    for name, n in (("a", 150), ("b", 60), ("c", 12)):
        centre = rng.integers(0, 2, 256, dtype=np.uint8)
        for j in range(n):
            rows.append((f"{name}-{j:03d}", bytearray(np.packbits(centre ^ (rng.random(256) < 0.06)).tobytes()), 1))
            truth[rows[-1][0]] = f"{name}-000"
    d = spark.createDataFrame(rows, "id string, vector binary, updated_at long")
    assert {r.node_id: r.topic_key for r in topics.topics(d).collect()} == truth


def test_bridge_is_in_no_topic():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2, 256)
    b = a.copy()
    b[:110] ^= 1
    mid = a.copy()
    mid[:55] ^= 1
    bits = np.stack([a, a, a, a, a, b, b, b, b, b, mid])
    for i in range(10):
        bits[i, 200 + i] ^= 1
    x = np.packbits(bits, axis=1)
    t = topics.topics_of(x, np.ones(11, dtype=int), [np.arange(11)], 64)
    assert {0, 1, 2, 3, 4} <= set(t[0].tolist()) | set(t[1].tolist()) and len(t) == 2
    for m in t:
        assert (topics._distance(x[m], x[m]) <= 64).all()


def test_spanning_forest(spark):
    rng = random.Random(5)
    e = {(a, b): rng.randint(1, 30) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.06}
    forest, _ = topics.minimum_spanning_forest(spark.createDataFrame([(a, b, w) for (a, b), w in e.items()], "u long, v long, w int"))
    par = list(range(60))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    total = 0
    for (a, b), w in sorted(e.items(), key=lambda x: (x[1], x[0])):
        if find(a) != find(b):
            par[find(a)] = find(b)
            total += w
    assert forest.df.agg(F.sum("w")).first()[0] == total


# --- 4
def test_groups(spark):
    rng = random.Random(7)
    names = [f"n{i:03d}" for i in range(200)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(140)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(150)] + [("hub", f"s{i:03d}") for i in range(200)] + [(None, "x"), ("y", None), ("q", "q")]
    par: dict = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            ra, rb = find(a), find(b)
            par[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.group_id for r in components.connected_groups(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {x: find(x) for x in par}
    assert components.connected_groups(spark.createDataFrame([], "a string, b string")).count() == 0


def test_accepted_links(spark):
    c = spark.createDataFrame([("r1", " AB ", "cd\n", 0.9), ("r1", "ab", "ef", 0.5), ("r1", "ab", "gh", float("nan")), ("r1", "ab", "gh", None), ("r2", "ab", "ij", 1.0), ("r3", "ab", "kl", 1.0), ("r1", "ab", "AB", 0.9), ("r1", None, "x", 0.9), ("r1", " ", "x", 0.9)], "report_id string, medoid_a string, medoid_b string, score double")
    r = spark.createDataFrame([("r1", 0.8), ("r3", None), (None, 0.1)], "report_id string, merge_threshold double")
    assert [(x.node_id, x.group_id) for x in components.match_groups(c, r).orderBy("node_id").collect()] == [("ab", "ab"), ("cd", "ab")]


# --- 5
def test_neighbours_recall_and_copies(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([c + 0.35 * rng.normal(size=(m, 64)) / 8 * 4 for c, m in ((rng.normal(size=64), m) for m in (3, 8, 40, 90, 200))])
    rows = [(f"v{i:04d}", [float(y) for y in v], 1, 0) for i, v in enumerate(x)]
    rows += [(f"w{i}", [1.0] * 64, 1, 0) for i in range(9)] + [("v0000", [1.0], 0, 0), ("bad1", None, 1, 0), ("bad2", [0.0] * 64, 1, 0), ("bad3", [float("nan")] + [1.0] * 63, 1, 0), ("bad4", [1.0] * 63, 1, 0), (None, [1.0] * 64, 1, 0)]
    d = spark.createDataFrame(rows, "id string, query_vector array<float>, updated_at long, ef_search int")
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(d).collect()}
    ids = [r[0] for r in rows[: len(x)]]
    u = x.astype(np.float32) / np.linalg.norm(x.astype(np.float32), axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    truth = {tuple(sorted((ids[i], ids[j]))) for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.8}
    mine = {p for p in got if p[0][0] == "v" and p[1][0] == "v"}
    assert len(mine & truth) >= 0.9 * len(truth) and len(mine - truth) <= 0.1 * len(truth)
    copies = {p for p in got if p[0][0] == "w"}
    assert copies == {tuple(sorted((f"w{i}", f"w{j}"))) for i in range(9) for j in [k for k in range(9) if k != i][:5]}
    assert neighbours.similar_pairs(d.limit(0)).count() == 0


# --- 6
@pytest.mark.parametrize("capacity", [7, 64, 512])
def test_plan_takes_every_item(capacity):
    rng = random.Random(capacity)
    h = defaultdict(int)
    for _ in range(3000):
        h[min(capacity, max(1, int(rng.lognormvariate(np.log(capacity / 3), 0.8))))] += 1
    plan = packing.plan_containers(h, capacity)
    back = defaultdict(int)
    for lengths, n in plan:
        assert n > 0 and sum(lengths) <= capacity
        for k in lengths:
            back[k] += n
    assert dict(back) == dict(h)
    assert sum(n for _, n in plan) <= 1.08 * sum(k * v for k, v in h.items()) / capacity + 1


def test_nnls():
    a, x = np.random.default_rng(0).random((12, 6)), np.array([0, 1.5, 0, 2, 3, 0])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)


def test_packing_of_one_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 50)
    docs = spark.createDataFrame([(i, "word") for i in range(301)] + [(1000, "word " * 900)], "doc_id long, text string")
    specs = spark.createDataFrame([(1, 16)], "spec_id int, capacity_tokens int")
    p = packing.pack(docs, specs).toPandas()
    assert not p.duplicated(["container_id", "position"]).any() and (p.groupby("container_id").n_tokens.sum() <= 16).all() and set(p.doc_id) == {*range(301), 1000}
    assert [(r.spec_id, r.enough) for r in packing.fill_report(packing.pack(docs, specs), specs).collect()] == [(1, True)]


def test_packing(spark):
    rows = [(i, "word " * (i % 37 + 1), "x") for i in range(200)] + [(900, "long " * 500, "x"), (901, None, "x"), (902, "", "x"), (903, " \n ", "x"), (None, "y", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spec_id string")
    specs = spark.createDataFrame([(1, 64), (2, 300), (3, 0), (None, 5)], "spec_id int, capacity_tokens int")
    p = packing.pack(docs, specs).toPandas()
    sizes = {r.doc_id: r.n_tokens for r in packing.token_counts(docs).collect()}
    for spec, cap in ((1, 64), (2, 300)):
        q = p[p.spec_id == spec]
        assert (q.groupby("container_id").n_tokens.sum() <= cap).all() and q.groupby("doc_id").n_tokens.sum().to_dict() == sizes
        whole = q[q.doc_id != 900]
        assert not whole.duplicated("doc_id").any() and not q.duplicated(["container_id", "position"]).any()
        assert (q.sort_values("start_token").groupby("doc_id").apply(lambda g: (g.start_token.diff().fillna(g.n_tokens.shift()).dropna() == g.n_tokens.shift().dropna()).all(), include_groups=False)).all()
    assert set(p.spec_id) == {1, 2} and packing.pack(docs.limit(0), specs).count() == 0


# --- 7
ITEM = "Given that the outer reader holds nine partial entries, the second linker must decide which of the marked segments is rewritten before anything else is merged today."


def test_leaks():
    m = leakage.Matcher([(1, ITEM, "en"), (2, "short one here", None), (3, None, "en"), (4, ITEM, None), (5, "请用说明为什么在高负载下分段与快照来得太晚假设保存了四个会话而快照来得太晚假设保存了六个节点", "zh")])
    words = ITEM.split()
    hit = lambda t: {x[0] for x in m.find(t)}
    assert hit("Intro. " + " ".join(words[3:16]) + " outro") == {1, 4}
    assert hit("Intro. " + " ".join(words[3:15]) + " outro") == set()
    assert hit("x " + " ".join(words[3:16]).upper().replace(" ", "\n> ") + " y") == {1, 4}
    assert hit(" ".join(f"<b>{w}</b>" if i % 3 else w.replace("e", "e​") for i, w in enumerate(words[3:16]))) == {1, 4}
    loose = words[2:24]
    loose[7], loose[15] = "other", "thing"
    assert hit(" ".join(loose)) == {1, 4}
    loose[11] = "third"
    assert hit(" ".join(loose)) == set()
    assert hit("A short, one here!") == {2} and hit("A shorter one here") == set()
    zh = "请用说明为什么在高负载下分段与快照来得太晚假设保存了四个会话而快照来得太晚假设保存了六个节点"
    assert hit("前言，" + zh[5:20] + " ，" + zh[20:35] + "。") == {5} and hit(zh[5:34]) == set()
    t = "pre " + " ".join(words[3:16]) + " post"
    (_, s, e, _), *_ = m.find(t)
    assert t[s:e] == " ".join(words[3:16]).rstrip(",.") or t[s:e].startswith(words[3])
    assert hit("") == set() and leakage.Matcher([]).find("x") == []


def test_leaks_across_long_markup():
    m = leakage.Matcher([(1, ITEM, "en", "outer reader"), (2, "one of two words only here", None, "Zed")])
    words = ITEM.split()
    for n in (10, 400, 5000):
        long = "x" * n
        for mark in (f'<span title="{long} > {long}">', f"<!-- {long}, a > b -->", f"<span class={long}>", f"<div\n  data-a='{long}'\n  hidden>", f"[see]({long}) "):
            got = m.find("Intro. " + " ".join(words[3:9]) + " " + mark.replace("[see]", "") .replace("(", "](") + " ".join(words[9:16]) + " outro")
            assert [g[0] for g in got] == [1], mark[:20]
    assert m.find("a < b and " + " ".join(words[3:16]) + ", so c > d. Outer Reader.")[0][3]
    assert not m.find(" ".join(words[8:24]) + " louter readers")[0][3]
    assert m.find("<!-- " * 20000 + "<a " * 20000 + "](" * 20000 + "&" * 20000) == []


def test_leaks_table(spark):
    docs = spark.createDataFrame([(1, ITEM, "q"), (2, None, "q"), (3, " ", "q"), (4, "nothing of it", "q"), (None, ITEM, "q")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, ITEM, None, "a"), (8, None, "en", "b"), (9, ITEM, "en", None)], "item_id long, text string, lang string, answer string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(docs, items).collect()} == {(1, 7), (1, 9)}
    assert leakage.leaked_items(docs.limit(0), items).count() == 0 and leakage.leaked_items(docs, items.limit(0)).count() == 0


# --- 8
CASES = [
    ("Dr. Vos met K. L. Ames at 9 a.m. and left. See Fig. 3 and No. 4. It was v1.2.3, e.g. in a.b.py! Why?", ["Dr. Vos met K. L. Ames at 9 a.m. and left.", "See Fig. 3 and No. 4.", "It was v1.2.3, e.g. in a.b.py!", "Why?"]),
    ('"Keep it. Never touch it!" was all he left. She said: "It is late." Then he went (nobody asked. Why?).', ['"Keep it. Never touch it!" was all he left.', 'She said: "It is late."', "Then he went (nobody asked. Why?)."]),
    ("Hm... Foo still runs?! It is.Then it ends. Call a.Bar() now...and then stop.", ["Hm... Foo still runs?!", "It is.", "Then it ends.", "Call a.Bar() now...and then stop."]),
    ("# Head. Line\nText one. Text\ntwo.\n\n- item one. Same item.\n- item two\n\n1. first\n2. second\n\n```\ncode. More.\n\nx\n```", ["# Head. Line", "Text one.", "Text\ntwo.", "- item one. Same item.", "- item two", "1. first", "2. second", "```\ncode. More.\n\nx\n```"]),
    ("It holds the chunk in No.\n15. Once it ends, stop.", ["It holds the chunk in No.\n15.", "Once it ends, stop."]),
    ("Am 28. März kam z. B. Herr A. Dann usw. ohne Ende. Er sagte: „Los.“ Ende.", ["Am 28. März kam z. B. Herr A. Dann usw. ohne Ende.", "Er sagte: „Los.“", "Ende."]),
    ("Le mot : « Attention, c’est vide. » Où ? « Où est-il ? » demande M. Roy, p. ex. ici.", ["Le mot : « Attention, c’est vide. »", "Où ?", "« Où est-il ? » demande M. Roy, p. ex. ici."]),
    ("图谱在。“连边吗？”Bex在a.py里问道。写道：“日志太晚。”如果……随后恢复。", ["图谱在。", "“连边吗？”Bex在a.py里问道。", "写道：“日志太晚。”", "如果……随后恢复。"]),
    ("「空である。」とAさんは書いた。なぜか？終わり。", ["「空である。」とAさんは書いた。", "なぜか？", "終わり。"]),
    ("डॉ. Vux ने लिखा। समीक्षक ने कहा, “खाली है।” क्या? 5.1 मि.से. लगे।", ["डॉ. Vux ने लिखा।", "समीक्षक ने कहा, “खाली है।”", "क्या?", "5.1 मि.से. लगे।"]),
    ("كتب د. Vux أن الرسم يضيع. هل يبقى؟ نعم!", ["كتب د. Vux أن الرسم يضيع.", "هل يبقى؟", "نعم!"]),
    ("ข้อมูลต่างๆ ในกราฟหาย ทำไมโหนดหาย", ["ข้อมูลต่างๆ ในกราฟหาย", "ทำไมโหนดหาย"]),
    ("> quoted one. More\n> of it here. End\n", ["> quoted one.", "More\n> of it here.", "End"]),
    ("  \n \t\n", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.units_of(text)] == want


@pytest.mark.parametrize("n", [20, 320, 5000])
def test_long_tokens(n):
    long = "b" * n
    for head in (f"a@{long}", f"https://{long}", f"See c@{long}.x"):
        assert [head + ".Org today." for _ in "x"] == [(head + ".Org today. End.")[a:b] for a, b in sentences.units_of(head + ".Org today. End.")][:1]
    assert len(sentences.units_of(f"One x@y {long}.Then it ends.")) == 2


def test_units_cover_and_do_not_overlap(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in d.where("text is not null").select("doc_id", "text").collect()}
    got = defaultdict(list)
    for r in sentences.sentence_units(d).collect():
        got[r.doc_id].append((r.start_char, r.end_char))
    for i, t in texts.items():
        at = 0
        for a, b in sorted(got[i]):
            assert a >= at and not t[at:a].strip() and t[a:b] == t[a:b].strip() != ""
            at = b
        assert not t[at:].strip()


def test_registered_queries_run(spark, data):
    from sparkloom.llm import queries

    for name, fn in queries.QUERIES.items():
        assert fn(spark, data).count() >= 0, name
    cols = {"p1_found": ["node_id"], "p2_found": ["session_id", "agent_id", "turn_no", "uuid"], "p3_found": ["node_id", "topic_key"], "p4_found": ["node_id", "group_id"], "p5_found": ["id_a", "id_b"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "start_char", "end_char"]}
    for name, c in cols.items():
        assert queries.QUERIES[name](spark, data).columns == c

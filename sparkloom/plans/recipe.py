"""The small dataflow language: text to tokens to rules to one DataFrame program."""

from __future__ import annotations

import difflib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.functions import scalars as S
from sparkloom.operators.graph import Graph, closure, steps
from sparkloom.runtime import materialize

MAX_DEPTH = 32
RULES = ("select", "traverse", "walk", "filter", "bind", "group_by", "emit", "lookup", "link", "source_ref")
GRAPH_FUNCTIONS = {"has_edge": 2, "has_ancestor": 3, "children_concat": 3, "ancestors_concat": 3, "heading_path": 3, "subtree_concat": 4}
NODE_FIELDS = {"id": "id", "type": "type", "name": "symbol_name", "symbol_name": "symbol_name", "summary": "summary", "description": "description", "content": "content", "source": "source", "status": "status"}


class RecipeError(ValueError):
    """A program that cannot be read or does not fit the graph; the message begins with line:column."""


# --- tokens -------------------------------------------------------------------------------------
_TOKENS = re.compile(
    r"""(?P<ws>[ \t\r]+|\#[^\n]*)|(?P<nl>\n)|(?P<str>"(?:[^"\\\n]|\\.)*")|(?P<rel>--\[[^\]\n]*\]-->)|(?P<arrow>-->)|(?P<assign>:=)|(?P<match>~=|!~)|(?P<var>\$[A-Za-z_]\w*)|(?P<ident>[A-Za-z_][\w-]*)|(?P<num>\d+)|(?P<punct>[{}(),.])"""
)


@dataclass
class Token:
    kind: str
    value: str
    line: int
    col: int


def tokenize(src: str) -> list[Token]:
    out, i, line, start = [], 0, 1, 0
    after_match = False
    while i < len(src):
        col = i - start + 1
        if after_match and src[i] == "/":
            j = i + 1
            while j < len(src) and src[j] not in "/\n":
                j += 2 if src[j] == "\\" else 1
            if j >= len(src) or src[j] != "/":
                raise RecipeError(f"{line}:{col}: unterminated pattern")
            out.append(Token("regex", src[i + 1 : j].replace("\\/", "/"), line, col))
            i, after_match = j + 1, False
            continue
        if src[i] == "{" and out and out[-1].kind == "ident" and out[-1].value in ("where", "filter"):
            try:
                _, used = json.JSONDecoder().raw_decode(src[i:])
            except json.JSONDecodeError as e:
                raise RecipeError(f"{line}:{col}: bad predicate: {e.msg}") from None
            out.append(Token("json", src[i : i + used], line, col))
            line += src[i : i + used].count("\n")
            i += used
            continue
        m = _TOKENS.match(src, i)
        if not m:
            raise RecipeError(f"{line}:{col}: unexpected character {src[i]!r}")
        k = m.lastgroup
        if k == "nl":
            line, start = line + 1, m.end()
        if k not in ("ws",):
            v = m.group()
            if k == "str":
                v = re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t", "r": "\r"}.get(x[1], x[1]), v[1:-1])
            elif k == "rel":
                v = v[3:-4]
            if k != "nl":
                out.append(Token(k, v, line, col))
                after_match = k == "match"
            else:
                out.append(Token("nl", "\n", line - 1, col))
        i = m.end()
    out.append(Token("end", "", line, i - start + 1))
    return out


# --- rules --------------------------------------------------------------------------------------
@dataclass
class Expr:
    kind: str  # text, path, call, match
    value: object = None
    args: list = field(default_factory=list)


@dataclass
class Rule:
    kind: str
    at: str
    a: dict


class Parser:
    def __init__(self, src: str):
        self.t, self.i = tokenize(src), 0

    def peek(self) -> Token:
        return self.t[self.i]

    def fail(self, t: Token, what: str):
        raise RecipeError(f"{t.line}:{t.col}: {what}")

    def take(self, kind: str, what: str, value: str | None = None) -> Token:
        t = self.peek()
        if t.kind != kind or (value is not None and t.value != value):
            self.fail(t, f"expected {what}, got {t.value!r}")
        self.i += 1
        return t

    def word(self, w: str) -> bool:
        if self.peek().kind == "ident" and self.peek().value == w:
            self.i += 1
            return True
        return False

    def skip(self) -> None:
        while self.peek().kind == "nl":
            self.i += 1

    def program(self) -> list[Rule]:
        out = []
        self.skip()
        while self.peek().kind != "end":
            t = self.take("ident", "a rule")
            if t.value not in RULES:
                self.fail(t, f"unknown rule {t.value!r}; one of {', '.join(RULES)}")
            out.append(Rule(t.value, f"{t.line}:{t.col}", getattr(self, "r_" + t.value)()))
            if self.peek().kind not in ("nl", "end"):
                self.fail(self.peek(), f"unexpected {self.peek().value!r} after {t.value}")
            self.skip()
        return out

    def var_as(self, must: bool) -> str | None:
        if self.word("as"):
            return self.take("var", "$var after 'as'").value
        if must:
            self.fail(self.peek(), "expected 'as $var'")
        return None

    def tree(self, after: str) -> dict:
        t = self.peek()
        if t.kind != "json":
            self.fail(t, f"predicate after {after!r} must be a JSON tree in braces")
        self.i += 1
        return check_tree(json.loads(t.value), f"{t.line}:{t.col}")

    def r_select(self) -> dict:
        kind = self.take("ident", "a node type after 'select'").value
        return {"type": kind, "where": self.tree("where") if self.word("where") else None}

    def r_traverse(self) -> dict:
        edge = self.take("ident", "an edge type after 'traverse'").value
        d = self.take("ident", "'out' or 'in'")
        if d.value not in ("out", "in"):
            self.fail(d, f"bad direction {d.value!r}")
        return {"edge": edge, "dir": d.value, "as": self.var_as(False)}

    def r_walk(self) -> dict:
        return {"edge": self.take("ident", "an edge type after 'walk'").value, "as": self.var_as(False)}

    def r_filter(self) -> dict:
        return {"where": self.tree("filter")}

    def r_bind(self) -> dict:
        v = self.take("var", "$var after 'bind'").value
        self.take("assign", "':='")
        return {"var": v, "expr": self.expr()}

    def r_group_by(self) -> dict:
        return {"key": self.expr()}

    def r_source_ref(self) -> dict:
        return {"ref": self.expr()}

    def r_emit(self) -> dict:
        kind = self.take("ident", "a node type after 'emit'").value
        self.take("punct", "'{'", "{")
        fields = {}
        self.skip()
        while not (self.peek().kind == "punct" and self.peek().value == "}"):
            f = self.take("ident", "a field name")
            if self.peek().kind != "assign":
                self.fail(self.peek(), f"expected ':=' after field {f.value!r}")
            self.i += 1
            fields[f.value] = self.expr()
            self.skip()
        self.i += 1
        return {"type": kind, "fields": fields, "as": self.var_as(False)}

    def r_lookup(self) -> dict:
        kind = self.take("ident", "a node type after 'lookup'").value
        if not self.word("by"):
            self.fail(self.peek(), "expected 'by'")
        return {"type": kind, "identity": self.expr(), "as": self.var_as(True)}

    def r_link(self) -> dict:
        a = self.expr()
        rel = self.take("rel", "'--[rel]-->' after the source of a link").value
        return {"from": a, "rel": rel, "to": self.expr()}

    def expr(self) -> Expr:
        e = self.primary()
        if self.peek().kind == "match":
            op = self.take("match", "~=").value
            p = self.take("regex", f"/pattern/ after {op}")
            try:
                S.check_pattern(p.value)
            except ValueError as x:
                self.fail(p, str(x))
            return Expr("match", (op, p.value), [e])
        return e

    def primary(self) -> Expr:
        t = self.peek()
        if t.kind in ("str", "num"):
            self.i += 1
            return Expr("text", t.value)
        if t.kind == "regex":
            self.i += 1
            return Expr("text", t.value)
        if t.kind in ("var", "ident"):
            self.i += 1
            if t.kind == "ident" and self.peek().value == "(":
                return self.call(t)
            path = [t.value]
            while self.peek().kind == "punct" and self.peek().value == ".":
                self.i += 1
                path.append(self.take("ident", "a field name after '.'").value)
            return Expr("path", path)
        self.fail(t, f"unexpected {t.value!r} in an expression")

    def call(self, t: Token) -> Expr:
        self.i += 1
        args = []
        while self.peek().value != ")":
            args.append(self.expr())
            if self.peek().value == ",":
                self.i += 1
            elif self.peek().value != ")":
                self.fail(self.peek(), "expected ',' or ')'")
        self.i += 1
        n = len(args)
        if t.value == "match_group":
            least, most = 3, 3
        elif t.value in GRAPH_FUNCTIONS:
            least = most = GRAPH_FUNCTIONS[t.value]
        elif t.value in S.BUILTINS:
            least, most, _ = S.BUILTINS[t.value]
        else:
            near = difflib.get_close_matches(t.value, [*S.BUILTINS, *GRAPH_FUNCTIONS, "match_group"], 1)
            self.fail(t, f"unknown function {t.value!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        if n < least or (most is not None and n > most):
            self.fail(t, f"{t.value} takes {least} arguments, got {n}")
        return Expr("call", t.value, args)


LEAVES = {"kind": {"of", "is"}, "matches": {"of", "regex"}, "equals": {"of", "value"}, "exists": {"of"}, "compare": {"of", "op", "value"}, "ancestor": {"edge", "where"}, "descendant": {"edge", "where"}}


def check_tree(w: dict, at: str) -> dict:
    """Refuses unknown composers, leaves and keys of a predicate tree; leaves on one node hold together."""
    if not isinstance(w, dict) or not w:
        raise RecipeError(f"{at}: a predicate is an object with at least one key")
    for k, v in w.items():
        if k in ("all", "any"):
            if not isinstance(v, list) or not v:
                raise RecipeError(f"{at}: {k} takes a list")
            for x in v:
                check_tree(x, at)
        elif k == "not":
            check_tree(v, at)
        elif k in LEAVES:
            extra = set(v) - LEAVES[k]
            if extra:
                raise RecipeError(f"{at}: {k} does not know {sorted(extra)}")
            if k == "matches":
                try:
                    S.check_pattern(v["regex"])
                except ValueError as e:
                    raise RecipeError(f"{at}: {e}") from None
            if k in ("ancestor", "descendant") and v.get("where"):
                check_tree(v["where"], at)
        else:
            raise RecipeError(f"{at}: unknown predicate {k!r}; one of all, any, not, {', '.join(LEAVES)}")
    return w


def parse(src: str) -> list[Rule]:
    return Parser(src).program()


# --- compiling ----------------------------------------------------------------------------------
#: Names of one kind that a graph's vocabulary may hold; a graph with more is refused, never read in part.
MAX_VOCABULARY = 1_000_000


def census(g: Graph) -> dict[str, set[str]]:
    """Node types, edge types and metadata keys of a graph: its vocabulary, refused beyond MAX_VOCABULARY names of a kind."""

    def names(what: str, d: DataFrame) -> set[str]:
        got = {r[0] for r in d.distinct().limit(MAX_VOCABULARY + 1).toLocalIterator()}
        if len(got) > MAX_VOCABULARY:
            raise RecipeError(f"1:1: the graph has more than {MAX_VOCABULARY} names of the kind {what}")
        return got

    return {"node type": names("node type", g.live.select("type")), "edge type": names("edge type", g.edges.select("type")), "metadata key": names("metadata key", g.live.select(F.explode(F.map_keys("metadata"))))}


def _known(voc: set[str], what: str, v: str, at: str) -> str:
    if v in voc:
        return v
    near = difflib.get_close_matches(v, sorted(voc), 1, 0.5)
    raise RecipeError(f"{at}: unknown {what} {v!r}" + (f"; did you mean {near[0]!r}?" if near else f"; the graph has {', '.join(sorted(voc)[:20])}"))


#: Bytes of the list of all group keys that a row may carry.
MAX_GROUP_KEYS = 1_000_000


def _names_group(x) -> bool:
    """Whether a rule reads ``group.keys`` anywhere."""
    if isinstance(x, Expr):
        return (x.kind == "path" and x.value[:1] == ["group"]) or any(_names_group(a) for a in (x.args or []))
    if isinstance(x, Rule):
        return _names_group(x.a)
    if isinstance(x, dict):
        return any(_names_group(v) for v in x.values()) or any(isinstance(v, str) and v.startswith("group.") for v in x.values())
    return isinstance(x, list | tuple) and any(_names_group(v) for v in x)


class Program:
    """A compiled program; ``run`` gives nodes, edges and counts as DataFrames, lazily but for recursive walks and the check of ids."""

    def __init__(self, src: str, g: Graph, *, target: str = "practice", slug: str = "source"):
        self.rules, self.g, self.target, self.slug = parse(src), g, target, slug
        self.voc = census(g)
        cols = ["id", "type", "symbol_name", "summary", "description", "content", "source", "status", "metadata"]
        self.nodes = g.live.select(F.struct(*cols).alias("node"))
        self.vars: dict[str, str] = {}  # $name -> "node" or "text"
        self.emitted: list[DataFrame] = []
        self.links: list[DataFrame] = []
        self.misses: list[DataFrame] = []
        self.rows: DataFrame | None = None
        self.head = "node"
        self.ref: Expr | None = None

    # names of columns: node, edge (struct), n_<var> (node struct), t_<var> (text), ord (array of text)
    def _field(self, node: Column, rest: list[str]) -> Column:
        if not rest:
            return node["symbol_name"]
        h = rest[0]
        if h in NODE_FIELDS:
            return node[NODE_FIELDS[h]]
        if h == "body":
            return F.when(node["content"] != "", node["content"]).otherwise(node["description"])
        key = rest[1] if h == "metadata" and len(rest) > 1 else h
        return F.coalesce(F.try_element_at(node["metadata"], F.lit(key)), F.lit(""))

    def _path(self, path: list[str]) -> Column:
        h, rest = path[0], path[1:]
        if h.startswith("$"):
            kind = self.vars.get(h[1:])
            if kind is None:
                raise RecipeError(f"unbound variable {h}")
            return self._field(F.col("n_" + h[1:]), rest) if kind == "node" else F.col("t_" + h[1:])
        if h == "edge":
            if rest[:1] == ["type"] or not rest:
                return F.coalesce(F.col("edge.type"), F.lit(""))
            return F.coalesce(F.get_json_object("edge.evidence", "$." + rest[-1]), F.lit(""))
        if h == "group":
            return F.col("t_group_keys")
        if h == "walk":
            return F.col("t_walk_" + rest[0])
        if h not in (self.head, "node"):
            raise RecipeError(f"unknown head {h!r}; the rows are {self.head!r}")
        return self._field(F.col("node"), rest)

    def _expr(self, d: DataFrame, e: Expr) -> tuple[DataFrame, Column]:
        if e.kind == "text":
            return d, F.lit(e.value)
        if e.kind == "path":
            return d, self._path(e.value)
        if e.kind == "match":
            d, c = self._expr(d, e.args[0])
            hit = c.rlike(e.value[1])
            return d, F.when(hit if e.value[0] == "~=" else ~hit, F.lit("1")).otherwise(F.lit(""))
        if e.value in GRAPH_FUNCTIONS:
            return self._graph_call(d, e)
        if e.value == "match_group":
            d, c = self._expr(d, e.args[0])
            return d, S.match_group(c, e.args[1].value, int(e.args[2].value))
        cols = []
        for a in e.args:
            d, c = self._expr(d, a)
            cols.append(c)
        return d, S.BUILTINS[e.value][2](*cols)

    def _graph_call(self, d: DataFrame, e: Expr) -> tuple[DataFrame, Column]:
        """A function of the node alone is a table by node id that rows are joined to."""
        if any(a.kind != "text" for a in e.args):
            raise RecipeError(f"{e.value} takes texts only")
        a = [x.value for x in e.args]
        edge = _known(self.voc["edge type"], "edge type", a[0], e.value)
        g, val = self.g, (lambda f: self._field(F.col("node"), f.split(".")))
        es = g.edges.where(F.col("type") == edge)
        pos = F.get_json_object("evidence", "$.position").try_cast("long")
        kids = es.groupBy(F.col("from_id").alias("a"), F.col("to_id").alias("b")).agg(F.min(pos).alias("p"))
        nv = lambda f, k: self.nodes.select(F.col("node.id").alias(k), val(f).alias("v"))
        joined = lambda order: F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct(*order, "v"))), lambda x: x["v"]), lambda v: v != ""), a[2])
        if e.value == "has_edge":
            end = "from_id" if a[1] == "out" else "to_id"
            t = es.select(F.col(end).alias("k")).distinct().withColumn("r", F.lit("1"))
        elif e.value == "has_ancestor":
            S.check_pattern(a[2])
            t = closure(steps(g.edges, "in", [edge]), MAX_DEPTH).join(nv(a[1], "b").where(F.col("v").rlike(a[2])), "b").select(F.col("a").alias("k")).distinct().withColumn("r", F.lit("1"))
        elif e.value == "children_concat":
            t = kids.join(nv(a[1], "b"), "b").groupBy(F.col("a").alias("k")).agg(joined([F.coalesce("p", F.lit(2**62)).alias("p"), "b"]).alias("r"))
        elif e.value == "ancestors_concat":
            t = kids.select(F.col("b").alias("k"), F.col("a").alias("b")).join(nv(a[1], "b"), "b").groupBy("k").agg(joined(["b"]).alias("r"))
        elif e.value == "heading_path":
            first = kids.groupBy("b").agg(F.min("a").alias("a"))
            up = closure(first.select(F.col("b").alias("a"), F.col("a").alias("b")), MAX_DEPTH).where("a <> b")
            t = up.join(nv(a[1], "b"), "b").groupBy(F.col("a").alias("k")).agg(joined([(-F.col("distance")).alias("p")]).alias("r"))
        else:
            if not re.fullmatch(r"-?\d+", a[3]):
                raise RecipeError(f"subtree_concat: not an integer: {a[3]!r}")
            t = subtree(kids, min(int(a[3]), MAX_DEPTH)).join(nv(a[1], "b"), "b").groupBy(F.col("a").alias("k")).agg(joined(["path"]).alias("r"))
        name = f"f_{len(d.columns)}"
        d = d.join(t.select("k", F.col("r").alias(name)), F.col("node.id") == F.col("k"), "left").drop("k")
        return d, F.coalesce(F.col(name), F.lit(""))

    def _where(self, d: DataFrame, w: dict) -> tuple[DataFrame, Column]:
        p: Column = F.lit(True)
        for k, v in w.items():
            if k in ("all", "any"):
                parts = []
                for x in v:
                    d, c = self._where(d, x)
                    parts.append(c)
                q = parts[0]
                for c in parts[1:]:
                    q = q & c if k == "all" else q | c
            elif k == "not":
                d, q = self._where(d, v)
                q = ~q
            elif k in ("ancestor", "descendant"):
                d, q = self._edge_leaf(d, v, k)
            else:
                c = self._path(v["of"].split(".")) if "of" in v else F.col("node.type")
                if k == "kind":
                    q = F.col("node.type").isin(*([v["is"]] if isinstance(v["is"], str) else v["is"]))
                elif k == "matches":
                    q = c.rlike(v["regex"])
                elif k == "equals":
                    q = c == str(v["value"])
                elif k == "exists":
                    q = c != ""
                else:
                    q = S.compare(v["op"], c, float(v["value"]))
            p = p & q
        return d, p

    def _edge_leaf(self, d: DataFrame, v: dict, kind: str) -> tuple[DataFrame, Column]:
        """Rows from which some node along the edge satisfies the inner tree; inside it ``node`` is that node and variables are the row's."""
        edge = _known(self.voc["edge type"], "edge type", v["edge"], kind)
        pairs = closure(steps(self.g.edges, "in" if kind == "ancestor" else "out", [edge]), MAX_DEPTH)
        rid = f"r_{len(d.columns)}"
        d = materialize(d.withColumn(rid, F.monotonically_increasing_id()), "recipe").df
        reach = d.withColumn("_a", F.col("node.id")).drop("node", "edge").join(pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b")), "_a")
        reach = reach.join(self.nodes, F.col("_b") == F.col("node.id")).withColumn("edge", F.struct(F.lit(edge).alias("type"), F.lit("").alias("evidence")))
        head, self.head = self.head, "node"
        if v.get("where"):
            reach, p = self._where(reach, v["where"])
            reach = reach.where(p)
        self.head = head
        hit = reach.select(rid).distinct().withColumn(rid + "h", F.lit(True))
        return d.join(hit, rid, "left"), F.coalesce(F.col(rid + "h"), F.lit(False))

    def _need_rows(self, at: str) -> DataFrame:
        if self.rows is None:
            raise RecipeError(f"{at}: no rows yet; begin with select")
        return self.rows

    def run(self) -> dict[str, DataFrame]:
        for r in self.rules:
            getattr(self, "do_" + r.kind)(r.a, r.at)
        spark = self.g.nodes.sparkSession
        empty_n = spark.createDataFrame([], "id string, type string, name string, fields map<string,string>, source_id string, counted boolean")
        empty_e = spark.createDataFrame([], "from_id string, to_id string, type string")
        n = empty_n
        for x in self.emitted:
            n = n.unionByName(x)
        skipped = n.where("not counted").agg(F.count(F.lit(1)).alias("n")).select(F.lit("skipped").alias("what"), "n")
        n = n.where("counted").drop("counted")
        e, m = empty_e, skipped
        for x in self.links:
            e = e.unionByName(x)
        for x in self.misses:
            m = m.unionByName(x)
        return {"nodes": n, "edges": e.distinct(), "counts": m.groupBy("what").agg(F.sum("n").alias("n")), "rows": self.rows if self.rows is not None else empty_n}

    def check_unique(self, nodes: DataFrame) -> None:
        """The same id twice in one run is an error."""
        d = nodes.groupBy("id").count().where("count > 1").first()
        if d:
            raise RecipeError(f"id {d.id} is emitted {d['count']} times")

    def do_select(self, a: dict, at: str) -> None:
        _known(self.voc["node type"], "node type", a["type"], at)
        self.head, self.vars = a["type"], {}
        d = self.nodes.where(F.col("node.type") == a["type"]).select("node", F.lit(None).cast("struct<type:string,evidence:string>").alias("edge"), F.array("node.id").alias("ord"))
        if a["where"]:
            d, p = self._where(d, a["where"])
            d = d.where(p)
        self.rows = d

    def do_filter(self, a: dict, at: str) -> None:
        d, p = self._where(self._need_rows(at), a["where"])
        self.rows = d.where(p)

    def do_bind(self, a: dict, at: str) -> None:
        d, c = self._expr(self._need_rows(at), a["expr"])
        v = a["var"][1:]
        self.rows = d.withColumn("t_" + v, c)
        self.vars[v] = "text"

    def do_traverse(self, a: dict, at: str) -> None:
        d = self._need_rows(at)
        edge = _known(self.voc["edge type"], "edge type", a["edge"], at)
        s, t = ("from_id", "to_id") if a["dir"] == "out" else ("to_id", "from_id")
        e = self.g.edges.where(F.col("type") == edge).select(F.col(s).alias("_s"), F.col(t).alias("_t"), F.struct("type", "evidence").alias("_e"))
        d = d.withColumnRenamed("node", "_n").join(e, F.col("_n.id") == F.col("_s")).join(self.nodes, F.col("_t") == F.col("node.id"))
        v = a["as"]
        d = d.withColumn("edge", F.col("_e")).withColumn("ord", F.concat("ord", F.array("_t")))
        if v:  # the row's node stays, the variable is the new one
            d = d.withColumn("n_" + v[1:], F.col("node")).withColumn("node", F.col("_n"))
            self.vars[v[1:]] = "node"
        else:
            self.head = "node"
        self.rows = d.drop("_n", "_s", "_t", "_e")

    def do_walk(self, a: dict, at: str) -> None:
        """Depth first along an edge in document order, every node once below each root."""
        d = self._need_rows(at)
        edge = _known(self.voc["edge type"], "edge type", a["edge"], at)
        kids = self.g.edges.where(F.col("type") == edge).groupBy(F.col("from_id").alias("a"), F.col("to_id").alias("b")).agg(F.min(F.get_json_object("evidence", "$.position").try_cast("long")).alias("p"))
        sub = subtree(kids, None)
        w = W.partitionBy("a").orderBy("path")
        sub = sub.withColumn("t_walk_position", F.row_number().over(w).cast("string")).withColumn("t_walk_depth", F.size("path").cast("string"))
        d = d.withColumnRenamed("node", "_n").join(sub, F.col("_n.id") == F.col("a")).join(self.nodes, F.col("b") == F.col("node.id"))
        d = d.withColumn("ord", F.concat("ord", F.array(F.lpad("t_walk_position", 12, "0"))))
        if a["as"]:
            d = d.withColumn("n_" + a["as"][1:], F.col("_n"))
            self.vars[a["as"][1:]] = "node"
        self.head = "node"
        self.rows = d.drop("_n", "a", "b", "p", "path")

    def do_group_by(self, a: dict, at: str) -> None:
        d, c = self._expr(self._need_rows(at), a["key"])
        d = d.withColumn("_k", c)
        first = d.groupBy("_k").agg(F.min("ord").alias("ord"))
        d = d.drop("t_group_keys").join(first, ["_k", "ord"], "left_semi").dropDuplicates(["_k"])
        if _names_group(self.rules):  # the list of all keys is made only where the program reads it
            total = d.agg(F.count(F.lit(1)), F.sum(F.octet_length("_k"))).first()
            if (total[1] or 0) + total[0] > MAX_GROUP_KEYS:
                raise RecipeError(f"{at}: group.keys holds {total[0]} keys, more than {MAX_GROUP_KEYS} bytes in every row")
            d = d.withColumn("t_group_keys", F.lit(",".join(sorted(r[0] for r in d.select("_k").toLocalIterator()))))
        self.rows = d.drop("_k")

    def do_source_ref(self, a: dict, at: str) -> None:
        self._need_rows(at)
        self.ref = a["ref"]

    def do_emit(self, a: dict, at: str) -> None:
        d = self._need_rows(at)
        cols: dict[str, Column] = {}
        for f, e in a["fields"].items():
            d, c = self._expr(d, e)
            cols[f] = c
        kind = cols.pop("type", F.lit(a["type"]))
        name = cols.pop("name", F.lit(""))
        identity = cols.pop("identity", name)
        identity = F.when(identity == "", name).otherwise(identity)
        ref: Column = F.col("node.id")
        if self.ref is not None:
            d, ref = self._expr(d, self.ref)
        fields = F.map_filter(F.create_map(*[x for k, c in cols.items() for x in (F.lit(k), c)]) if cols else F.create_map().cast("map<string,string>"), lambda k, v: v != "")
        ok = (name != "") | (identity != "")
        ident = F.when(ok, S.stable_id(F.lit(self.target), F.lit(self.slug), kind, identity)).otherwise(F.lit(""))
        if a["as"]:
            d = d.withColumn("t_" + a["as"][1:], ident)
            self.vars[a["as"][1:]] = "text"
            self.rows = d
        self.emitted.append(d.select(ident.alias("id"), kind.alias("type"), name.alias("name"), fields.alias("fields"), ref.alias("source_id"), ok.alias("counted")))

    def do_lookup(self, a: dict, at: str) -> None:
        d, c = self._expr(self._need_rows(at), a["identity"])
        d = d.withColumn("_i", S.stable_id(F.lit(self.target), F.lit(self.slug), F.lit(a["type"]), c))
        made = None
        for x in self.emitted:
            made = x.select("id") if made is None else made.unionByName(x.select("id"))
        v = "t_" + a["as"][1:]
        if made is None:
            d = d.withColumn(v, F.lit(""))
        else:
            d = d.join(made.distinct().select(F.col("id").alias("_i"), F.lit(True).alias("_h")), "_i", "left").withColumn(v, F.when(F.col("_h"), F.col("_i")).otherwise(F.lit(""))).drop("_h")
        d = d.drop("_i")
        self.vars[a["as"][1:]] = "text"
        self.misses.append(d.where(F.col(v) == "").agg(F.count(F.lit(1)).alias("n")).select(F.lit("lookup_misses").alias("what"), "n"))
        self.rows = d

    def do_link(self, a: dict, at: str) -> None:
        d, x = self._expr(self._need_rows(at), a["from"])
        d, y = self._expr(d, a["to"])
        p = d.select(x.alias("from_id"), y.alias("to_id"))
        self.links.append(p.where("from_id <> '' and to_id <> ''").withColumn("type", F.lit(a["rel"])))
        self.misses.append(p.where("from_id = '' or to_id = ''").agg(F.count(F.lit(1)).alias("n")).select(F.lit("link_misses").alias("what"), "n"))


def subtree(kids: DataFrame, depth: int | None) -> DataFrame:
    """``(a, b, path)``: nodes below every a along ``(a, b, p)``, each once by its first path in document order (position, those without one last, then id); None is any depth."""
    step = F.concat(F.lpad(F.coalesce("p", F.lit(999_999_999_999)).cast("string"), 12, "0"), F.lit("\x01"), F.col("b"))
    base = kids.select("a", "b", step.alias("s"))
    now = materialize(base.select("a", "b", F.array("s").alias("path")).where(F.lit(depth is None or depth > 0)), "subtree")
    out = [now]
    while depth is None or len(out) < depth:
        nxt = out[-1].df.join(base.select(F.col("a").alias("b"), F.col("b").alias("c"), "s"), "b").where(~F.exists("path", lambda x: x.endswith(F.concat(F.lit("\x01"), F.col("c")))) & (F.col("c") != F.col("a")))
        n = materialize(nxt.select("a", F.col("c").alias("b"), F.concat("path", F.array("s")).alias("path")), "subtree")
        if n.df.isEmpty():
            n.drop()
            break
        out.append(n)
    d = out[0].df
    for x in out[1:]:
        d = d.unionByName(x.df)
    return d.groupBy("a", "b").agg(F.min("path").alias("path"))


def extract(nodes: DataFrame, *, offset: int = 0, max_rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of emitted rows by id, and their total (one row)."""
    d = nodes.orderBy("id").offset(offset)
    return (d.limit(max_rows) if max_rows else d), nodes.agg(F.count(F.lit(1)).alias("total"))


def land(nodes: DataFrame, resident: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New nodes for a target: an id that is resident lands as its next version ``id@vN`` with a next-version edge from the last one.

    Resident rows ``(id)`` hold ids and their versions.
    """
    base = resident.select(F.regexp_extract("id", r"^(.*?)(?:@v(\d+))?$", 1).alias("base"), F.coalesce(F.regexp_extract("id", r"@v(\d+)$", 1).try_cast("int"), F.lit(1)).alias("v"))
    last = base.groupBy("base").agg(F.max("v").alias("v"))
    d = nodes.join(last.withColumnRenamed("base", "id"), "id", "left")
    new = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.concat("id", F.lit("@v"), (F.col("v") + 1).cast("string")))
    old = F.when(F.col("v") == 1, F.col("id")).otherwise(F.concat("id", F.lit("@v"), F.col("v").cast("string")))
    edges = d.where("v is not null").select(old.alias("from_id"), new.alias("to_id"), F.lit("next-version").alias("type"))
    return d.withColumn("id", new).drop("v"), edges

"""Documents to nodes and edges: HTML pages, page layouts, source code, repositories, crawls."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.functions.scalars import canonical_url, fingerprint, same_host
from sparkloom.runtime import materialize

NODE_SCHEMA = "id string, type string, symbol_name string, content string, source string, metadata map<string,string>"
TREE_SCHEMA = "id string, parent string, type string, symbol_name string, content string, source string, position int, metadata map<string,string>"


def node_id(*parts: str) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:16]


# --- HTML ---------------------------------------------------------------------------------------
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_DROP = {"script", "style", "noscript", "template", "iframe", "svg"}
_NAV_ROLES = {"navigation", "menu", "menubar", "tablist"}
_SECTIONING = {"article", "aside", "nav", "section", "main", "header", "footer", "body"}
_BLOCK = {"p", "div", "ul", "ol", "table", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "section"}


class _El:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict, up: _El | None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up

    def text(self) -> str:
        return " ".join("".join(k if isinstance(k, str) else (" " + k.text() + " " if k.tag in _BLOCK or k.tag in ("td", "th", "li", "br") else k.text()) for k in self.kids).split())

    def find(self, *tags: str) -> list[_El]:
        out = []
        for k in self.kids:
            if not isinstance(k, str):
                if k.tag in tags:
                    out.append(k)
                out += k.find(*tags)
        return out


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _El("#", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and self.at.tag == tag:
            self.at = self.at.up
        e = _El(tag, dict(attrs), self.at)
        self.at.kids.append(e)
        if tag not in _VOID:
            self.at = e

    def handle_endtag(self, tag):
        e = self.at
        while e.up is not None and e.tag != tag:
            e = e.up
        if e.up is not None:
            self.at = e.up

    def handle_data(self, data):
        self.at.kids.append(data)


def _hidden(e: _El) -> bool:
    style = (e.attrs.get("style") or "").replace(" ", "").lower()
    return e.tag in _DROP or "hidden" in e.attrs or e.attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


def _prune(e: _El) -> None:
    e.kids = [k for k in e.kids if isinstance(k, str) or not _hidden(k)]
    for k in e.kids:
        if not isinstance(k, str):
            _prune(k)


def list_signals(e: _El) -> dict[str, str]:
    """Measurements of a list and what it is: navigation by role, by its section, or because all its items are links alone; else content."""
    items = [k for k in e.kids if not isinstance(k, str) and k.tag == "li"]
    only = sum(1 for i in items if i.find("a") and i.text() == " ".join(a.text() for a in i.find("a")).strip())
    up, sect = e.up, ""
    while up is not None and not sect:
        sect = up.tag if up.tag in _SECTIONING else ""
        up = up.up
    kind = "nav" if e.attrs.get("role") in _NAV_ROLES or sect == "nav" else "content" if not items else "nav" if only == len(items) else "content"
    return {"items": str(len(items)), "link_only": str(only), "section": sect, "role": e.attrs.get("role") or "", "class": kind}


def table_signals(e: _El) -> dict[str, str]:
    """Measurements of a table and what it is: layout by role, data by headers or uniform rows, layout by blocks in its cells, else data."""
    rows = [[c for c in r.find("td", "th")] for r in e.find("tr")]
    head = bool(e.find("th", "thead", "caption"))
    uniform = len({len(r) for r in rows}) == 1 and len(rows) > 1
    block = any(c.find(*_BLOCK) for r in rows for c in r)
    kind = "layout" if e.attrs.get("role") in ("presentation", "none") else "data" if head or uniform else "layout" if block else "data"
    return {"rows": str(len(rows)), "header": str(head).lower(), "uniform": str(uniform).lower(), "block_cells": str(block).lower(), "class": kind}


def page_tree(url: str, html: str) -> list[tuple]:
    """Rows of TREE_SCHEMA of one page: page, sections by headings, paragraphs, code, lists with items, tables, quotes, figures, links."""
    t = _Tree()
    t.feed(html or "")
    links = [(a.attrs.get("href") or "", a.text()) for a in t.root.find("a")]  # before anything is dropped
    _prune(t.root)
    title = next((x.text() for x in t.root.find("title")), "") or next((x.text() for x in t.root.find("h1")), "")
    rows: list[tuple] = []
    page = node_id("page", url)
    count: dict[str, int] = {}

    def emit(kind: str, parent: str, name: str, content: str, meta: dict[str, str] | None = None) -> str:
        pos = count[parent] = count.get(parent, 0) + 1
        i = page if kind == "page" else node_id(parent, kind, str(pos))
        rows.append((i, parent if kind != "page" else "", kind, name, content, url, pos, meta or {}))
        return i

    emit("page", "", title, "", {"url": url})
    stack: list[tuple[int, str]] = [(0, page)]

    def visit(e: _El) -> None:
        loose: list[str] = []

        def flush() -> None:
            s = " ".join("".join(loose).split())
            loose.clear()
            if s and e.tag not in ("html", "head", "title"):
                emit("paragraph", stack[-1][1], "", s)

        for k in e.kids:
            if isinstance(k, str):
                loose.append(k)
                continue
            g = k.tag
            if g in ("head", "title"):
                continue
            if re.fullmatch(r"h[1-6]", g):
                flush()
                n = int(g[1])
                while stack[-1][0] >= n:
                    stack.pop()
                stack.append((n, emit("section", stack[-1][1], k.text(), "", {"level": str(n)})))
            elif g in ("p", "blockquote", "figcaption", "dt", "dd"):
                flush()
                if k.text():
                    emit({"p": "paragraph", "blockquote": "quote", "figcaption": "figure", "dt": "term", "dd": "definition"}[g], stack[-1][1], "", k.text())
            elif g == "pre":
                flush()
                emit("code", stack[-1][1], "", "".join(x if isinstance(x, str) else x.text() for x in k.kids), {"language": re.sub(r".*language-(\w+).*|.*", r"\1", " ".join(str(x.attrs.get("class") or "") for x in [k, *k.find("code")]))})
            elif g in ("ul", "ol"):
                flush()
                li = emit("list", stack[-1][1], "", "", list_signals(k))
                for x in k.kids:
                    if not isinstance(x, str) and x.tag == "li":
                        emit("list_item", li, "", x.text())
            elif g == "table":
                flush()
                emit("table", stack[-1][1], "", "\n".join(" | ".join(c.text() for c in r.find("td", "th")) for r in k.find("tr")), table_signals(k))
            elif g in _BLOCK or g in _SECTIONING or g in ("html", "figure", "dl", "details", "form"):
                flush()
                visit(k)
            else:
                loose.append(k.text() if g != "br" else " ")
        flush()

    visit(t.root)
    for href, name in links:
        if href and not href.startswith(("#", "javascript:", "mailto:")):
            emit("link", page, name, href)
    return rows


def html_tree(pages: DataFrame) -> DataFrame:
    """TREE_SCHEMA rows of pages ``(url, html)``; ids depend on the url and the place in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for u, h in zip(b["url"], b["html"]) for r in page_tree(u, h)], columns=["id", "parent", "type", "symbol_name", "content", "source", "position", "metadata"])

    return pages.where(F.col("url").isNotNull()).select("url", "html").mapInPandas(run, TREE_SCHEMA)


def tree_edges(tree: DataFrame) -> DataFrame:
    """CONTAINS edges with the position as evidence."""
    return tree.where("parent <> ''").select(F.col("parent").alias("from_id"), F.col("id").alias("to_id"), F.lit("CONTAINS").alias("type"), F.format_string('{"position": %d}', "position").alias("evidence"))


def classify_links(tree: DataFrame) -> DataFrame:
    d = tree.where("type = 'link'").select("id", "source", F.col("content").alias("href"))
    rel = ~F.col("href").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return d.withColumn("class", F.when(rel | same_host(F.col("href"), F.col("source")), F.lit("internal")).otherwise(F.lit("external")))


def classify_page(media: Column, body: Column) -> Column:
    """html, text, pdf or other, by the declared media type, else by the content."""
    m = F.lower(F.trim(F.regexp_extract(F.coalesce(media, F.lit("")), r"^([^;]*)", 1)))
    b = F.lower(F.left(F.ltrim(F.coalesce(body, F.lit(""))), F.lit(200)))
    return F.when(m.isin("text/html", "application/xhtml+xml"), "html").when(m == "application/pdf", "pdf").when(m.startswith("text/"), "text").when(m != "", "other").when(b.startswith("%pdf"), "pdf").when(b.contains("<html") | b.startswith("<!doctype html"), "html").otherwise("text")


def crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, *, max_depth: int = 3, max_pages: int = 500, max_per_host: int = 200, follow: str = ".*") -> DataFrame:
    """``(url, depth)`` in breadth-first order over known pages: links ``(from_url, to_url)`` are canonical, caps hold per depth and host by url; pages of equal content count once."""
    host = F.regexp_extract("url", r"^[^:]+://([^/?]+)", 1)
    known = pages.select(canonical_url(F.col("url")).alias("url"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("hash")).where("url <> ''").groupBy("url").agg(F.min("hash").alias("hash"))
    first = known.groupBy("hash").agg(F.min("url").alias("url"))
    alias = known.join(first.withColumnRenamed("url", "main"), "hash").select("url", "main")
    lk = links.select(canonical_url(F.col("from_url")).alias("f"), canonical_url(F.col("to_url")).alias("url")).where(F.col("url").rlike(follow)).join(alias, "url").select("f", F.col("main").alias("url")).distinct()
    now = materialize(seeds.select(canonical_url(F.col("url")).alias("url")).join(alias, "url").select(F.col("main").alias("url")).distinct().withColumn("depth", F.lit(0)), "crawl")
    for k in range(1, max_depth + 1):
        nxt = lk.join(now.df.where(F.col("depth") == k - 1).select(F.col("url").alias("f")), "f").select("url").distinct().join(now.df.select("url"), "url", "left_anti").withColumn("depth", F.lit(k))
        new = materialize(now.df.unionByName(nxt), "crawl")
        stop = new.df.where(F.col("depth") == k).isEmpty()
        now.drop()
        now = new
        if stop:
            break
    d = now.df.withColumn("_n", F.row_number().over(W.partitionBy(host).orderBy("depth", "url"))).where(F.col("_n") <= max_per_host).drop("_n")
    return d.orderBy("depth", "url").limit(max_pages)


# --- page layouts -------------------------------------------------------------------------------
def layout_blocks(runs: DataFrame) -> DataFrame:
    """Blocks of text runs ``(doc, page, x, y, size, font, text)`` with kind: lines by equal y, blocks by vertical gaps, kinds against the usual size.

    Headings are larger than the body, code is in a mono-spaced font, lists begin with a mark; running heads
    (equal fingerprints at the top or bottom of three pages or more) are chrome. Body size is the most
    frequent one of the document by characters.
    """
    d = runs.withColumn("ly", F.round("y", 0))
    line = d.groupBy("doc", "page", "ly").agg(F.max("size").alias("size"), F.max(F.lower("font").rlike("mono|courier|consol").cast("int")).alias("mono"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda r: r["text"]), " ").alias("text"))
    body = line.groupBy("doc", "size").agg(F.sum(F.length("text")).alias("c")).groupBy("doc").agg(F.max(F.struct("c", (-F.col("size")).alias("s"))).alias("m")).select("doc", (-F.col("m.s")).alias("body"))
    w = W.partitionBy("doc", "page").orderBy("ly")
    gap = F.col("ly") - F.lag("ly").over(w)
    kindless = line.join(body, "doc").withColumn("heading", F.col("size") > F.col("body") * 1.15).withColumn("item", F.col("text").rlike(r"^\s*([•*\-–]|\d+[.)])\s"))
    new = F.coalesce((gap > F.col("body") * 1.8) | F.col("heading") | F.col("item") | (F.lag("heading").over(w)) | (F.col("mono") != F.lag("mono").over(w)), F.lit(True))
    b = kindless.withColumn("block", F.sum(new.cast("int")).over(w))
    b = b.groupBy("doc", "page", "block").agg(F.min("ly").alias("top"), F.max("size").alias("size"), F.max("mono").alias("mono"), F.max(F.col("heading").cast("int")).alias("heading"), F.max(F.col("item").cast("int")).alias("item"),
                                              F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ly", "text"))), lambda r: r["text"]), "\n").alias("text"))
    fp = fingerprint(F.col("text"))
    n = b.withColumn("fp", fp).groupBy("doc", "fp").agg(F.countDistinct("page").alias("pages"))
    b = b.withColumn("fp", fp).join(n, ["doc", "fp"])
    kind = F.when((F.col("pages") >= 3) & (F.col("heading") == 0) & (F.length("text") < 120), "chrome").when(F.col("heading") == 1, "heading").when(F.col("mono") == 1, "code").when(F.col("item") == 1, "list_item").otherwise("paragraph")
    return b.select("doc", "page", "block", "top", "size", "text", kind.alias("kind"))


def chunk_sections(blocks: DataFrame) -> DataFrame:
    """Blocks without chrome in reading order with their section heading; a paragraph that does not end a sentence goes on over the page."""
    w = W.partitionBy("doc").orderBy("page", "block")
    d = blocks.where("kind <> 'chrome'").withColumn("section", F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(w))
    prev_open = (F.lag("kind").over(w) == "paragraph") & (F.col("kind") == "paragraph") & (F.lag("page").over(w) < F.col("page")) & ~F.lag("text").over(w).rlike(r"[.!?:]\s*$")
    d = d.withColumn("chunk", F.sum((~F.coalesce(prev_open, F.lit(False))).cast("int")).over(w))
    return d.groupBy("doc", "chunk").agg(F.first("kind").alias("kind"), F.coalesce(F.first("section"), F.lit("")).alias("section"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "block", "text"))), lambda r: r["text"]), " ").alias("text"))


# --- source code --------------------------------------------------------------------------------
# Patterns of declarations by language, with the name as their first group.
DECLARATIONS = {
    "go": r"^func\s+(?:\([^)]*\)\s*)?(\w+)|^type\s+(\w+)", "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:fn|struct|enum|trait)\s+(\w+)",
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?|class)\s+(\w+)", "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\s*\*?|class|interface|type|enum)\s+(\w+)",
    "java": r"^\s*(?:public|private|protected|static|final|abstract|\s)*(?:class|interface|enum|record)\s+(\w+)", "c": r"^[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;]*\)\s*\{",
}
EXTENSIONS = {"go": "go", "rs": "rust", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "java": "java", "c": "c", "h": "c", "cc": "c", "cpp": "c"}


def language_of(path: str, language: str | None) -> str:
    return (language or "").strip().lower() or EXTENSIONS.get((path or "").rpartition(".")[2].lower(), "")


def chunk_source(path: str, language: str | None, text: str) -> list[tuple]:
    """``(kind, name, start, end, calls, imports)`` of every declaration: the syntax tree for Python, declaration lines and brackets for others."""
    lang = language_of(path, language)
    out: list[tuple] = []
    if lang == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return out
        imports = sorted({a.name for n in ast.walk(tree) if isinstance(n, ast.Import | ast.ImportFrom) for a in n.names})

        def go(node: ast.AST, inside: str) -> None:
            for n in ast.iter_child_nodes(node):
                if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                    calls = sorted({c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(n) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name | ast.Attribute)})
                    kind = "type" if isinstance(n, ast.ClassDef) else "method" if inside else "function"
                    out.append((kind, f"{inside}.{n.name}" if inside else n.name, n.lineno, n.end_lineno, calls, imports))
                    go(n, n.name if isinstance(n, ast.ClassDef) else inside)

        go(tree, "")
        return out
    pat = DECLARATIONS.get(lang)
    if not pat:
        return out
    lines = text.split("\n")
    imports = sorted({m for ln in lines for m in re.findall(r"""^\s*(?:import|use|require|from)\b.*?["']?([\w./:@-]+)["']?\s*\)?;?\s*$""", ln)})
    for i, ln in enumerate(lines):
        m = re.match(pat, ln)
        if not m:
            continue
        depth, end, seen = 0, i, False
        for j in range(i, len(lines)):
            bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'|//.*", "", lines[j])
            depth += bare.count("{") - bare.count("}")
            seen = seen or "{" in bare
            end = j
            if seen and depth <= 0 or (not seen and bare.rstrip().endswith(";")):
                break
        body = "\n".join(lines[i : end + 1])
        name = next(g for g in m.groups() if g)
        kind = "type" if re.search(r"\b(struct|enum|trait|class|interface|type|record)\b", ln) else "method" if re.match(r"^func\s+\(", ln) else "function"
        out.append((kind, name, i + 1, end + 1, sorted(set(re.findall(r"\b(\w+)\s*\(", body)) - {name, "if", "for", "while", "switch", "match", "return", "fn", "func", "function"}), imports))
    return out


def chunk_files(files: DataFrame) -> DataFrame:
    """Declarations of files ``(id, file_path, language, content)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *c) for i, p, la, t in zip(b["id"], b["file_path"], b["language"], b["content"]) for c in chunk_source(p, la, (t or "").replace("\r\n", "\n"))]
            yield pd.DataFrame(rows, columns=["file_id", "kind", "name", "start_line", "end_line", "calls", "imports"])

    return files.select("id", "file_path", "language", "content").mapInPandas(run, "file_id string, kind string, name string, start_line int, end_line int, calls array<string>, imports array<string>")


# Rules by which a file is left out of a repository's listing, in the order in which they are tried.
DISCOVERY_RULES = ("skip_extension", "skip_lockfile", "skip_dts", "skip_generated_go", "skip_path_component", "skip_unknown_lang", "skip_too_large")
# Extensions of documents, names of lock files, endings of declaration files, directories of others' or generated code.
SKIP_EXTENSIONS = ("md", "markdown")
SKIP_FILES = (
    "package-lock.json yarn.lock pnpm-lock.yaml bun.lock npm-shrinkwrap.json shrinkwrap.yaml go.sum Cargo.lock poetry.lock Pipfile.lock uv.lock pdm.lock Gemfile.lock composer.lock "
    "packages.lock.json gradle.lockfile Package.resolved pubspec.lock mix.lock Podfile.lock .terraform.lock.hcl flake.lock"
).split()
SKIP_DTS = (".d.ts", ".d.mts", ".d.cts")
SKIP_PARTS = ("vendor", "testdata", "deps", "thirdparty", "third_party", "third-party", "generated", ".generated", "node_modules")
MAX_FILE_BYTES, EXCLUSION_SAMPLES = 500 * 1024, 5
# Extensions and names of files in a language that is known.
KNOWN_EXTENSIONS = (
    "go ts mts cts tsx js mjs cjs jsx py pyi rs java kt kts c h cc cpp cxx hpp hh cs rb php swift scala sh bash zsh lua sql tf hcl proto css scss html htm xml json yaml yml toml dart ex exs elm ml mli groovy md markdown"
).split()
KNOWN_NAMES = ("Makefile", "Dockerfile", "Jenkinsfile", "Rakefile", "Gemfile")


def skip_rule(path: Column, content: Column) -> Column:
    """The first rule that leaves a file out, or an empty text. A name ending in ``_gen.go`` or ``_generated.go`` alone is none: the marker must stand before the package clause in the first 4096 bytes."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.regexp_extract(name, r"\.([^.]*)$", 1)
    head = F.decode(F.substring(F.encode(content, "UTF-8"), 1, 4096), "UTF-8")
    marked = F.regexp_replace(head, r"(?ms)^package .*", "").rlike(r"(?m)^// Code generated .* DO NOT EDIT\.\r?$")
    parts = F.split(path, "/")
    rules = {
        "skip_extension": ext.isin(*SKIP_EXTENSIONS), "skip_lockfile": name.isin(*SKIP_FILES), "skip_dts": name.endswith(SKIP_DTS[0]) | name.endswith(SKIP_DTS[1]) | name.endswith(SKIP_DTS[2]),
        "skip_generated_go": name.endswith(".pb.go") | (name.rlike(r"_gen(erated)?\.go$") & marked),
        "skip_path_component": F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(x) for x in SKIP_PARTS])),
        "skip_unknown_lang": ~(F.lower(ext).isin(*KNOWN_EXTENSIONS) | name.isin(*KNOWN_NAMES)), "skip_too_large": F.octet_length(content) > MAX_FILE_BYTES,
    }
    out = F.lit("")
    for rule in reversed(DISCOVERY_RULES):
        out = F.when(rules[rule], F.lit(rule)).otherwise(out)
    return out


def discover(files: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files ``(id, source, file_path, content)`` that discovery keeps, and its report ``(source, rule, n, samples, truncated)``.

    ``runs``: rows ``(source, prefixes, lift)``. A file outside the prefixes of its repository (none: all; whole path
    segments; trailing slashes do not count) is no candidate and charged to no rule; a repository whose exclusions are
    lifted keeps all of its candidates. The report counts every rule in every repository of the runs, zeros included,
    and names the first EXCLUSION_SAMPLES paths; ``truncated`` tells that there are more.
    """
    clean = F.transform(F.filter("prefixes", lambda p: p.isNotNull()), lambda p: F.regexp_replace(p, "/+$", ""))
    own = runs.where(F.col("source").isNotNull()).select("source", F.when(F.size(clean) > 0, clean).alias("cuts"), F.coalesce("lift", F.lit(False)).alias("lift"))
    own = own.groupBy("source").agg(F.max(F.col("cuts").isNull()).alias("whole"), F.flatten(F.collect_list("cuts")).alias("cuts"), F.max("lift").alias("lift"))
    d = files.join(own, "source", "left")
    inside = F.coalesce("whole", F.lit(True)) | F.exists("cuts", lambda c: (F.col("file_path") == c) | F.col("file_path").startswith(F.concat(c, F.lit("/"))))
    d = d.where(inside).withColumn("rule", F.when(F.coalesce("lift", F.lit(False)), F.lit("")).otherwise(skip_rule(F.col("file_path"), F.coalesce("content", F.lit("")))))
    out = d.where("rule <> ''").select("source", "rule", "file_path")
    # the first few of every slice, then of all: no rule is one task
    first = out.withColumn("_s", F.pmod(F.xxhash64("file_path"), F.lit(16))).withColumn("_r", F.row_number().over(W.partitionBy("source", "rule", "_s").orderBy("file_path"))).where(F.col("_r") <= EXCLUSION_SAMPLES)
    first = first.withColumn("_r", F.row_number().over(W.partitionBy("source", "rule").orderBy("file_path"))).where(F.col("_r") <= EXCLUSION_SAMPLES)
    samples = first.groupBy("source", "rule").agg(F.array_sort(F.collect_list("file_path")).alias("samples"))
    counts = out.groupBy("source", "rule").agg(F.count(F.lit(1)).alias("n"))
    every = own.select("source", F.explode(F.array(*[F.lit(r) for r in DISCOVERY_RULES])).alias("rule"))
    report = every.join(counts, ["source", "rule"], "full").join(samples, ["source", "rule"], "left")
    report = report.select("source", "rule", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), (F.coalesce("n", F.lit(0)) > EXCLUSION_SAMPLES).alias("truncated"))
    return d.where("rule = ''").drop("cuts", "whole", "lift", "rule"), report


# --- structural search of Python code ------------------------------------------------------------
def compile_pattern(src: str) -> ast.AST:
    """A Python expression or statement with ``$X`` for one node, ``$_`` for any, ``$$$X`` for any number of arguments or statements."""
    s = re.sub(r"\$\$\$(\w+)", r"__MANY_\1", src)
    s = re.sub(r"\$(\w+)", r"__ONE_\1", s)
    body = ast.parse(s).body
    if len(body) != 1:
        raise ValueError("a pattern is one expression or statement")
    return body[0].value if isinstance(body[0], ast.Expr) else body[0]


def _hole(p: object) -> tuple[str, str] | None:
    while isinstance(p, ast.Expr):
        p = p.value
    n = p.id if isinstance(p, ast.Name) else p.arg if isinstance(p, ast.arg) else p if isinstance(p, str) else ""
    m = re.fullmatch(r"__(ONE|MANY)_(\w+)", n)
    return (m[1], m[2]) if m else None


def match_node(p: object, n: object, cap: dict[str, str]) -> bool:
    """Whether a node fits a pattern; captures of one name must have one text."""
    h = _hole(p)
    if h and h[0] == "ONE":
        text = n if isinstance(n, str) else ast.unparse(n) if isinstance(n, ast.AST) else repr(n)
        if h[1] == "_":
            return True
        if h[1] in cap:
            return cap[h[1]] == text
        cap[h[1]] = text
        return True
    if isinstance(p, ast.AST):
        return type(p) is type(n) and all(match_node(getattr(p, f, None), getattr(n, f, None), cap) for f in p._fields if f not in ("ctx", "type_comment", "kind", "type_params"))
    if isinstance(p, list):
        return isinstance(n, list) and _match_list(p, n, cap)
    return p == n


def _match_list(p: list, n: list, cap: dict[str, str]) -> bool:
    if not p:
        return not n
    h = _hole(p[0])
    if h and h[0] == "MANY":
        for k in range(len(n) + 1):
            c = dict(cap)
            if h[1] != "_":
                c[h[1]] = ", ".join(ast.unparse(x) for x in n[:k])
            if _match_list(p[1:], n[k:], c):
                cap.update(c)
                return True
        return False
    if not n:
        return False
    c = dict(cap)
    if match_node(p[0], n[0], c) and _match_list(p[1:], n[1:], c):
        cap.update(c)
        return True
    return False


def search_text(pattern: ast.AST, text: str) -> list[tuple[int, int, str, dict[str, str]]]:
    """``(line, column, text, captures)`` of every match in a Python source; a source that cannot be parsed has none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for n in ast.walk(tree):
        cap: dict[str, str] = {}
        if type(n) is type(pattern) and match_node(pattern, n, cap):
            out.append((n.lineno, n.col_offset, ast.unparse(n), cap))
    return sorted(out, key=lambda x: x[:2])


def ast_matches(files: DataFrame, pattern: str, *, kind: str | None = None, regex: tuple[str, str] | None = None, inside: str | None = None, contains: str | None = None) -> DataFrame:
    """Matches in Python files, with leaves: node ``kind``, a capture that matches a regex, inside or containing another pattern."""
    compile_pattern(pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, q, r = compile_pattern(pattern), compile_pattern(inside) if inside else None, compile_pattern(contains) if contains else None
        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["content"]):
                outer = search_text(q, t or "") if q else []
                for ln, col, s, cap in search_text(p, t or ""):
                    if kind and type(p).__name__ != kind or regex and not re.search(regex[1], cap.get(regex[0], "")):
                        continue
                    if q and not any(s in o[2] and o[0] <= ln for o in outer) or r and not search_text(r, s):
                        continue
                    rows.append((i, ln, col, s, cap))
            yield pd.DataFrame(rows, columns=["file_id", "line", "col", "text", "captures"])

    return files.select("id", "content").mapInPandas(run, "file_id string, line int, col int, text string, captures map<string,string>")


def ast_replace(files: DataFrame, pattern: str, template: str) -> DataFrame:
    """``(id, new_text, edits, ok)``: every outermost match rewritten by a template of ``$X``; ok if the result parses; sources that did not parse stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = compile_pattern(pattern)
        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["content"]):
                t = t or ""
                try:
                    tree = ast.parse(t)
                except (SyntaxError, ValueError, RecursionError):
                    rows.append((i, t, 0, False))
                    continue
                starts = [0]
                for ln in t.splitlines(keepends=True):
                    starts.append(starts[-1] + len(ln.encode()))
                raw, spans = t.encode(), []
                for n in ast.walk(tree):
                    cap: dict[str, str] = {}
                    if type(n) is type(p) and match_node(p, n, cap):
                        a, e = starts[n.lineno - 1] + n.col_offset, starts[n.end_lineno - 1] + n.end_col_offset
                        if not any(x <= a and e <= y for x, y, _ in spans):
                            spans.append((a, e, re.sub(r"\$+(\w+)", lambda m: cap.get(m[1], m[0]), template)))  # noqa: B023
                for a, e, new in sorted(spans, reverse=True):
                    raw = raw[:a] + new.encode() + raw[e:]
                out = raw.decode()
                try:
                    ast.parse(out)
                    ok = True
                except SyntaxError:
                    ok = False
                rows.append((i, out, len(spans), ok))
            yield pd.DataFrame(rows, columns=["id", "new_text", "edits", "ok"])

    return files.select("id", "content").mapInPandas(run, "id string, new_text string, edits int, ok boolean")


def flow_reaches(source: str, start: str, end: str, most: int = 32) -> bool:
    """Whether inside some one function a name's value may reach another: breadth-first over assignments, loops and calls' results, at most ``most`` steps."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return False
    for fn in [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]:
        flows: dict[str, set[str]] = {}
        for n in ast.walk(fn):
            if isinstance(n, ast.Assign | ast.AugAssign | ast.AnnAssign | ast.For | ast.NamedExpr):
                value = n.iter if isinstance(n, ast.For) else n.value
                targets = n.targets if isinstance(n, ast.Assign) else [n.target]
                read = {x.id for x in ast.walk(value) if isinstance(x, ast.Name)} if value is not None else set()
                for t in targets:
                    for w in ast.walk(t):
                        if isinstance(w, ast.Name):
                            for r in read:
                                flows.setdefault(r, set()).add(w.id)
        names = {x.id for x in ast.walk(fn) if isinstance(x, ast.Name)} | {a.arg for a in fn.args.args}
        if start not in names:
            continue
        seen, front = {start}, {start}
        for _ in range(most):
            if end in seen:
                return True
            front = {y for x in front for y in flows.get(x, ())} - seen
            if not front:
                break
            seen |= front
        if end in seen:
            return True
    return False


def flow_matches(files: DataFrame, start: str, end: str) -> DataFrame:
    """Ids of the Python files ``(id, content)`` in some function of which the value of a name may reach another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[flow_reaches(t or "", start, end) for t in b["content"]], ["id"]]

    return files.select("id", "content").mapInPandas(run, "id string")

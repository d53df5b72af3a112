"""Problem 1: generated, minified, vendored and pure-data files among source files."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.blocks import bounded_sample
from sparkloom.runtime import materialize

#: Words of a shingle and the similarity from which a file is a copy of another.
SHINGLE, ALIKE = 5, 0.8
#: Characters of a statement, names and literals counting one each, from which a formatter breaks it; of a text that
#: is a blob; and the share of lines of repeated shapes from which a file is uniform.
LONG_STATEMENT, BLOB_CHARS, UNIFORM = 40, 40, 0.85
#: Files the list of common shingles is read from (of the smallest id hash), and in how many of them a shingle is common.
SAMPLE_FILES, COMMON_IN = 2000, 3
#: The list of common shingles, which only orders the others, holds the most frequent ones of the sample up to this many.
COMMON_SHINGLES = 200_000

# What tools write into the first or last comment of their output.
TOOL_NOTES = (
    r"code generated\b.*\bdo not edit", r"@generated\b", r"<auto-?generated", r"\bauto-?\s?generated\b", r"\bautomatically (?:produced|generated|created|written)\b",
    r"\bmachine[- ](?:written|generated|made)\b", r"\bgenerated (?:by|from|with|using)\b", r"\bdo not (?:edit|modify)\b", r"\bnever edit\b", r"\bedits? (?:are|is|will be) overwritten\b",
    r"\bchanges will be (?:lost|overwritten)\b", r"\bregenerate with\b", r"^\W{0,40}output of \S+?\.? ", r"^\W{0,40}source: \S+\.(?:proto|idl|thrift|avsc|fbs|yaml|yml|json)\b", r"\bmanual changes will be lost\b",
)
# Denials of the same.
DENIALS = (r"\b(?:not|never|isn't|is not|no longer|wasn't) (?:auto-?)?(?:machine-)?generated\b", r"\bhand-?written\b", r"\bwritten by hand\b")
# What third-party files say of where they come from.
ORIGIN_NOTES = (
    r"\bupstream:? https?://", r"\bthis file is part of \S+ \((?:release|version) ", r"\btaken (?:unmodified|verbatim|as is) from\b", r"\bspdx-filecopyrighttext: the \S+ contributors\b",
    r"\bcopied (?:unmodified |verbatim )?from \S+[@ ]v?\d", r"\bvendored from\b", r"^\W{0,40}/?\*?!\s*\S+ v?\d+\.\d+\.\d+",
)
# Path segments under which third-party files are kept.
VENDOR_SEGMENTS = "vendor _vendor vendored _vendored third_party third-party thirdparty 3rdparty node_modules bower_components jspm_packages deps extern external externals godeps site-packages".split()
_VERSIONED = regex.compile(r"^.+[-@]v?\d+\.\d+(?:\.\d+)*$")

_TOOL = regex.compile("|".join(f"(?:{p})" for p in TOOL_NOTES), regex.I | regex.M)
_DENY = regex.compile("|".join(DENIALS), regex.I)
_ORIGIN = regex.compile("|".join(f"(?:{p})" for p in ORIGIN_NOTES), regex.I | regex.M)
# Extensions of languages whose comments begin with a hash.
HASH_EXTENSIONS = frozenset("py pyi pyx rb sh bash zsh pl pm r jl yml yaml toml cfg ini mk make dockerfile tf ps1 cmake nim ex exs".split())
_STRING = r"""(?P<s>\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)"""
_LEX = {
    False: re.compile(r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z))|" + _STRING, re.S),
    True: re.compile(r"(?P<c>\#[^\n]*)|" + _STRING, re.S),
}
_NAME = re.compile(r"[^\W\d]\w*|\$\w+")
_NUM = re.compile(r"-?\b\d[\w.]*")
_BLANK = re.compile(r"[ \t]+")
_STATEMENT = re.compile(r"[;{}\n]")
# where a formatter breaks a statement that does not fit on a line: lists, choices and links of an expression
_BREAK = re.compile(r"[,?:]|&&|\|\||(?<=[\)\]\w\x01])\.(?=I)|=>")
_FIELD = re.compile(r"[^\W\d]\w*|\$\w+|-?\b\d[\w.]*|\x01")
_WORD = re.compile(r"\w+")
_HEAD = regex.compile(r"\A(?:\s*(?://[^\n]*|\#[^\n]*|/\*.*?\*/|<!--.*?-->|--[^\n]*))+", regex.S)
_COMMENTS = re.compile(r"^[ \t]*(?://|/?\*|\#|<!--|--).*$", re.M)
_RIGHTS = re.compile(r"^[ \t]*(?://|/?\*|\#|--)[^\n]*(?:copyright|licen[cs]e|redistribut|upstream|taken unmodified|this file is part of)[^\n]*\n", re.M | re.I)
_OPENS = {"*/": ("/*", re.compile(r"^[ \t]*(?=/\*)", re.M)), "-->": ("<!--", re.compile(r"^[ \t]*(?=<!--)", re.M))}


def notes(text: str) -> tuple[str, str]:
    """All comments before the first and after the last code of a file, however long they are."""
    h = _HEAD.match(text)
    return (h.group() if h else "", _tail(text))


def _tail(text: str) -> str:
    end = len(text)  # behind it are comments and blanks only
    while end > 0:
        start = text.rfind("\n", 0, end) + 1
        line = text[start:end].strip()
        if not line or line.startswith(("//", "#", "--")):
            end = start - 1
            continue
        close = next((c for c in _OPENS if line.endswith(c)), "")
        if not close:
            break
        mark, at_start = _OPENS[close]
        rest = start + len(text[start:end].rstrip())
        before = text.rfind(close, 0, rest - len(close))
        before = before + len(close) if before >= 0 else 0
        m = at_start.search(text, before, rest)
        opened = m.end() if m else text.rfind(mark, before, rest)
        if opened < 0:
            break
        end = opened
    return text[max(end, 0) :]


def reemit(shape: str) -> list[str]:
    """The lines of a file in canonical form: a statement or brace to a line, and a long statement broken at its lists and links."""
    out = []
    for line in _STATEMENT.split(shape):
        if len(line) > LONG_STATEMENT:
            out += [x for x in _BREAK.split(line) if x]
        elif line:
            out.append(line)
    return out


def slots(bare: str, texts: list[str]) -> int:
    """In how many places the lines that share their shape with three others differ, all such shapes together; ``texts`` are those the lexer took out, in order."""
    lines: dict[str, list[list[str]]] = {}
    left = iter(texts)
    for line in bare.split("\n"):
        fields = [next(left) if f == "\x01" else f for f in _FIELD.findall(line)]
        if fields:
            lines.setdefault(_BLANK.sub("", _FIELD.sub("I", line)), []).append(fields)
    return sum(len(set(column)) > 1 for rows in lines.values() if len(rows) >= 4 for column in zip(*rows))


def layout(text: str, hashes: bool = False) -> dict:
    """Lex a file, re-emit it in canonical form, and compare that with the layout it has.

    ``expansion``: re-emitted lines to lines with code; ``width``: characters to such a line; ``uniform``: share
    of lines whose shape (names, numbers and texts replaced by their kind) is of one of the few shapes that
    repeat, and ``slots`` the places in which these differ; ``literals``: share of numbers and texts among the
    characters of code, ``blobs`` of long texts without white space; ``prose``: comments and free-standing texts
    of at least four words, for each 100 tokens; ``tokens``: tokens in all.
    """
    prose = literal = blobs = 0
    texts: list[str] = []

    def kinds(m: re.Match) -> str:
        nonlocal prose, literal, blobs
        t = m.group()
        if m.lastgroup == "c" or (t[:3] in ('"""', "'''") and not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip()):
            prose += len(t.split(None, 4)) >= 4
            return ""
        texts.append(t)
        literal += len(t)
        if len(t) >= BLOB_CHARS and len(t.split(None, 1)) == 1:
            blobs += len(t)
        return "\x01"

    bare = _LEX[hashes].sub(kinds, text)
    numbers = sum(map(len, _NUM.findall(bare)))
    code = len(_BLANK.sub("", bare)) - bare.count("\n") - len(texts) + literal
    literal += numbers
    shape, names = _NAME.subn("I", _NUM.sub("0", bare))
    shape = _BLANK.sub("", shape)
    fold: Counter = Counter()
    for line in shape.split("\n"):
        if line:  # rows of literals are one shape however long they are
            fold["data" if "I" not in line and ("0" in line or "\x01" in line) else line] += 1
    n = max(1, sum(fold.values()))
    tokens = len(shape) - shape.count("\n")
    uniform = sum(k for _, k in fold.most_common(8) if k >= 4) / n
    return {
        "expansion": len(reemit(shape)) / n, "width": code / n, "uniform": uniform, "shapes": len(fold), "slots": slots(bare, texts) if uniform >= UNIFORM else 0,
        "literals": literal / max(1, code), "blobs": blobs / max(1, code) if blobs >= 3 * BLOB_CHARS else 0.0, "prose": 100.0 * prose / max(1, tokens), "tokens": tokens, "lines": n, "names": names / max(1, tokens),
    }


def kind_of(path: str, text: str) -> str:
    """``generated``, ``minified``, ``data``, ``vendored`` or an empty text, from path and content alone."""
    text = text.replace("\r\n", "\n")
    if not text.strip():
        return ""
    head, tail = notes(text)
    # the whole first comment, and comments on the first lines even if code stands before them
    first = head + "\n" + "\n".join(x for x in text[len(head) :].split("\n", 15)[: max(0, 15 - head.count("\n"))] if _COMMENTS.match(x))
    if (_TOOL.search(first) or _TOOL.search(tail)) and not _DENY.search(first):
        return "generated"
    if _is_vendor_path(path) or any(_ORIGIN.search(x) for x in _COMMENTS.findall(text)):
        return "vendored"
    q = layout(text[len(head) :], path.rpartition(".")[2].lower() in HASH_EXTENSIONS)
    if q["tokens"] >= 40 and q["width"] >= 160 and q["expansion"] >= 4:
        return "minified"
    if q["blobs"] >= 0.8 or q["tokens"] >= 60 and q["literals"] >= 0.55 and q["prose"] < 1 and (q["names"] < 0.12 or q["literals"] >= 0.7):
        return "data"
    # a template with three slots or more; lists of names and values are written by hand too, if they are short
    if q["lines"] >= 5 and q["uniform"] >= UNIFORM and q["prose"] == 0 and q["shapes"] <= 12 and (q["slots"] >= 3 or q["lines"] >= 40):
        return "generated"
    return ""


def _is_vendor_path(path: str) -> bool:
    parts = path.replace("\\", "/").split("/")[:-1]
    return any(p.lower() in VENDOR_SEGMENTS or _VERSIONED.match(p) for p in parts)


def body_words(text: str) -> list[str]:
    """Words of a file without its first comment and without comment lines on rights and origin."""
    text = text.replace("\r\n", "\n")
    head, _ = notes(text)
    return _WORD.findall(_RIGHTS.sub("", text[len(head) :]))


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        v = self[w] = xxhash.xxh64_intdigest(w)
        return v


_hash = _Hashes().__getitem__


def shingles(words: list[str]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of every SHINGLE words in a row (of all words, if fewer)."""
    if not words:
        return np.empty(0, dtype=np.int64)
    h = np.fromiter(map(_hash, words), dtype=np.uint64, count=len(words))
    k = min(SHINGLE, len(h))
    out = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def prefix(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of which two files as similar as ALIKE share at least one: the first n - ceil(ALIKE n) + 1 in the order rare, then common ones."""
    if not len(s):
        return s
    often = np.isin(s, common, assume_unique=True)
    ordered = np.concatenate([s[~often], s[often]])
    return ordered[: len(s) - int(np.ceil(ALIKE * len(s) - 1e-9)) + 1]


def _vector(words: list[str]) -> tuple[str, np.ndarray]:
    return xxhash.xxh3_128_hexdigest(" ".join(words)), shingles(words)


def similar_texts(told: DataFrame, others: DataFrame, files: DataFrame) -> DataFrame:
    """``(body)`` of texts of ``others`` that are at least ALIKE similar to a text of ``told``.

    Exact: texts that share no prefix shingle cannot be as similar. Pairs that do are verified on their whole
    sets of shingles, read again from ``files``. Rows: ``body, id, n, first``; equal bodies are one text.
    """
    texts = lambda d: d.groupBy("body").agg(F.min(F.struct("id", "n", "first")).alias("x")).select("body", "x.*")
    a = texts(told).select(F.col("body").alias("va"), F.col("id").alias("ia"), F.col("n").alias("na"), F.explode("first").alias("s"))
    b = texts(others).select(F.col("body").alias("vb"), F.col("id").alias("ib"), F.col("n").alias("nb"), F.explode("first").alias("s"))
    near = (F.col("va") != F.col("vb")) & (F.col("na") >= ALIKE * F.col("nb")) & (F.col("nb") >= ALIKE * F.col("na"))
    pairs = materialize(a.join(b, "s").where(near).select("va", "ia", "vb", "ib").distinct(), "p1-pairs").df
    ids = pairs.select(F.col("ia").alias("id")).unionByName(pairs.select(F.col("ib").alias("id"))).distinct()

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            v = [_vector(body_words(c)) for c in x["content"]]
            yield pd.DataFrame({"body": [h for h, _ in v], "s": pd.Series([s.tolist() for _, s in v], dtype=object)})

    sets = ids.join(files.select("id", "content"), "id").select("content").mapInPandas(vectors, "body string, s array<long>").dropDuplicates(["body"])
    both = pairs.join(sets.select(F.col("body").alias("va"), F.col("s").alias("sa")), "va").join(sets.select(F.col("body").alias("vb"), F.col("s").alias("sb")), "vb")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= ALIKE * (F.size("sa") + F.size("sb") - shared)).select(F.col("vb").alias("body")).distinct()


def file_kinds(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """``(node_id, kind, caught_by)`` of every live file that is not hand-written source, inside the package prefixes of its repository.

    ``caught_by`` is the rule under which an earlier run of the repository names the file among ``excluded_samples``
    (the least, of several), null for what these runs did not name.

    A file is generated, minified or data by its own text; it is vendored if its path or its comments say so or
    if its text is a copy of such a file, of equal words or at least ALIKE similar in its shingles. Copies are
    found by an exact prefix-filtered join of distinct texts: rare shingles stand first in the order, so a
    phrase that all files share is no key. Of repeated rows of an id the latest counts. Null or blank paths
    and texts are no case; a repository without a run, or whose prefixes are null, empty or blank, is taken
    whole; other columns are ignored.
    """
    files = nodes.where((F.col("type") == "file") & F.col("id").isNotNull()).select(
        "id", F.coalesce("file_path", F.lit("")).alias("path"), "source", F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("updated_at", F.lit(0)).alias("at"), (F.coalesce("tombstoned_at", F.lit(0)) == 0).alias("live"),
    )
    sample = bounded_sample(files.select("id"), ["id"], SAMPLE_FILES).select("id").distinct()

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"s": np.concatenate([shingles(body_words(c)) for c in b["content"]] or [np.empty(0, dtype=np.int64)])})

    often = files.join(F.broadcast(sample), "id").select("content").mapInPandas(shingled, "s long").groupBy("s").count().where(F.col("count") >= COMMON_IN)
    common = np.array(sorted(r.s for r in often.orderBy(F.desc("count"), "s").limit(COMMON_SHINGLES).toLocalIterator()), dtype=np.int64)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kinds, bodies, sizes, firsts = [], [], [], []
            for p, c in zip(b["path"], b["content"]):
                k = kind_of(p, c)
                h, s = _vector(body_words(c)) if k in ("", "vendored") and c.strip() else ("", np.empty(0, dtype=np.int64))
                kinds.append(k)
                bodies.append(h)
                sizes.append(len(s))
                firsts.append(prefix(s, common))
            yield pd.DataFrame({"id": b["id"], "path": b["path"], "source": b["source"], "at": b["at"], "live": b["live"], "kind": kinds, "body": bodies, "n": sizes, "first": pd.Series(firsts, dtype=object)})

    f = materialize(files.mapInPandas(look, "id string, path string, source string, at long, live boolean, kind string, body string, n int, first array<long>"), "p1-files").df
    now = f.groupBy("id").agg(F.max(F.struct("at", "live", "kind", "body", "path", "source")).alias("x")).select("id", "x.*")
    told = f.where((F.col("kind") == "vendored") & (F.col("n") > 0)).select("body", "id", "n", "first")
    others = f.where((F.col("kind") == "") & (F.col("n") > 0)).select("body", "id", "n", "first")
    same = told.select("body").distinct().join(others.select("body").distinct(), "body", "left_semi")
    copies = similar_texts(told, others, files).unionByName(same).distinct().withColumn("copy", F.lit(True))
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(\./|/)+|/+$", "")
    kept = runs.where(F.col("repo").isNotNull()).select(F.col("repo").alias("source"), F.transform(F.filter("package_prefixes", lambda p: p.isNotNull()), clean).alias("cut"))
    kept = kept.withColumn("cut", F.when((F.size("cut") > 0) & ~F.exists("cut", lambda p: F.trim(p).isin("", ".")), F.col("cut")))
    kept = kept.groupBy("source").agg(F.max(F.col("cut").isNull()).alias("whole"), F.flatten(F.collect_list("cut")).alias("cuts"))
    r = now.where("live").join(copies, "body", "left").withColumn("kind", F.when((F.col("kind") == "") & F.col("copy"), F.lit("vendored")).otherwise(F.col("kind")))
    r = r.where("kind <> ''").withColumn("p", clean(F.col("path"))).where("p <> ''").join(kept, "source", "left")
    under = F.exists("cuts", lambda c: (F.col("p") == c) | F.startswith(F.col("p"), F.concat(c, F.lit("/"))))
    r = r.where(F.coalesce("whole", F.lit(True)) | under)
    named = runs.where(F.col("repo").isNotNull() & F.col("excluded_samples").isNotNull()).select(F.col("repo").alias("source"), F.explode("excluded_samples").alias("rule", "paths"))
    named = named.select("source", "rule", F.explode("paths").alias("path")).where(F.col("path").isNotNull()).groupBy("source", clean(F.col("path")).alias("p")).agg(F.min("rule").alias("caught_by"))
    return r.join(named, ["source", "p"], "left").select(F.col("id").alias("node_id"), "kind", "caught_by").distinct()

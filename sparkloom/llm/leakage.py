"""Problem 7: held-out evaluation items inside corpus documents, by one Aho-Corasick automaton."""

from __future__ import annotations

import html
import unicodedata
import uuid
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a row, words and share of edits of an edited passage, characters in a row for scripts without spaces.
WORDS, LOOSE_WORDS, LOOSE_SHARE, CHARS = 13, 20, 10, 30
#: A passage of LOOSE_WORDS with one edit in ten has this many untouched words in a row somewhere.
SEED = 6
#: Characters of item text one automaton is built from, at about 240 bytes each in every Python worker; more items take more automata, each a scan of its own.
MAX_ITEM_CHARS = 1_000_000

# Elements that stand inside a word or between two of one sentence without parting them.
INLINE = "a|abbr|b|bdi|cite|code|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|tt|u|var|wbr"
# a tag is a name and attributes, however long; no part of it is tried twice
_ATTRIBUTES = r"""(?:\s++[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'|[^\s"'<>]++))?+)*+\s*+"""
_NONE = rf"(?P<none></?(?:{INLINE}){_ATTRIBUTES}/?>|\]\([^()\s]++\))"
_GAP = rf"</?[a-zA-Z][\w:.-]*+{_ATTRIBUTES}/?>|<![a-zA-Z][^<>]*+>"
_ENTITY = r"(?P<ent>&(?:\#\d++|\#[xX][0-9a-fA-F]++|[a-zA-Z][a-zA-Z0-9]*+);)"
_MARKUP = regex.compile(rf"{_NONE}|(?P<gap>{_GAP})|{_ENTITY}")
_MARKUP_COMMENTS = regex.compile(rf"{_NONE}|(?P<gap><!--.*?-->|{_GAP})|{_ENTITY}", regex.S)
_HYPHEN = regex.compile(r"(?<=\p{L})[-\u2010]\r?\n[\s>#/*-]*(?=\p{L})")
_GLUED = regex.compile(r"(?<=\p{L})[.!?,;:\u2013\u2014]+[\"\u201d\u00bb)]*(?=\p{L})")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")


class _Fold(dict):
    """Table for str.translate: a character's case-folded compatibility letters and digits without marks; nothing else is kept."""

    def __missing__(self, code: int) -> str:
        out = "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", chr(code)).casefold()) if c.isalnum())
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    return text.translate(_FOLD)


def strip_markup(text: str) -> tuple[str, list[tuple[int, int]]]:
    """Text without tags, link targets and entities, and steps (position in it, position in the original) to map offsets back."""
    if "<" not in text and "&" not in text and "](" not in text:
        return text, [(0, 0)]
    out, steps, at, size = [], [(0, 0)], 0, 0
    last = text.rfind("-->") + 3 if "<!--" in text else 2  # a comment that opens behind the last close is none
    for m in chain(_MARKUP_COMMENTS.finditer(text, 0, last) if last > 2 else (), _MARKUP.finditer(text, last if last > 2 else 0)):
        new = "" if m["none"] else " " if m["gap"] else html.unescape(m["ent"])
        if m["ent"] and new == m["ent"]:
            continue
        piece = text[at : m.start()] + new
        out.append(piece)
        size += len(piece)
        at = m.end()
        steps.append((size, at))
    out.append(text[at:])
    return "".join(out), steps


def words_of(plain: str) -> list[str]:
    """Folded words: pieces between white space that hold a letter or digit."""
    return [w for w in (fold(x) for x in _pieces(plain)) if w]


def _pieces(plain: str) -> list[str]:
    """Pieces between white space; words broken over a line are joined, and closing marks part words even without a space."""
    return _GLUED.sub(" ", _HYPHEN.sub("", plain)).split()


def is_unspaced(text: str, lang: str | None) -> bool:
    """Whether an item counts by characters: Chinese or Japanese, by its script where the language is not told."""
    if (lang or "").strip().lower()[:2] in ("zh", "ja"):
        return True
    n = sum(1 for c in text if c.isalpha())
    return n > 0 and len(_CJK.findall(text)) > 0.3 * n


class Matcher:
    """All items in one automaton; ``find`` scans a document once."""

    def __init__(self, items: Iterable[tuple]):
        import ahocorasick

        groups: dict[tuple[bool, str], list[int]] = defaultdict(list)
        self.answers: dict[str, set[int]] = defaultdict(set)
        for item_id, text, lang, *answer in items:
            if answer and answer[0] and (folded := fold(strip_markup(answer[0])[0])):
                self.answers[folded].add(item_id)
            if text and text.strip():
                plain = strip_markup(text)[0]
                groups[is_unspaced(plain, lang), " ".join(words_of(plain))].append(item_id)
        self.ids: list[list[int]] = []
        self.words: list[list[str]] = []
        self.starts: list[np.ndarray] = []
        uses: dict[str, list[tuple[int, int, bool]]] = defaultdict(list)
        for (chars, joined), ids in groups.items():
            w = joined.split()
            if not w:
                continue
            k = len(self.ids)
            self.ids.append(ids)
            self.words.append([] if chars else w)
            self.starts.append(np.concatenate([[0], np.cumsum([len(x) for x in w])]))
            stream = "".join(w)
            if chars:
                for i in range(max(1, len(stream) - CHARS + 1)):
                    uses[stream[i : i + CHARS]].append((k, -1 if len(stream) >= CHARS else -2, True))
            elif len(w) < WORDS:
                uses[stream].append((k, -2, True))
            else:
                for i in range(len(w) - SEED + 1):
                    uses["".join(w[i : i + SEED])].append((k, i, False))
        self.auto = ahocorasick.Automaton()
        for p in uses.keys() | (self.answers.keys() if uses else set()):
            self.auto.add_word(p, (len(p), uses.get(p, []), p if p in self.answers else None))
        if uses:
            self.auto.make_automaton()
        self.empty = not uses

    def find(self, text: str) -> list[tuple[int, int, int, bool]]:
        """``(item, start, end, answered)`` of the first passage of each item the text holds, as code points of the text; answered: its answer stands there too, as whole words."""
        if self.empty or not text:
            return []
        plain, steps = strip_markup(text)
        stream = fold(plain)
        hits: dict[tuple[int, int], list[int]] = defaultdict(list)
        spans: dict[int, tuple[int, int]] = {}
        whole: list[tuple[int, int, int]] = []
        told: dict[str, list[int]] = {}
        for end, (size, uses, answer) in self.auto.iter(stream):
            if answer is not None:
                told.setdefault(answer, []).append(end + 1)
            for k, i, done in uses:
                if not done:
                    hits[k, end + 1 - size - int(self.starts[k][i])].append(i)
                elif i == -1:
                    spans.setdefault(k, (end + 1 - size, end + 1))
                else:
                    whole.append((k, end + 1 - size, end + 1))
        if not hits and not spans and not whole:
            return []
        origin = None
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for (k, diag), found in hits.items():
            found.sort()
            first = prev = found[0]
            for i in [*found[1:], None]:
                if i is not None and i <= prev + 1:
                    prev = i
                    continue
                a, b = diag + int(self.starts[k][first]), diag + int(self.starts[k][prev + SEED])
                if prev - first + SEED >= WORDS:
                    spans.setdefault(k, (a, b))
                runs[k].append((first, prev + SEED, a))
                first = prev = i
        need = {k: r for k, r in runs.items() if k not in spans and len(self.words[k]) >= LOOSE_WORDS}
        if need or whole:
            doc_words, doc_at = [], []
            at = 0
            for x in _pieces(plain):
                w = fold(x)
                if w:
                    doc_words.append(w)
                    doc_at.append(at)
                    at += len(w)
            doc_at.append(at)
            edges = set(doc_at)
            for k, a, b in whole:
                if k not in spans and (not self.words[k] or (a in edges and b in edges)):
                    spans[k] = (a, b)
            for k, rs in need.items():
                for i, j, a in rs:
                    p = bisect_left(doc_at, a)
                    if p < len(doc_words) and doc_at[p] == a and doc_words[p : p + j - i] == self.words[k][i:j]:
                        got = edited_passage(self.words[k], doc_words, i, j, p)
                        if got:
                            spans[k] = (doc_at[got[0]], doc_at[got[1]])
                            break
        out = []
        if spans:
            sizes = np.fromiter((len(_FOLD[ord(c)]) for c in plain), dtype=np.int64, count=len(plain))
            origin = np.repeat(np.arange(len(plain)), sizes)
            keys = [s[0] for s in steps]

            def back(p: int) -> int:
                s = steps[max(0, bisect_left(keys, p + 1) - 1)]
                return s[1] + p - s[0]

            def apart(end: int, size: int) -> bool:
                a, b = int(origin[end - size]), int(origin[end - 1])
                return (_CJK.match(plain[a]) or a == 0 or not plain[a - 1].isalnum()) and (_CJK.match(plain[b]) or b + 1 == len(plain) or not plain[b + 1].isalnum())

            mine = {item for k in spans for item in self.ids[k]}
            answered = {i for t, ends in told.items() if (want := self.answers[t] & mine) and any(apart(e, len(t)) for e in ends) for i in want}
            for k, (a, b) in spans.items():
                s, e = back(int(origin[a])), back(int(origin[b - 1])) + 1
                out += [(item, s, e, item in answered) for item in self.ids[k]]
        return out


def _reach(a: list[str], b: list[str], most: int) -> list[tuple[int, int]]:
    """Of every number of edits up to ``most`` the furthest (words of a, words of b) that agree from the start."""
    n, m = len(a), len(b)
    best = []
    far = {0: 0}
    for e in range(most + 1):
        nxt: dict[int, int] = {}
        if e:
            for d, i in far.items():
                for nd, ni in ((d, i + 1), (d + 1, i + 1), (d - 1, i)):  # changed, dropped from the item, added in the document
                    if ni <= n and 0 <= ni - nd <= m and nxt.get(nd, -1) < ni:
                        nxt[nd] = ni
        else:
            nxt = far
        for d, i in nxt.items():
            j = i - d
            while i < n and j < m and a[i] == b[j]:
                i, j = i + 1, j + 1
            nxt[d] = i
        if not nxt:
            break
        far = nxt
        d, i = max(nxt.items(), key=lambda x: (x[1], -abs(x[0])))
        best.append((i, i - d))
    return best


def edited_passage(item: list[str], doc: list[str], i: int, j: int, p: int) -> tuple[int, int] | None:
    """Document words (start, end) of a passage around the agreeing words item[i:j] == doc[p:p+j-i] with at least
    LOOSE_WORDS words of the item and at most one edit in LOOSE_SHARE words, or None."""
    # a passage of twice LOOSE_WORDS or more has a half that is one itself, so a shortest one is shorter and has few edits
    longest = 2 * LOOSE_WORDS - 1
    most = longest // LOOSE_SHARE
    span = longest + most
    right = _reach(item[j : j + longest], doc[p + j - i : p + j - i + span], most)
    left = _reach(item[max(0, i - longest) : i][::-1], doc[max(0, p - span) : p][::-1], most)
    for el, (li, ld) in enumerate(left):
        for er, (ri, rd) in enumerate(right):
            n = li + (j - i) + ri
            if n >= LOOSE_WORDS and (el + er) * LOOSE_SHARE <= n:
                return p - ld, p + (j - i) + rd
    return None


_BUILT: dict[str, Matcher] = {}


def _matcher(key: str, rows: Broadcast) -> Matcher:
    """The automaton of a list of items, built once in a Python worker; only the last one is kept."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Matcher(rows.value)
    return _BUILT[key]


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, start_char, end_char, answered)``: documents that hold a passage of an item, and where it first is.

    A passage is 13 words of the item in a row (all of a shorter item), at least 20 words with at most one in
    ten changed, dropped or added, or 30 characters in a row for Chinese and Japanese. Case, punctuation,
    spacing, line breaks, mark-up, invisible characters and Unicode forms do not count. Items of the same
    text are found together. ``answered`` tells that the document holds the item's answer too; an answer alone
    is no leak. Null, empty and blank texts on either side hold nothing; empty tables give an empty result;
    other columns are ignored. The corpus is scanned where it lies, without a shuffle; items reach the
    executors as one list of about MAX_ITEM_CHARS characters per scan.
    """
    it = items.where(F.col("text").isNotNull() & (F.trim("text") != "")).select("item_id", "text", "lang", *(["answer"] if "answer" in items.columns else [F.lit(None).cast("string").alias("answer")]))
    total = it.agg(F.sum(F.length("text") + F.coalesce(F.length("answer"), F.lit(0)))).first()[0] or 0
    scans = int(total // MAX_ITEM_CHARS) + 1
    out = None
    for k in range(scans):
        mine = it if scans == 1 else it.where(F.pmod(F.xxhash64("item_id"), F.lit(scans)) == k)
        found = _scan(documents, [tuple(r) for r in mine.toLocalIterator()])
        out = found if out is None else out.unionByName(found)
    return out


def _scan(documents: DataFrame, rows: list[tuple]) -> DataFrame:
    sent, key = documents.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = _matcher(key, sent)
        for b in batches:
            got = [(d, *hit) for d, t in zip(b["doc_id"], b["text"]) if t for hit in m.find(t)]
            yield pd.DataFrame(got, columns=["doc_id", "item_id", "start_char", "end_char", "answered"])

    scanned = documents.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull()).mapInPandas(run, "doc_id long, item_id long, start_char int, end_char int, answered boolean")
    return scanned.distinct()

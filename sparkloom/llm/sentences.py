"""Problem 8: sentence units of texts in many languages, by a pushdown automaton over marks and layout."""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations after which a sentence goes on, whatever follows.
GOES_ON = (
    "dr prof mr mrs ms sr sra srta dra mme mlle mgr st hr frl ing hon gen col lt capt sgt rev "
    "vs cf eg ie viz vgl bzw ca approx resp incl ggf sog bspw evtl zb dh ua eds ed hrsg ej ex pág págs fig figs abb tab kap bd hl"
).split()
# Abbreviations that go on before a number and are words or ends otherwise.
BEFORE_NUMBER = "no nos nr nrs sec secs p pp s vol vols ch eq art arts ver v num núm n".split()
# Abbreviations that may end a sentence; it goes on before a small letter, a number or a mark.
MAY_END = "etc usw co inc ltd corp jr al ff f bros dept est min max std jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun".split()
# German month names, which follow an ordinal.
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split()
# Words of hesitation, whose dots end nothing.
HESITATION = "hm hmm well oh uh um er ah eh".split()

OPEN = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "〈": "〉", "‹": "›", "{": "}"}
CLOSE = set("”“»」』)]）】》〉›}")
_MARK = regex.compile("[\"“”„«»「」『』()\\[\\]（）【】《》〈〉‹›{}]")
_TERM = regex.compile(r"[.!?…。！？؟।॥｡．]+")
_FULL = set("。！？؟।॥｡．")
_LINE = regex.compile(r"[^\r\n\x0b\x0c\x85  ]*(?:\r\n|[\r\n\x0b\x0c\x85  ]|$)")
_HEAD = regex.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]|$)")
_FENCE = regex.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
_BULLET = regex.compile(r"[ \t]*[*+\-•‣◦·▪][ \t]+(?=\S)")
_NUMBER = regex.compile(r"[ \t]*(\d{1,4})[.)、）][ \t]+(?=\S)")
_QUOTED = regex.compile(r"[ \t]*(?:>[ \t]*)+")
_GLUED = regex.compile(r"\p{Lu}[\p{L}\p{M}\d_]*(?=[\s,.;:!?…'’\"”»]|$)|(?=[\p{Han}\p{Hiragana}\p{Katakana}])|\p{Arabic}{2}")
_THAI = regex.compile("[\u0e00-\u0e7f]")
_THAI_GAP = regex.compile(r"(?<=[^\s\r\n])[ \t ]+(?=[^\s\r\n])")


class Trie:
    """Abbreviations read backwards from their dot; a leaf holds their kind."""

    def __init__(self, kinds: dict[str, list[str]]):
        self.root: dict = {}
        for kind, words in kinds.items():
            for w in words:
                at = self.root
                for c in reversed(w):
                    at = at.setdefault(c, {})
                at[""] = kind

    def kind(self, s: str, end: int) -> str | None:
        """Kind of the abbreviation that ends before ``end``, if a whole word of letters is one."""
        at, i = self.root, end - 1
        while i >= 0:
            c = s[i]
            low = c.lower()
            if low not in at:
                return None if c.isalpha() else at.get("")
            at = at[low]
            i -= 1
        return at.get("")


#: Longer than every abbreviation and word of hesitation.
LONG_WORD = 2 * max(map(len, GOES_ON + BEFORE_NUMBER + MAY_END + HESITATION))
ABBREVIATIONS = Trie({"on": GOES_ON, "number": BEFORE_NUMBER, "may": MAY_END})


def blocks(text: str) -> Iterator[tuple[str, int, int]]:
    """``(kind, start, end)`` of the layout: paragraph, heading, item or fence; blank lines part them."""
    kind, start, end, number = "", 0, 0, None
    fence = None
    for m in _LINE.finditer(text):
        a, b = m.span()
        if a == b:
            break
        line = m.group()
        if fence:
            end = b
            f = _FENCE.match(line)
            if f and f[1].startswith(fence) and not line[f.end() :].strip():
                yield "fence", start, end
                fence, kind = None, ""
            continue
        q = _QUOTED.match(line)
        if not line.strip() or (q and not line[q.end() :].strip()):
            if kind:
                yield kind, start, b if q and line.strip() else end
            elif q and line.strip():
                yield "heading", a, b
            kind, number = "", None
            continue
        f = _FENCE.match(line)
        if f:
            if kind:
                yield kind, start, end
            kind, number, fence, start, end = "", None, f[1], a, b
            continue
        if _HEAD.match(line):
            if kind:
                yield kind, start, end
            yield "heading", a, b
            kind, number = "", None
            continue
        bullet, num = _BULLET.match(line), _NUMBER.match(line)
        # a number starts an item at the start of a block or as the next of its list: lines may be wrapped before any number
        new = (bullet and kind in ("", "item")) or (num and (kind == "" or (kind == "item" and number is not None and int(num[1]) == number + 1)))
        if new:
            if kind:
                yield kind, start, end
            kind, start, end, number = "item", a, b, int(num[1]) if num and not bullet else None
            continue
        if not kind:
            kind, start = "paragraph", a
        end = b
    if fence:
        yield "fence", start, end
    elif kind:
        yield kind, start, end


def outer_pairs(s: str) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Outermost matched pairs in order, and every matched closing mark with its opening one; unmatched marks are no marks."""
    stack: list[tuple[str, int]] = []
    match: dict[int, int] = {}
    held: Counter = Counter()  # closing marks that something on the stack waits for

    def pop(k: int) -> None:
        for c, _ in stack[k:]:
            for x in OPEN.get(c, c):
                held[x] -= 1
        del stack[k:]

    for m in _MARK.finditer(s):
        i, c = m.start(), m.group()
        k = None
        if held[c] > 0:
            k = next(x for x in range(len(stack) - 1, -1, -1) if c in OPEN.get(stack[x][0], stack[x][0]))
        if c == '"':
            fresh = i + 1 < len(s) and not s[i + 1].isspace() and (i == 0 or s[i - 1].isspace())
            if k is not None and not fresh:
                match[i] = stack[k][1]
            if k is not None:
                pop(k)
            if k is None or fresh:
                stack.append((c, i))
                held[c] += 1
            continue
        if c in CLOSE and k is not None:
            match[i] = stack[k][1]
            pop(k)
        elif c in OPEN:
            stack.append((c, i))
            for x in OPEN[c]:
                held[x] += 1
    outer: list[tuple[int, int]] = []
    for close, op in sorted(match.items(), key=lambda x: (x[1], -x[0])):
        if not outer or op > outer[-1][1]:
            outer.append((op, close))
    return outer, match


class _Token:
    """The characters without white space before a place that only moves on: where they begin, and their last ``://`` and ``@``."""

    __slots__ = ("s", "seen", "start", "scheme", "at")

    def __init__(self, s: str):
        self.s, self.seen, self.start, self.scheme, self.at = s, 0, 0, -1, -1

    def to(self, i: int) -> None:
        s, seen = self.s, self.seen
        self.start = max(self.start, s.rfind(" ", seen, i) + 1, s.rfind("\n", seen, i) + 1)
        self.scheme = max(self.scheme, s.rfind("://", max(0, seen - 2), i))
        self.at = max(self.at, s.rfind("@", seen, i))
        self.seen = i


def _word_start(s: str, i: int) -> int:
    """Where the letters and marks that end before ``i`` begin; of a word longer than LONG_WORD some place inside it, as no rule tells such words apart."""
    least = max(0, i - LONG_WORD)
    while i > least and (s[i - 1].isalpha() or (s[i - 1] > "\u02ff" and unicodedata.category(s[i - 1])[0] == "M")):
        i -= 1
    return i


def _first_letter(s: str, i: int) -> str:
    """First letter or digit from ``i`` on, over opening marks, inverted marks and white space; else the character there."""
    j = i
    while j < len(s) and (s[j] in OPEN or s[j] in '"¿¡\'‘' or s[j].isspace()):
        j += 1
    return s[j] if j < len(s) else ""


def _is_end(s: str, i: int, j: int, k: int, opened: int | None, unit: int, token: _Token) -> bool:
    """Whether the mark s[i:j], with closing marks up to k, ends the unit that began at ``unit``; ``opened`` is where the last of these opened, ``token`` stands at i."""
    run = s[i:j]
    nxt = k
    while nxt < len(s) and s[nxt].isspace():
        nxt += 1
    if nxt == len(s):
        return True
    gap = nxt > k
    first = _first_letter(s, nxt)
    small = first.islower() and s[nxt] not in "¿¡"
    if any(c in _FULL for c in run):
        if opened is not None:
            if s[nxt] in "とって":
                return False
            if opened == unit and not gap:
                return False
            if small and gap:
                return False
        return True
    if "…" in run or (run.startswith("..") and len(run) > 1):
        word = s[_word_start(s, i) : i]
        if not gap and opened is None or small or "……" in run:
            return False
        return word.lower() not in HESITATION
    if "!" in run or "?" in run:
        if opened is not None:
            return not small and (gap or first.isupper() or not first.isascii())
        if gap:
            return True
        if s[nxt] in OPEN or s[nxt] in '"¿¡':
            return not small
        return bool(_GLUED.match(s, nxt)) and token.scheme < max(unit, token.start)
    # one dot
    if opened is not None:
        return not small and (gap or first.isupper())
    prev = s[i - 1] if i else " "
    if not gap:
        n = i - max(token.start, _word_start(s, i))
        if token.scheme >= token.start or token.at >= token.start or prev.isspace() or n == 1 or (n and ABBREVIATIONS.kind(s, i) == "on"):
            return False
        if s[nxt] in OPEN or s[nxt] == '"':
            return first.isupper()
        return bool(_GLUED.match(s, nxt))
    if prev.isspace():
        return not small
    if "ऀ" <= prev <= "ॿ":
        return False
    if prev.isdigit():
        d = i
        while d and s[d - 1].isdigit():
            d -= 1
        if i - d <= 2 and (d == 0 or s[d - 1] not in ".,:_-" and not s[d - 1].isalpha()) and any(s.startswith(m, nxt) for m in MONTHS):
            return False
        return not small
    b = _word_start(s, i)
    if b == i:
        return not small or len(s[max(0, i - 3) : i].strip()) == 3
    word = s[b:i]
    if len(word) == 1:
        if b and s[b - 1] == "." and s[b - 2 : b - 1].lower() in ("a", "p") and word.lower() == "m":
            return not small
        return False
    kind = ABBREVIATIONS.kind(s, i)
    if kind == "on":
        return False
    if kind == "number" and first.isdigit():
        return False
    if kind == "may":
        return first.isalpha() and not small
    if small:
        return len(word) >= 4
    return True


def sentences_of(s: str) -> list[tuple[int, int]]:
    """Units of one paragraph as offsets in it, without outer white space."""
    outer, match = outer_pairs(s)
    opens = [p[0] for p in outer]
    cuts: list[int] = []

    def inside(p: int) -> tuple[int, int] | None:
        x = bisect_right(opens, p) - 1
        return outer[x] if x >= 0 and outer[x][0] < p <= outer[x][1] else None

    unit, token = _start(s, 0), _Token(s)
    for m in _TERM.finditer(s):
        i, j = m.span()
        if cuts and i < cuts[-1]:
            continue
        k, opened = j, None
        while True:
            q = k
            while q < len(s) and s[q].isspace():
                q += 1
            if q < len(s) and q in match and (q == k or s[q] in "»"):
                k, opened = q + 1, match[q]
            else:
                break
        if inside(k) if k < len(s) else None:
            continue
        token.to(i)
        if _is_end(s, i, j, k, opened, unit, token):
            cuts.append(k)
            unit = _start(s, k)
    if _THAI.search(s):
        thai = lambda c: "฀" <= c <= "๿"
        for m in _THAI_GAP.finditer(s):
            a, b = s[m.start() - 1], s[m.end()]
            if not (thai(a) or thai(b)) or a in "ๆฯ" or b == "ๆ" or a.isdigit() or b.isdigit() or inside(m.start()) or (thai(a) and b.isascii() and b.islower()) or a == ">":
                continue
            cuts.append(m.start())
        cuts = sorted(set(cuts))
    out, at = [], 0
    for c in [*cuts, len(s)]:
        a, b = at, c
        while a < b and s[a].isspace():
            a += 1
        while b > a and s[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
        at = c
    return out


def _start(s: str, i: int) -> int:
    while i < len(s) and (s[i].isspace() or s[i] == ">"):
        i += 1
    return i


def units_of(text: str) -> list[tuple[int, int]]:
    """Sentence units of a text as code-point offsets."""
    out = []
    for kind, a, b in blocks(text):
        if kind == "paragraph":
            out += [(a + x, a + y) for x, y in sentences_of(text[a:b])]
        else:
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((a, b))
    return out


def sentence_units(documents: DataFrame) -> DataFrame:
    """``(doc_id, start_char, end_char)`` of every sentence unit, as code points of ``text``, end exclusive.

    One pass per text over its layout (blank lines, headings, items, fences), a stack of quotes and brackets,
    tries of abbreviations and the end marks of the scripts; the language column is not needed. Units cover
    all that is not white space and never overlap. Null, empty and blank texts have no unit; texts are
    handled whole and where they lie, without a shuffle; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, starts, ends = [], [], []
            for d, t in zip(b["doc_id"], b["text"]):
                for s, e in units_of(t):
                    ids.append(d)
                    starts.append(s)
                    ends.append(e)
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "start_char": pd.Series(starts, dtype="int32"), "end_char": pd.Series(ends, dtype="int32")})

    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInPandas(run, "doc_id long, start_char int, end_char int")

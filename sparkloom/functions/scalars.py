"""Scalar functions as Column expressions: all stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000


def text(c: Column | str) -> Column:
    """A text column whose null is the empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def meta(key: str, col: str = "metadata") -> Column:
    """Value of a metadata key; an absent key, a null map and a null value read as empty."""
    return F.coalesce(F.try_element_at(F.col(col), F.lit(key)), F.lit(""))


# --- string functions of the dataflow language: all take and give texts, empty is false ---
def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def byte_length(c: Column) -> Column:
    return F.octet_length(c).cast("string")


def byte_slice(c: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a text; offsets are clamped, start beyond end gives an empty text, an offset that is no integer raises."""

    def whole(x: Column) -> Column:
        return F.when(x.rlike(r"^[+-]?\d+$"), x.cast("long")).otherwise(F.raise_error(F.concat(F.lit("slice: not an integer: "), x)).cast("long"))

    n = F.octet_length(c).cast("long")
    a = F.least(F.greatest(whole(start), F.lit(0)), n)
    b = F.least(F.greatest(whole(end), F.lit(0)), n)
    return F.when(a >= b, F.lit("")).otherwise(F.decode(F.substring(F.encode(c, "UTF-8"), (a + 1).cast("int"), (b - a).cast("int")), "UTF-8"))


def match_group(c: Column, pattern: str, n: int) -> Column:
    """n-th group of the first match, 0 the whole match; an empty text where there is none."""
    check_pattern(pattern)
    return F.regexp_extract(c, pattern, n)


def check_pattern(pattern: str) -> str:
    """Refuses patterns that are not valid or look around or back, which the language's dialect does not have."""
    if re.search(r"\(\?(?:<?[=!])|\\[1-9]", pattern):
        raise ValueError(f"lookaround and back references are not part of the language: {pattern!r}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"bad pattern {pattern!r}: {e}") from None
    return pattern


def truthy(c: Column) -> Column:
    return c != ""


def and_(a: Column, b: Column) -> Column:
    return F.when(truthy(a) & truthy(b), b).otherwise(F.lit(""))


def or_(a: Column, b: Column) -> Column:
    return F.when(truthy(a), a).otherwise(b)


def not_(a: Column) -> Column:
    return F.when(truthy(a), F.lit("")).otherwise(F.lit("1"))


def stable_id(target: Column, source: Column, kind: Column, identity: Column) -> Column:
    """16 hex characters of the SHA-256 over the four texts parted by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", text(target), text(source), text(kind), text(identity)), 256), 1, 16)


# --- numbers in texts ---
def finite(c: Column) -> Column:
    """Text as a finite double, null otherwise."""
    d = F.trim(c).try_cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf")), d)


def compare(op: str, c: Column, want: float) -> Column:
    """Ordered comparison of a text as a number; a text that is none raises."""
    ops = {"eq": "__eq__", "ne": "__ne__", "lt": "__lt__", "lte": "__le__", "gt": "__gt__", "gte": "__ge__"}
    if op not in ops:
        raise ValueError(f"unknown operator {op!r}")
    d = finite(c)
    return F.when(d.isNull(), F.raise_error(F.concat(F.lit("not a number: "), text(c))).cast("boolean")).otherwise(getattr(d, ops[op])(F.lit(float(want))))


# --- time ---
def parse_instant(c: Column) -> Column:
    """RFC3339 with or without a fraction, else seconds since the epoch, as a timestamp; null otherwise."""
    rfc = c.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")
    return F.when(rfc, F.upper(c).try_cast("timestamp")).when(c.rlike(r"^-?\d{1,12}$"), F.timestamp_seconds(c.try_cast("long")))


_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}


def parse_duration(s: str) -> float:
    """Seconds of a duration such as ``24h``, ``1h30m`` or ``7d``; ValueError otherwise."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h|d)", s.strip())
    if not parts or "".join(a + b for a, b in parts) != s.strip():
        raise ValueError(f"bad duration {s!r}")
    return sum(float(a) * _UNITS[b] for a, b in parts)


def duration_seconds(c: Column) -> Column:
    """Seconds of a duration text such as ``24h``, ``1h30m`` or ``7d``; null where it cannot be read."""
    t = F.trim(c)
    parts = F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?(?:ns|us|µs|ms|s|m|h|d))"), 1)
    unit = F.create_map(*[F.lit(x) for u, f in _UNITS.items() for x in (u, f)])
    value = lambda p: F.regexp_extract(p, r"^([\d.]+)", 1).cast("double") * F.try_element_at(unit, F.regexp_extract(p, r"([a-zµ]+)$", 1))
    return F.when(t.rlike(r"^(\d+(\.\d+)?(ns|us|µs|ms|s|m|h|d))+$"), F.aggregate(parts, F.lit(0.0), lambda a, p: a + value(p)))


def age_days(now_ns: int, at: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(now_ns) - at) / float(DAY_NS))


def recency(now_ns: int, at: Column) -> Column:
    """1/(1+log2(1+age/30 days)); no instant gives 0.5, the future counts as now."""
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.lit(0.5)).otherwise(1 / (1 + F.log2(1 + age_days(now_ns, at) / 30)))


def temporal_boost(score: Column, now_ns: int, at: Column, half_life: float = 30.0) -> Column:
    """score (1 + 0.5^(age/half life)); no instant counts half, a half life of 0 or less is 30 days."""
    h = half_life if half_life > 0 else 30.0
    return score * (1 + F.when(F.coalesce(at, F.lit(0)) == 0, F.lit(0.5)).otherwise(F.pow(F.lit(0.5), age_days(now_ns, at) / h)))


# --- vectors ---
def longs_of(v: Column) -> Column:
    """A packed vector of 32 bytes as four longs."""
    h = F.hex(v)
    return F.array(*[F.conv(F.substring(h, 16 * i + 1, 16), 16, -10).cast("long") for i in range(4)])


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two packed 32-byte vectors differ; null for another width."""
    ok = (F.octet_length(a) == 32) & (F.octet_length(b) == 32)
    la, lb = longs_of(a), longs_of(b)
    return F.when(ok, sum((F.bit_count(la[i].bitwiseXOR(lb[i])) for i in range(1, 4)), F.bit_count(la[0].bitwiseXOR(lb[0]))))


def bit_similarity(a: Column, b: Column) -> Column:
    return F.coalesce(1 - hamming(a, b) / 256.0, F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sign_bits(v: Column, size: int = 64) -> Column:
    """Sign bits of a float array as a long, the first value highest."""
    return F.aggregate(v, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))


# --- text ---
def tokens(c: Column) -> Column:
    """Search tokens: whole words of at least two bytes, their snake parts and camel parts, in lower case, repeated as often as they occur.

    A part equal to its whole word counts once.
    """
    words = F.filter(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: F.octet_length(w) >= 2)

    def parts(w: Column) -> Column:
        spaced = F.regexp_replace(F.regexp_replace(w, r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2"), r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
        pieces = F.filter(F.split(F.lower(F.regexp_replace(spaced, "_", " ")), " +"), lambda p: F.octet_length(p) >= 2)
        return F.concat(F.array(F.lower(w)), F.filter(pieces, lambda p: p != F.lower(w)))

    return F.flatten(F.transform(words, parts))


def keywords_of(*cols: Column) -> Column:
    """Distinct sorted tokens of several texts, joined by a space."""
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.array(*[tokens(c) for c in cols])))), " ")


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def dehyphenate(c: Column) -> Column:
    """Joins words broken over a line end."""
    return F.regexp_replace(c, r"(\p{Ll})-[ \t]*\r?\n[ \t]*(\p{Ll})", "$1$2")


def sanitize(c: Column) -> Column:
    """Valid UTF-8 of a text or of bytes."""
    return F.make_valid_utf8(c)


def fingerprint(c: Column) -> Column:
    """Running-head key: digits become #, page numbers at the edges go, space is collapsed, case is folded."""
    d = F.regexp_replace(F.lower(collapse_space(c)), r"\d", "#")
    return F.trim(F.regexp_replace(d, r"^(page |p\. ?)?#+( of #+)?[ |.-]*|[ |.-]*(page |p\. ?)?#+( of #+)?$", ""))


def canonical_url(c: Column) -> Column:
    """Scheme and host in lower case, no fragment, no slash at the end of a path but the root's; the query is kept; empty where there is no scheme and host."""
    u = F.regexp_replace(F.trim(c), r"#.*$", "")
    m = lambda n: F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?\s]+)([^?]*)(\?.*)?$", n)
    path = F.when(m(3) == "/", F.lit("/")).otherwise(F.regexp_replace(m(3), r"/+$", ""))
    return F.when(m(2) == "", F.lit("")).otherwise(F.concat(F.lower(m(1)), F.lit("://"), F.lower(m(2)), path, m(4)))


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?\s]*@)?([^/:?\s]+)", 1))


def same_host(a: Column, b: Column) -> Column:
    return (url_host(a) != "") & (url_host(a) == url_host(b))


def path_segments(c: Column) -> Column:
    return F.size(F.filter(F.split(F.regexp_extract(c, r"^[^:]+://[^/?]+([^?#]*)", 1), "/"), lambda p: p != ""))


def clamp(c: Column, n: int = 500) -> Column:
    return F.left(c, F.lit(n))


# What makes a query one for tests: calls of test frameworks and phrases anywhere in it, words as whole tokens.
TEST_CALLS = ("it(", "describe(", "test(", "beforeeach", "aftereach", "beforeall", "afterall")
TEST_PHRASES = ("unit test", "integration test", "e2e test", "end-to-end test")
TEST_WORDS = (
    "test tests tested testing spec specs mock mocks mocked mocking fixture fixtures assertion assertions assert asserts expect expects expected coverage describe context should"
).split()


def intent(c: Column) -> Column:
    """``test``, ``unknown`` or ``impl`` of a query: tests by calls, phrases or words between white space, else unknown up to two words."""
    q = F.lower(c)
    words = F.filter(F.split(q, r"[\s\x0b\p{Z}\x85]+"), lambda w: w != "")
    tests = F.arrays_overlap(words, F.array(*[F.lit(w) for w in TEST_WORDS]))
    for t in (*TEST_CALLS, *TEST_PHRASES):
        tests = tests | q.contains(t)
    return F.when(tests, F.lit("test")).when(F.size(words) <= 2, F.lit("unknown")).otherwise(F.lit("impl"))


# --- ranks ---
def severity(p: Column) -> Column:
    return F.when(p >= 99, F.lit("critical")).when(p >= 95, F.lit("warning")).when(p >= 80, F.lit("notice")).otherwise(F.lit("info"))


#: Functions of the dataflow language by name: (least, most number of arguments, builder); most None is any.
BUILTINS: dict[str, tuple[int, int | None, object]] = {
    "concat": (0, None, lambda *a: F.concat(*a) if a else F.lit("")), "trim": (1, 1, trim), "lower": (1, 1, F.lower), "upper": (1, 1, F.upper),
    "length": (1, 1, byte_length), "slice": (3, 3, byte_slice), "and": (2, 2, and_), "or": (2, 2, or_), "not": (1, 1, not_),
}


def register_builtin(name: str, fn, least: int = 1, most: int | None = 1) -> None:
    """Adds a function over text columns to the dataflow language."""
    if name in BUILTINS:
        raise ValueError(f"{name} exists")
    BUILTINS[name] = (least, most, fn)

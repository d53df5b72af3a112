"""Text runs of PDF files: objects, Flate streams and the text operators of content streams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = "doc string, page int, x double, y double, size double, font string, text string"
_OBJ = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_OPS = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+")
_ESC = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _text(token: bytes) -> str:
    if token[:1] == b"<":
        raw = bytes.fromhex(re.sub(rb"\s", b"", token[1:-1] + (b"0" if len(re.sub(rb"\s", b"", token)) % 2 else b"")).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: b"" if m[1][-1:] == b"\n" else bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESC.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw.decode("utf-16-be", "replace")[1:] if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def _objects(data: bytes) -> dict[int, bytes]:
    out = {int(m[1]): m[3] for m in _OBJ.finditer(data)}
    for body in list(out.values()):  # objects inside object streams
        if b"/ObjStm" in body:
            s, n, first = _stream(body), re.search(rb"/N\s+(\d+)", body), re.search(rb"/First\s+(\d+)", body)
            if s and n and first:
                head = s[: int(first[1])].split()
                at = [(int(head[2 * i]), int(head[2 * i + 1])) for i in range(min(int(n[1]), len(head) // 2))]
                for i, (num, off) in enumerate(at):
                    end = at[i + 1][1] if i + 1 < len(at) else len(s)
                    out.setdefault(num, s[int(first[1]) + off : int(first[1]) + end])
    return out


def _stream(body: bytes) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    if b"/FlateDecode" in body[: m.start()]:
        try:
            return zlib.decompressobj().decompress(m[1])
        except zlib.error:
            return b""
    return m[1] if b"/Filter" not in body[: m.start()] else b""


def text_runs(data: bytes) -> list[tuple[int, float, float, float, str, str]]:
    """``(page, x, y from the top, size, font, text)`` of a file; encrypted files and unknown filters give nothing."""
    objs = _objects(data)
    if b"/Encrypt" in data[-2048:]:
        return []
    out = []
    pages = [(n, b) for n, b in sorted(objs.items()) if re.search(rb"/Type\s*/Page\b", b)]
    order = [int(x) for b in objs.values() if re.search(rb"/Type\s*/Pages\b", b) for x in _REF.findall(re.search(rb"/Kids\s*\[(.*?)\]", b, re.S)[1] if re.search(rb"/Kids\s*\[", b) else b"")]
    pages.sort(key=lambda p: order.index(p[0]) if p[0] in order else len(order) + p[0])
    for page, (_, body) in enumerate(pages):
        box = re.search(rb"/MediaBox\s*\[\s*([-\d.\s]+)\]", body) or re.search(rb"/MediaBox\s*\[\s*([-\d.\s]+)\]", data)
        top = float(box[1].split()[3]) if box else 792.0
        c = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.S)
        content = b"\n".join(_stream(objs.get(int(r), b"")) for r in _REF.findall(c[1])) if c else b""
        res = body + b"".join(objs.get(int(r), b"") for r in re.findall(rb"/(?:Resources|Font)\s+(\d+)\s+\d+\s+R", body))
        fonts = {m[1].decode(): (re.search(rb"/BaseFont\s*/([^\s/>]+)", objs.get(int(m[2]), b"")) or [b"", b"?"])[1].decode("latin1") for m in re.finditer(rb"/(\w+)\s+(\d+)\s+\d+\s+R", res)}
        out += [(page, x, top - y, s, fonts.get(f, f), t) for x, y, s, f, t in _page(content)]
    return out


def _page(content: bytes) -> Iterator[tuple[float, float, float, str, str]]:
    stack: list = []
    font, size, lead, scale = "", 0.0, 0.0, 1.0
    x = y = lx = ly = 0.0
    inside = None
    for m in _OPS.finditer(content):
        t = m.group()
        if t == b"[":
            inside = []
            continue
        if t == b"]":
            stack.append(inside)
            inside = None
            continue
        if t[:1] in b"(<" or t[:1] == b"/" or re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            (stack if inside is None else inside).append(t)
            continue
        n = lambda k: [float(v) for v in stack[-k:]]  # noqa: E731, B023
        try:
            if t == b"BT":
                x = y = lx = ly = 0.0
                scale = 1.0
            elif t == b"Tf":
                font, size = stack[-2][1:].decode("latin1"), float(stack[-1])
            elif t == b"TL":
                lead = n(1)[0]
            elif t in (b"Td", b"TD"):
                dx, dy = n(2)
                lead = -dy if t == b"TD" else lead
                lx, ly = lx + dx * scale, ly + dy * scale
                x, y = lx, ly
            elif t == b"Tm":
                a, b, _, d, e, f = n(6)
                scale = (b * b + d * d) ** 0.5 if b else abs(d)
                lx, ly = e, f
                x, y = e, f
            elif t in (b"T*", b"'", b'"'):
                ly -= lead * scale
                x, y = lx, ly
            if t in (b"Tj", b"'", b'"') and stack:
                yield x, y, size * scale, font, _text(stack[-1])
            elif t == b"TJ" and stack and isinstance(stack[-1], list):
                s = ""
                for v in stack[-1]:
                    s += _text(v) if v[:1] in b"(<" else (" " if float(v) < -200 else "")
                yield x, y, size * scale, font, s
        except (ValueError, IndexError, TypeError):
            pass
        stack = []


def runs_of(files: DataFrame) -> DataFrame:
    """RUNS of binary files ``(path, content)`` as the ``binaryFile`` reader gives them; for :func:`layout_blocks`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *r) for p, c in zip(b["path"], b["content"]) if c for r in text_runs(bytes(c))]
            yield pd.DataFrame(rows, columns=["doc", "page", "x", "y", "size", "font", "text"])

    return files.select("path", "content").where(F.col("content").isNotNull()).mapInPandas(run, RUNS)

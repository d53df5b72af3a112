"""Runs registered queries beside their SQL: python tests/compare.py FOLDER [NAME...]"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, bytearray | bytes):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return int(v) if isinstance(v, bool) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(folder):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(folder):
        p = f"{folder}/{t}"
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def compare(spark, con, folder, name, fn, sql):
    df = fn(spark, folder)
    got = rows_of(df.columns, df.collect())
    if not sql:
        return "rows", len(got), ""
    cur = con.execute(sql)
    cols = [x[0] for x in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return "COLUMNS", len(got), f"{sorted(df.columns)} {sorted(cols)}"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return "DIFFER", len(got), f"{len(want)} wanted; only here {list(a - b)[:2]}; only there {list(b - a)[:2]}"
    return "ok", len(got), ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from sparkloom.runtime import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    s, con = build_session("4"), duck(folder)
    q, o = entry.queries(), entry.oracle_sql()
    for n in q:
        if names and not any(n.startswith(x) for x in names):
            continue
        t = time.time()
        try:
            r = compare(s, con, folder, n, q[n], o.get(n))
        except Exception as e:  # noqa: BLE001
            r = ("ERROR", 0, str(e)[:600])
        print(f"{r[0]:8} {r[1]:7} {time.time() - t:5.1f}s {n} {r[2][:700]}", flush=True)

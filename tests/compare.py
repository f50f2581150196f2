"""Compares registered queries with their SQL on the same parquet files."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return names, sorted(out, key=lambda r: tuple((x is None, type(x).__name__ if x is not None else "", str(x)) for x in r))


def compare(spark, con, name, fn, sql, folder):
    started = time.time()
    df = fn(spark, folder)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if sql is None:
        return ("rows" if got[1] else "EMPTY"), len(got[1]), took, None
    cur = con.execute(sql)
    want = table_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return "COLUMNS", len(got[1]), took, (got[0], want[0])
    if len(got[1]) != len(want[1]):
        return "COUNT", len(got[1]), took, (len(got[1]), len(want[1]), got[1][:2], want[1][:2])
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return "VALUES", len(got[1]), took, (got[0], len(bad), bad[:3])
    types = [
        (n, type(a).__name__, type(b).__name__)
        for n, *pair in zip(got[0], *[[next((r[i] for r in t if r[i] is not None), None) for i in range(len(got[0]))] for t in (got[1], want[1])])
        for a, b in [pair]
        if type(a) is not type(b)
    ]
    if types:
        return "TYPES", len(got[1]), took, types
    return ("ok" if got[1] else "EMPTY"), len(got[1]), took, None


def main(folder: str, only: list[str]) -> int:
    import __spark_entry__ as entry
    from fieldspark.session import build_session

    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    oracles, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        try:
            state, n, took, info = compare(spark, con, name, fn, oracles.get(name), folder)
        except Exception as e:
            state, n, took, info = "ERROR", 0, 0.0, str(e)[:1500]
        if state not in ("ok", "rows"):
            failed += 1
        print(f"{state:8} {name:34} rows={n:<8} {took:6.2f}s", flush=True)
        if info:
            print("    ", str(info)[:1500], flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)

"""Run each registered query on Spark and its oracle SQL on DuckDB, and compare.

Usage: python tests/oracle_compare.py [sf_dir] [query ...]
Comparison is order-insensitive, on columns sorted by name; floats are rounded.
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return [columns[i] for i in order], sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, sf_dir, names=None, verbose=True):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as E

    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        sdf = qs[name](spark, sf_dir)
        s_cols = sdf.columns
        s_rows = [tuple(r) for r in sdf.collect()]
        t1 = time.time()
        if name not in sql:
            results[name] = ("rows-only", len(s_rows))
            if verbose:
                print(f"{name:24s} spark={len(s_rows):8d} (no oracle) {t1 - t0:6.2f}s", flush=True)
            continue
        rel = con.sql(sql[name])
        d_cols = rel.columns
        d_rows = rel.fetchall()
        sc, sr = rows_of(s_cols, s_rows)
        dc, dr = rows_of(d_cols, d_rows)
        ok = sc == dc and sr == dr
        results[name] = ok
        if verbose:
            print(f"{name:24s} spark={len(sr):8d} duck={len(dr):8d} {'OK ' if ok else 'BAD'} {t1 - t0:6.2f}s",
                  flush=True)
            if not ok:
                if sc != dc:
                    print("   columns", sc, dc)
                else:
                    ss, ds = set(sr), set(dr)
                    print("   only spark:", list(ss - ds)[:3])
                    print("   only duck :", list(ds - ss)[:3])
    return results


if __name__ == "__main__":
    from shipyard.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_session("local[8]", 8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v is False]
    print("FAILED:", bad if bad else "none")

"""Compare every registered query with its SQL in a second engine."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import hashlib
import math
import os
import sys
import time

import duckdb


def canonical(value):
    if value is None:
        return "\0null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, decimal.Decimal, float)):
        v = float(value)
        return "nan" if math.isnan(v) else format(round(v, 6), ".6f")
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def signature(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\1".join(canonical(r[i]) for i in order) for r in rows)
    return len(lines), sorted(columns), hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def compare(spark, con, query, sql, sf):
    df = query(spark, sf)
    got = signature(df.columns, [tuple(r) for r in df.collect()])
    if not sql:
        return got[0] >= 0, got, None
    rel = con.execute(sql)
    want = signature([c[0] for c in rel.description], rel.fetchall())
    return got[:3] == want[:3], got, want


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from flakelens.session import build_session
    from flakelens.queries import catalog

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:] or list(catalog.CATALOG)
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name in names:
        query, sql = catalog.CATALOG[name]
        start = time.time()
        try:
            ok, got, want = compare(spark, con, query, sql, sf)
        except Exception as e:  # noqa: BLE001
            ok, got, want = False, None, None
            print(name, "EXCEPTION", str(e)[:1500])
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} rows={got and got[0]} sql={'yes' if sql else 'no'} {time.time()-start:.2f}s", flush=True)
        if not ok and got and want:
            print("  columns", got[1], want[1], "rows", got[0], want[0])
            a, b = set(got[3]), set(want[3])
            print("  only spark", [x[:400] for x in sorted(a - b)[:2]])
            print("  only sql  ", [x[:400] for x in sorted(b - a)[:2]])
    print("bad:", bad)

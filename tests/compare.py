"""Runs queries on both engines and compares values exactly."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


KIND = {"string": "s", "varchar": "s", "bigint": "i", "int": "i", "integer": "i", "double": "f", "date": "d",
        "boolean": "b", "hugeint": "HUGE", "timestamp": "t", "smallint": "i"}


def compare(spark, con, name, fn, oracle, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_s = time.time() - t
    if oracle is None:
        return f"rows-only {len(got)}", spark_s, 0.0
    t = time.time()
    cur = con.execute(oracle)
    ocols = [d[0] for d in cur.description]
    otypes = [str(d[1]).lower() for d in cur.description]
    want = cur.fetchall()
    duck_s = time.time() - t
    gc, g = rows_of(df.columns, got)
    wc, w = rows_of(ocols, want)
    if gc != wc:
        return f"COLUMNS {gc} != {wc}", spark_s, duck_s
    st = dict(df.dtypes)
    for c, ot in zip(ocols, otypes):
        if KIND.get(st[c], st[c]) != KIND.get(ot, ot):
            return f"TYPE {c}: {st[c]} vs {ot}", spark_s, duck_s
    if len(g) != len(w):
        return f"ROWS {len(g)} != {len(w)}: {[x for x in g if x not in set(w)][:2]} / {[x for x in w if x not in set(g)][:2]}", spark_s, duck_s
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    if bad:
        return f"VALUES {len(bad)}/{len(g)}: {bad[0]}", spark_s, duck_s
    return f"ok {len(g)}", spark_s, duck_s


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from tremor.plans import registry
    from tremor.session import build_session

    sf = sys.argv[1]
    only = sys.argv[2:]
    registry.load_all()
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    bad = 0
    for name, fn in registry.QUERIES.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            res, a, b = compare(spark, con, name, fn, registry.ORACLES.get(name), sf)
        except Exception as exc:  # noqa: BLE001
            res, a, b = f"ERROR {type(exc).__name__}: {str(exc)[:600]}", 0, 0
        flag = "" if res.startswith(("ok", "rows-only")) else "  <<<<<<"
        bad += bool(flag)
        print(f"{name:36s} spark {a:6.2f} duck {b:6.2f}  {res[:700]}{flag}", flush=True)
    print("failed:", bad)

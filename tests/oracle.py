"""Compare registered queries with their SQL twins in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import time

import duckdb

from kilnset.tables import NAMES


def connect(folder: str):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "asDict"):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def compare(spark, run, sql, folder):
    """-> dict(status, rows, seconds, note); status is ok, rows or fail."""
    t0 = time.time()
    df = run(spark, folder)
    cols = sorted(df.columns)
    left = [tuple(_plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    secs = time.time() - t0
    if sql is None:
        return {"status": "rows", "rows": len(left), "seconds": secs, "note": ""}
    cur = connect(folder).execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return {"status": "fail", "rows": len(left), "seconds": secs, "note": f"columns {cols} vs {sorted(names)}"}
    idx = [names.index(c) for c in cols]
    right = [tuple(_plain(r[i]) for i in idx) for r in cur.fetchall()]
    order = lambda r: repr(r)
    left.sort(key=order)
    right.sort(key=order)
    if len(left) != len(right):
        return {"status": "fail", "rows": len(left), "seconds": secs, "note": f"rows {len(left)} vs {len(right)}"}
    for a, b in zip(left, right):
        if a != b or [type(x) is bool for x in a] != [type(x) is bool for x in b]:
            return {"status": "fail", "rows": len(left), "seconds": secs, "note": f"\n  spark {cols} {a}\n  sql   {b}"[:1500]}
    kinds = [type(next((r[i] for r in left if r[i] is not None), None)) for i in range(len(cols))]
    sq_kinds = [type(next((r[i] for r in right if r[i] is not None), None)) for i in range(len(cols))]
    if kinds != sq_kinds:
        return {"status": "fail", "rows": len(left), "seconds": secs, "note": f"types {cols} {kinds} vs {sq_kinds}"}
    return {"status": "ok", "rows": len(left), "seconds": secs, "note": ""}


if __name__ == "__main__":
    import sys

    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    import os
    import tempfile

    from pyspark.sql import SparkSession

    from kilnset.session import build_session

    if os.environ.get("PLAIN_SESSION"):  # Spark's own defaults
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    else:
        spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                              spark__driver__memory="12g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="oracle-"))
    spark.sparkContext.setLogLevel("OFF")
    sqls = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        known = entry.catalog.QUERIES.get(name)
        mod = known.run.__module__.rsplit(".", 1)[-1] if known else "llm"
        if wanted and not any(w in name or w == mod for w in wanted):
            continue
        try:
            res = compare(spark, run, sqls.get(name), f"/root/testdata/sf{sf}")
        except Exception as e:  # noqa: BLE001
            res = {"status": "error", "rows": -1, "seconds": 0.0, "note": "\n".join(x for x in str(e).splitlines() if "Error" in x or "Exception" in x)[:3000]}
        if res["status"] not in ("ok", "rows") or res["rows"] == 0:
            bad += 1
        print(f"{res['status']:6s} {name:40s} rows={res['rows']:<7d} {res['seconds']:.2f}s {res['note']}", flush=True)
    print("bad:", bad)

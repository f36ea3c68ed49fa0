"""Run every registered query against its SQL check and print what differs.

usage: python tools/verify.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from tidemark.catalog import REGISTRY
from tidemark.registry import BASE_TABLES
from tidemark.session import build_session


def norm(v):
    if v is None:
        return None
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.9g}" if v != 0 else "0"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 1 << 53 else str(v)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(norm(x)) for x in v) + "]"
    return str(v)


def kind(tp: str) -> str:
    tp = tp.lower()
    if tp.startswith("decimal"):
        return "decimal"
    return {"varchar": "string", "integer": "int", "hugeint": "hugeint"}.get(tp, tp)


def main() -> int:
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.001"
    want = [a for a in args if not os.path.isdir(a)]
    spark = build_session("verify", 8, 8, "8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name, q in sorted(REGISTRY.items()):
        if want and not any(w in name for w in want):
            continue
        t0 = time.time()
        try:
            df = q(spark, sf)
            cols = sorted(df.columns)
            got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
            stypes = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: spark: {str(e)[:600]}")
            continue
        t1 = time.time()
        if q.sql is None:
            print(f"rows  {name}: {len(got)} rows  {t1 - t0:.2f}s (no SQL twin)")
            continue
        try:
            r = con.execute(q.sql)
            dcols = [d[0] for d in r.description]
            dtypes = {d[0]: kind(str(d[1])) for d in r.description}
            rows = r.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: sql: {str(e)[:600]}")
            continue
        if sorted(dcols) != cols:
            bad += 1
            print(f"FAIL  {name}: columns {cols} vs {sorted(dcols)}")
            continue
        ix = [dcols.index(c) for c in cols]
        exp = [tuple(norm(row[i]) for i in ix) for row in rows]
        tdiff = {c: (stypes[c], dtypes[c]) for c in cols if stypes[c] != dtypes[c]}
        from collections import Counter
        a, b = Counter(got), Counter(exp)
        ok = a == b
        if not ok:
            bad += 1
            print(f"DIFF  {name}: {len(got)} vs {len(exp)} rows; cols {cols}")
            for x in sorted((a - b).items(), key=str)[:3]:
                print("      spark only:", str(x)[:500])
            for x in sorted((b - a).items(), key=str)[:3]:
                print("      sql only:  ", str(x)[:500])
        elif not got:
            bad += 1
            print(f"EMPTY {name}")
        else:
            print(f"ok    {name}: {len(got)} rows {t1 - t0:.2f}s/{time.time() - t1:.2f}s" + (f"  types {tdiff}" if tdiff else ""))
    print(f"{bad} problem(s)")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

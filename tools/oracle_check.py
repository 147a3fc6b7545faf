"""Run catalogue queries on Spark and their oracle SQL on DuckDB; compare
row count, column names and an order-insensitive multiset of values.

    python tools/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import collections
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from opinia.plans.registry import load_all  # noqa: E402
from opinia.session import TABLES, get_spark  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], collections.Counter(tuple(norm(r[i]) for i in order) for r in rows)


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    spark = get_spark()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs = load_all()
    bad = 0
    for name, q in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = q.build(spark, sf)
            srows = df.collect()
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if not q.sql:
            print(f"rows {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(q.sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        sc, sv = rows_of(scols, srows)
        dc, dv = rows_of(dcols, drows)
        if sc != dc:
            print(f"FAIL {name}: columns {sc} vs {dc}")
            bad += 1
        elif sv != dv:
            only_s = list((sv - dv).items())[:3]
            only_d = list((dv - sv).items())[:3]
            print(f"FAIL {name}: values differ ({len(srows)} vs {len(drows)} rows) spark-only {only_s} duck-only {only_d}")
            bad += 1
        else:
            print(f"ok   {name}: {len(srows)} rows {ts:.1f}s")
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main()

"""Run every registered query in Spark and its SQL oracle in DuckDB; compare.

    python tools/oracle_check.py [--plain] [sf_dir] [name-substring ...]

Prints one line per query: rows, column names, and whether the
order-insensitive value multisets agree exactly (and, if not, within 1e-9).
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from staylens.plans.catalog import oracle_sql, queries  # noqa: E402
from staylens.plans.session import get_spark  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v, tol=False):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) if tol else repr(v)
    if hasattr(v, "item") and not isinstance(v, (list, tuple, dict)):
        try:
            return norm(v.item(), tol)
        except Exception:
            pass
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, tol) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x, tol)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict(), tol)
    return v


def rows_of(records, cols, tol):
    return sorted((tuple(norm(r[c], tol) for c in cols) for r in records), key=repr)


def main():
    args = [a for a in sys.argv[1:] if a != "--plain"]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    only = args[1:]
    if "--plain" in sys.argv:  # a session as a caller would build it, no helper settings
        from pyspark.sql import SparkSession

        spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
                 .config("spark.ui.showConsoleProgress", "false").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = get_spark()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and not any(o in name for o in only):
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            srows = [r.asDict(recursive=True) for r in sdf.collect()]
            scols = sorted(sdf.columns)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: spark error {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS  {name}: spark rows={len(srows)} ({ts:.2f}s, no oracle)")
            continue
        try:
            res = con.execute(sqls[name])
            dcols_raw = [d[0] for d in res.description]
            drows = [dict(zip(dcols_raw, r)) for r in res.fetchall()]
            dcols = sorted(dcols_raw)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: duckdb error {str(e)[:300]}")
            bad += 1
            continue
        if scols != dcols:
            print(f"FAIL  {name}: columns spark={scols} duck={dcols}")
            bad += 1
            continue
        exact = rows_of(srows, scols, False) == rows_of(drows, dcols, False)
        close = exact or rows_of(srows, scols, True) == rows_of(drows, dcols, True)
        status = "OK   " if exact else ("NEAR " if close else "FAIL ")
        if not exact:
            bad += 1
        print(f"{status} {name}: rows spark={len(srows)} duck={len(drows)} ({ts:.2f}s)")
        if not close and os.environ.get("VERBOSE"):
            a, b = rows_of(srows, scols, False), rows_of(drows, dcols, False)
            diff_a = [r for r in a if r not in b][:3]
            diff_b = [r for r in b if r not in a][:3]
            print("   cols", scols)
            print("   spark-only", diff_a)
            print("   duck-only ", diff_b)
    print(f"done: {bad} not exact")


if __name__ == "__main__":
    main()

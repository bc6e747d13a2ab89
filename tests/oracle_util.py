"""DuckDB side of the oracle tests."""

import datetime as dt
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows(records, cols):
    return sorted((tuple(norm(r[c]) for c in cols) for r in records), key=repr)


def compare(spark_df, con, sql):
    s_cols = sorted(spark_df.columns)
    s_rows = [r.asDict(recursive=True) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols_raw = [d[0] for d in res.description]
    d_rows = [dict(zip(d_cols_raw, r)) for r in res.fetchall()]
    assert s_cols == sorted(d_cols_raw)
    assert len(s_rows) == len(d_rows)
    assert rows(s_rows, s_cols) == rows(d_rows, s_cols)

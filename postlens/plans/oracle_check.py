"""Compare a Spark query with its DuckDB SQL oracle on the same parquet.

Mirrors the driver's gate: row count, column names, and an
order-insensitive comparison of values (doubles compared at 1e-6).
"""

from __future__ import annotations

import math
import os

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duckdb_conn(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, sql: str, sf_dir: str, con=None, tol: float = 1e-6):
    """Return ``(ok, message)``."""
    con = con or duckdb_conn(sf_dir)
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} sql={sorted(d_cols)}"
    if len(s_rows) != len(d_rows):
        return False, f"row count differs: spark={len(s_rows)} sql={len(d_rows)}"
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    bad = 0
    first = None
    for x, y in zip(a, b):
        if x != y:
            ok = len(x) == len(y) and all(
                (u == v) or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= tol * max(1.0, abs(u)))
                for u, v in zip(x, y))
            if not ok:
                bad += 1
                first = first or (x, y)
    if bad:
        return False, f"{bad} rows differ; first: spark={first[0]} sql={first[1]}"
    return True, f"{len(a)} rows match"

"""Sinks (K1 - K8) and result loading.

Results are directories (Parquet / CSV / JSON written by executors), never
files assembled on the driver.  One-row summaries are written as JSON
with NaN turned into null.
"""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, functions as F


def params_key(params: dict) -> str:
    """Stable short hash of run parameters (result folders keyed by it)."""
    return hashlib.sha1(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:12]


def write_posts(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K1: processed posts (``user_id, timestamp, post_content``)."""
    w = df.select("user_id", "timestamp", "post_content").write.mode("overwrite")
    if fmt == "csv":
        (w.option("header", True).option("escape", '"')
          .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
          .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.parquet(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    cols = []
    for name, typ in df.dtypes:
        c = F.col(f"`{name}`")
        if typ in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        cols.append(c.alias(name))
    return df.select(*cols)


def write_summary(df: DataFrame, path: str) -> None:
    """K5 / K8: one-row summaries as JSON, NaN -> null."""
    nan_to_null(df).coalesce(1).write.mode("overwrite").json(path)


def write_temporal(temporal: DataFrame, path: str) -> None:
    """K7: long temporal table partitioned by time bin."""
    temporal.write.mode("overwrite").partitionBy("time_bin").parquet(path)


def write_results(results: dict[str, DataFrame], out_dir: str) -> dict[str, str]:
    """Write named result tables (K2 - K4, K6, K9) under ``out_dir``."""
    paths = {}
    for name, df in results.items():
        p = os.path.join(out_dir, name)
        if name.endswith("_summary"):
            write_summary(df, p)
        elif "time_bin" in df.columns and name.startswith("temporal"):
            write_temporal(df, p)
        else:
            df.write.mode("overwrite").parquet(p)
        paths[name] = p
    return paths


def read_result(spark, path: str) -> DataFrame | None:
    """Load a saved result (Parquet or JSON dir); a missing path gives None."""
    from ..sources.files import read_result as _rr
    return _rr(spark, path)

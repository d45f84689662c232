"""All registered queries and their SQL oracles."""

from __future__ import annotations

import importlib

# Queries with no SQL oracle (model fitting, iterative algorithms): the
# driver records a rows-only check; tests check properties instead.
ROWS_ONLY = set()

_MODULES = ["catalog_users", "catalog_text", "catalog_docs", "catalog_suspicion", "catalog_topics", "catalog_embed", "catalog_compare", "catalog_feeds", "catalog_io", "catalog_runs"]


def _collect():
    queries, sql = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(f"postlens.plans.{m}")
        for k in mod.QUERIES:
            if k in queries:
                raise ValueError(f"duplicate query {k}")
        queries.update(mod.QUERIES)
        sql.update(mod.SQL)
        ROWS_ONLY.update(getattr(mod, "ROWS_ONLY", ()))
    return queries, sql


def all_queries():
    return _collect()[0]


def all_sql():
    return _collect()[1]

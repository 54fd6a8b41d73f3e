"""Qname -> Spark query and Qname -> DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the whole corpus tables (or views derived
from them).  The oracle SQL sits next to its query; queries without SQL get the rows-only check.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            from redline.session import ship_package
            ship_package(spark)      # Python workers need the package for the pandas paths
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


PLAN_MODULES = ["q_compare", "q_text", "q_detect", "q_sections", "q_examples", "q_validate", "q_loader",
                "q_features", "q_scoring", "q_reports", "q_windows", "q_streaming"]


def load_all() -> None:
    # Import side effect: every plans module registers its queries.
    import importlib
    for m in PLAN_MODULES:
        importlib.import_module(f"redline.plans.{m}")

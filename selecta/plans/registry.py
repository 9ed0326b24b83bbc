"""Named queries and their DuckDB oracles.

A query is ``fn(spark, sf_dir) -> DataFrame``; its oracle, when the operator
is SQL-expressible, is one DuckDB statement over the raw tables with the same
column names. Doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def load_all() -> None:
    """Import every plan module so its queries register."""
    import importlib
    import pkgutil

    import selecta.plans as plans
    for mod in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        if mod.startswith("q_"):
            importlib.import_module(f"selecta.plans.{mod}")

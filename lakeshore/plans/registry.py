"""Registry of named queries: a Spark builder and, where SQL can say it, the
DuckDB oracle text.  Modules register with the ``query`` decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    for mod in (
        "lakeshore.plans.q_registry", "lakeshore.plans.q_split", "lakeshore.plans.q_links",
        "lakeshore.plans.q_text", "lakeshore.plans.q_schema", "lakeshore.plans.q_paths",
        "lakeshore.plans.q_ops", "lakeshore.plans.q_tasks", "lakeshore.plans.q_services",
        "lakeshore.plans.q_io", "lakeshore.plans.q_streams", "lakeshore.plans.q_folders", "lakeshore.plans.q_scan",
    ):
        importlib.import_module(mod)

"""Registry of the engine's queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under `name`, with its SQL where SQL can express it."""

    def add(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def _load() -> None:
    from importlib import import_module

    for module in ("build_queries", "aggregate_queries", "graph_queries", "space_queries", "time_queries", "source_queries", "helper_queries"):
        import_module(f"orrery.plans.{module}")


def queries() -> dict[str, Callable]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLES

"""All registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` together with its SQL."""

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = query
        if sql is not None:
            _SQL[name] = sql
        return query

    return add


MODULES = ("queries", "predicate_queries", "confidence_queries", "catalogue_queries", "evaluation_queries", "semantic_queries", "source_queries", "binding_queries", "state_queries")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"fieldloom.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL


FLAGSHIP = "ranked_candidates"

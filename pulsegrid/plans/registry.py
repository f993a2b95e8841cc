"""Registered queries and their DuckDB twins, gathered from the modules of this package."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("scoring", "joins", "selections", "evaluation", "text", "forecasting", "streams", "ingest", "studies", "live")
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its DuckDB twin where SQL can express it."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _ORACLE[name] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"pulsegrid.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)

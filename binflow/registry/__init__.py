"""Named queries over the driver's tables, each beside its DuckDB text."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from binflow.bindings import duckdb_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_GROUPS = ("bins", "features", "validation", "scores", "forest", "media", "runs", "detections", "inference", "provenance")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may name base tables and views as ``{name}``."""

    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = duckdb_sql(sql)
        return run

    return keep


def load_all() -> None:
    for group in _GROUPS:
        importlib.import_module(f"binflow.registry.{group}")

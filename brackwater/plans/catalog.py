"""The query catalogue: one name per operator family, with DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function under ``name``."""

    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


def load() -> None:
    """Imports the modules whose functions register themselves."""
    from . import assembly_queries, chunk_queries, device_queries, graph_queries, leak_queries, lint_queries, live_queries, nested_queries, predicate_queries, profile_queries, reconcile_queries, registry_queries, relational_queries, retrieval_queries, state_queries, telemetry_queries, text_queries, validation_queries  # noqa: F401

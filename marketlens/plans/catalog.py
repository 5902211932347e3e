"""The library's queries by name, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import lens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``build(v)``, where ``v(view)`` gives a market view, under a name, with the SQL for the same rows."""

    def register(build: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: build(lens.Views(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = lens.duckdb(sql)
        return build

    return register

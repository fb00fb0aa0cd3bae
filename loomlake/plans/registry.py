"""The registered queries of the record operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL of its twin where there is one."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add

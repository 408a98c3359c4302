"""Registration of queries with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and what DuckDB must give for it over the same tables. sql may use the relations of tallymill.sources.relations by name."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            from tallymill.sources.relations import with_relations

            ORACLES[name] = with_relations(sql)
        return function

    return add

"""Registration of queries with the SQL that says what they must give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.graph import EDGES_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, edges: bool = False, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query; ``edges`` puts the edge view's WITH clause before the SQL, which then
    begins with its own further parts or SELECT."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = (f"WITH {'RECURSIVE ' if recursive else ''}{EDGES_SQL} " + sql.strip()) if edges else sql.strip()
        return f

    return add

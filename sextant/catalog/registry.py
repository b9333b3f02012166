"""Named queries over the given tables, each with its reference SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, covers: str = "", sql: str | None = None):
    """Register a query, the inventory ids it covers, and its SQL counterpart."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = fn
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add

"""The queries of the library and their DuckDB twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SURVEY: dict[str, str] = {}


def query(name: str, row: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query for one row of the operator inventory."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        SURVEY[name] = row
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def n_rows() -> Column:
    """Row count of a group, under the name every query uses."""
    return F.count(F.lit(1)).alias("rows")


def load() -> None:
    """Import the modules that register queries."""
    from marketladder.plans import (  # noqa: F401
        q_diff,
        q_functions,
        q_items,
        q_matching,
        q_publish,
        q_quality,
        q_search,
        q_sources,
        q_state,
    )

"""Registry of driver-table queries and their DuckDB oracle SQL.

Each query is a function ``(spark, sf_dir) -> DataFrame`` that reads the
driver tables and calls library operators.  The oracle is the same result
written as plain SQL over views with the table names, so it can be run by
DuckDB for differential testing.  Queries without an exact SQL form
register no oracle and are tested against brute force in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def register(name: str, oracle: str | None = None, headline: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        if headline:
            HEADLINE.append(name)
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from orrery.plans import (  # noqa: F401
        q_latest,
        q_series,
        q_spatial,
        q_merge,
        q_nested,
        q_rules,
        q_misc,
        q_ingest,
        q_extra,
        q_domain,
        q_stream,
    )

"""Registry of the queries that run over the test tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from voxmill.plans import (  # noqa: F401
        queries_cleaning,
        queries_lexicons,
        queries_pii,
        queries_quality,
        queries_reads,
        queries_runs,
        queries_sentiment,
        queries_store,
        queries_streams,
        queries_themes,
    )

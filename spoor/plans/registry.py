"""The queries of this package with the oracle SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def register(fn):
        if fn.__name__ in QUERIES:
            raise ValueError(f"query {fn.__name__} registered twice")
        QUERIES[fn.__name__] = Query(covers, fn, oracle)
        return fn

    return register


def load() -> dict[str, Query]:
    """All queries; importing the modules registers them."""
    from spoor.plans import (  # noqa: F401
        attribution_queries,
        classify_queries,
        integrity_queries,
        quality_queries,
        source_queries,
        streaming_queries,
        trail_queries,
        traffic_queries,
    )

    return QUERIES

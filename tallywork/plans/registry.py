"""Named queries over one directory of star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallywork.sources.star import Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str | None = None):
    """Register ``fn(star) -> DataFrame`` under ``name`` (default: the function's name)."""

    def decorate(fn: Callable[[Star], DataFrame]):
        QUERIES[name or fn.__name__] = lambda spark, path: fn(Star(spark, path))
        return fn

    return decorate

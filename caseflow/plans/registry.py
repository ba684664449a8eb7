"""The registry of queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    why_no_sql: str = ""


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None, why_no_sql: str = ""):
    """Register a query with the survey rows it covers and its independent SQL."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(name, ids, fn, sql, why_no_sql)
        return fn

    return add

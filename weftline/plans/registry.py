"""All queries by name, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "coactive_conflict_rate_by_agent_pair"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def add(f):
        key = name or f.__name__
        assert key not in QUERIES, key
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add

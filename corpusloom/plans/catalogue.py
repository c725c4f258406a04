"""Queries over the given tables, by name, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from corpusloom.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)  # whatever Python the query's tasks run, they find this package
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return run

    return add


from corpusloom.plans import answers, audit, durable, provenance, retrieval, routing, structure  # noqa: E402, F401  (they register their queries)

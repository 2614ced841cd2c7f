"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..batches import bound_batches
from ..shipping import ship

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function under a name, with its SQL when there is one."""

    def register(function):
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            bound_batches(spark)
            return function(spark, sf_dir.rstrip("/"))

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return function

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

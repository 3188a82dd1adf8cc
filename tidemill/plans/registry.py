"""Named queries of the engine and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with its SQL where there is one."""

    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tidemill.plans import library, reviews  # noqa: F401  fill the tables

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from tidemill.plans import library, reviews  # noqa: F401

    return dict(_SQL)

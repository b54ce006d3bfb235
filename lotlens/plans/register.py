"""The decorator that registers a query with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .bindings import Query, Tables, oracle

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, *roles: str, sql: str | None = None):
    """Register ``fn(tables)`` as ``name``; ``sql`` may use the roles as tables."""

    def add(fn: Callable[[Tables], DataFrame]):
        def run(spark, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = oracle(sql, *roles)
        return fn

    return add

"""The registered queries over the supplied tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _all() -> list[Callable]:
    from . import provider, records, sales, scalars, streams

    return [*sales.QUERIES, *records.QUERIES, *scalars.QUERIES, *provider.QUERIES, *streams.QUERIES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _all()}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: f.sql for f in _all() if getattr(f, "sql", None)}

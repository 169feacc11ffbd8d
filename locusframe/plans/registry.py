"""Registry of runnable queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Views, duck_sql

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over the views; ``sql`` is its DuckDB equal."""

    def add(fn: Callable[[Views], DataFrame]):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = duck_sql(sql)
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that both engines print the same value."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]
    )


def _load() -> None:
    from .catalog import all_modules

    all_modules()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, sf_dir: rounded(fn(Views(spark, sf_dir)))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

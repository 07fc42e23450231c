"""Registry of the named queries and of the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prospark.sources.entities import Entities

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers `fn(entities) -> DataFrame` under `name`, with its check SQL if there is one."""

    def add(fn: Callable[[Entities], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Entities(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add

"""Registry of named queries: a Spark plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlens.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """Register ``build``, a function of the driver tables, under ``name``."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Tables(spark, sf_dir))

    run.__name__ = name
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql.strip()


def query(name: str, sql: str | None = None):
    def wrap(build: Callable[[Tables], DataFrame]):
        add(name, build, sql)
        return build

    return wrap

"""Registration of queries and reading of their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import pinned
from ..sources.relations import source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The Parquet tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = pinned(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return source(self.spark, name, path=self.folder)


def query(sql: str | None = None):
    """Register ``f(tables)`` under its name, with the SQL that gives the same rows."""

    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep

"""Reading tables: sources, built models, and what to read when one is not there."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, name: str, columns: Mapping[str, str | Column] | None = None, path: str | None = None) -> DataFrame:
    """A catalog table, or with ``path`` the Parquet file(s) ``path/name.parquet``.

    ``columns`` maps new names to old ones or expressions; only those are read.
    """
    df = spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet") if path else spark.table(name)
    if columns is None:
        return df
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(new) for new, c in columns.items()])


def relation_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def ref(spark: SparkSession, name: str) -> DataFrame:
    """A model built before; an error names it if it was not."""
    if not relation_exists(spark, name):
        raise LookupError(f"model {name!r} has not been built")
    return spark.table(name)


def read_with_fallback(spark: SparkSession, primary: str, deferred: str) -> DataFrame:
    """Our own build of a table if there is one, else another environment's."""
    return spark.table(primary if relation_exists(spark, primary) else deferred)


def lookup_rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A few literal rows, such as a map of codes to labels; small enough to broadcast."""
    return spark.createDataFrame(list(rows), schema)

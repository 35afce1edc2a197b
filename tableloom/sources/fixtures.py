"""Fixture rows for tests of models: from dicts, from CSV text, from a query."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def fixture_rows(spark: SparkSession, rows: Iterable[Mapping[str, object]], schema: StructType) -> DataFrame:
    """Literal rows in the types of the input they stand for.

    Names match without regard to case; columns that a row leaves out are null; a name that the
    input does not have is an error; no rows give an empty relation of the same schema.
    """
    known = {f.name.lower(): f.name for f in schema}
    table = []
    for row in rows:
        unknown = [c for c in row if c.lower() not in known]
        if unknown:
            raise ValueError(f"fixture columns {unknown} are not among {schema.names}")
        mine = {known[c.lower()]: v for c, v in row.items()}
        table.append(tuple(None if mine.get(c) is None else str(mine[c]) for c in schema.names))
    text = StructType([StructField(c, StringType()) for c in schema.names])
    df = spark.createDataFrame(table, text)
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def cell(text: str) -> object:
    """The value of one CSV cell: nothing, a whole number, a number, a truth value or text."""
    if text == "":
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(text.lower(), text)


def fixture_csv(spark: SparkSession, text: str, schema: StructType) -> DataFrame:
    """Rows from CSV text with a header line, cast like :func:`fixture_rows`."""
    lines = list(csv.DictReader(io.StringIO(text.strip())))
    return fixture_rows(spark, [{k: cell(v or "") for k, v in r.items()} for r in lines], schema)


def fixture_sql(spark: SparkSession, query: str, schema: StructType | None = None) -> DataFrame:
    df = spark.sql(query)
    if schema is None:
        return df
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])

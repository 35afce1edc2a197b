"""CSV seeds: a file becomes a table, with types inferred or given."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables


def read_seed(spark: SparkSession, path: str, column_types: Mapping[str, str] | None = None, delimiter: str = ",") -> DataFrame:
    """The rows of a CSV file with a header. Types are inferred unless ``column_types`` names one.

    With all types given the file is read once; inference reads it twice.
    """
    given = dict(column_types or {})
    def raw(infer: bool = False) -> DataFrame:
        return spark.read.option("header", True).option("sep", delimiter).option("inferSchema", infer).csv(path)

    names = raw().columns
    unknown = set(given) - set(names)
    if unknown:
        raise ValueError(f"no such columns in {path}: {sorted(unknown)}")
    # a given type applies to the text of the file, so that '007' as string keeps its zeros
    kinds = given if set(given) == set(names) else {f.name: f.dataType for f in raw(True).schema} | given
    return raw().select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in names])


def load_seed(spark: SparkSession, path: str, name: str, column_types: Mapping[str, str] | None = None, delimiter: str = ",", full_refresh: bool = False) -> int:
    """Build the table ``name`` from a CSV file and return its row count.

    An existing table of the same columns is emptied and filled again; a full refresh or other
    columns rebuild it. A view of that name is never replaced.
    """
    kind = tables.relation_type(spark, name)
    if kind == "view":
        raise ValueError(f"{name} is a view; a seed does not replace it")
    rows = read_seed(spark, path, column_types, delimiter)
    if kind == "table" and not full_refresh and spark.table(name).schema.simpleString() == rows.schema.simpleString():
        tables.truncate(spark, name)
        tables.append(spark, name, rows)
    else:
        tables.build_table(spark, name, rows)
    return spark.table(name).count()

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, materialize, shared_dir

__all__ = ["UPPER", "WORD", "ascii_lower", "bounded_batches", "discard", "keep_rows", "materialize", "numbered", "row_key", "shared_dir", "ship", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Pickle a module's functions by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small enough for a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; the JVM's fast ``lower`` serves texts that are pure ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, UPPER.lower())
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: Column, digest: Column) -> Column:
    """One key for a document row: its id (null allowed) and a digest of its text."""
    return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), digest.cast("string"))


def keep_rows(docs: DataFrame, digest: Column, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is in ``kept`` (column key); of repeated rows one stays.

    One shuffle of ``docs``: the duplicate removal uses the join's partitioning and order.
    Columns travel in a struct, so no column name of ``docs`` can clash.
    """
    held = docs.select(F.struct("*").alias("row"), row_key(F.col("doc_id"), digest).alias("key"))
    return held.join(kept.select("key"), "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds copy, gapless from 0 among the rows that agree in ``keys``.

    Copies are numbered within the parts that a table was read in, and after the counted copies of
    the parts before, so no task holds all copies of a row. Where no row repeats, which is counted first, there is no more to do.
    """
    rows = materialize(rows.withColumn("part", F.spark_partition_id()), "numbered-rows")
    if rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return rows.drop("part").withColumn("copy", F.lit(0).cast("long"))
    upto = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("part").alias("_part"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    within = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*keys, "part").orderBy(F.lit(0))) - 1)
    same = F.col("part") == F.col("_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return within.join(counts, same).withColumn("copy", (F.col("copy") + F.col("before")).cast("long")).drop("part", "before", "_part", *[f"_{k}" for k in keys])

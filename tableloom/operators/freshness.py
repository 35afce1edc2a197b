"""How old the newest data of a source is, against limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


@dataclass(frozen=True)
class Limit:
    """An age; a limit without a count or a period is no limit."""

    count: int | None = None
    period: str | None = None

    def seconds(self) -> int | None:
        if self.count is None or self.period is None:
            return None
        if self.period not in SECONDS:
            raise ValueError(f"period is one of {sorted(SECONDS)}")
        return self.count * SECONDS[self.period]


def parse_time(c: Column) -> Column:
    """Text to a time without zone in UTC: with an offset or Z, naive (taken as UTC), or a bare date.

    Text in no known form is an error.
    """
    text = F.regexp_replace(F.trim(c), r"^(\d{4}-\d\d-\d\d) ", "$1T")
    text = F.regexp_replace(text, r"([+-]\d\d)$", "$1:00")
    offset = F.regexp_extract(text, r"T.*([+-]\d\d:?\d\d)$", 1)
    naive = F.try_to_timestamp(F.regexp_replace(text, r"(Z|[+-]\d\d:?\d\d)$", "")).cast("timestamp_ntz")
    dated = F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(text).cast("timestamp_ntz"))
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    minutes = F.when(offset == "", 0).otherwise(
        sign * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.right(offset, F.lit(2)).try_cast("int"))
    )
    found = F.coalesce(dated, F.timestamp_add("MINUTE", -minutes, naive))
    return F.when(c.isNull(), F.lit(None).cast("timestamp_ntz")).otherwise(F.coalesce(found, F.raise_error(F.concat(F.lit("not a time: "), c)).cast("timestamp_ntz")))


def collect_freshness(df: DataFrame, loaded_at: str, now: str, condition: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """max_loaded_at, snapshotted_at: one row, or one for each value of ``by``."""
    df = df.where(condition) if condition else df
    column = parse_time(F.col(loaded_at)) if dict(df.dtypes)[loaded_at] == "string" else F.col(loaded_at).cast("timestamp_ntz")
    return df.groupBy(*by).agg(F.max(column).alias("max_loaded_at")).withColumn("snapshotted_at", F.lit(now).cast("timestamp_ntz"))


def collect_freshness_query(spark: SparkSession, query: str, now: str) -> DataFrame:
    """The same from a query of one value."""
    df = spark.sql(query)
    return collect_freshness(df.toDF("loaded_at"), "loaded_at", now)


def evaluate_freshness(collected: DataFrame, warn_after: Limit = Limit(), error_after: Limit = Limit(), strict: bool = False) -> DataFrame:
    """Adds age_seconds and status: error, warn, pass, or error_empty for a source without rows.

    Ages strictly beyond a limit count, and an error outranks a warning. At least one limit must be
    complete. With ``strict`` a source without rows raises when the query runs.
    """
    if warn_after.seconds() is None and error_after.seconds() is None:
        raise ValueError("freshness needs a complete limit")
    age = F.unix_micros(F.col("snapshotted_at").cast("timestamp")) - F.unix_micros(F.col("max_loaded_at").cast("timestamp"))
    out = collected.withColumn("age_seconds", age / 1_000_000)
    empty = F.raise_error(F.lit("the source has no rows")).cast("string") if strict else F.lit("error_empty")
    status = F.when(F.col("max_loaded_at").isNull(), empty)
    for limit, word in ((error_after, "error"), (warn_after, "warn")):
        if limit.seconds() is not None:
            status = status.when(F.col("age_seconds") > limit.seconds(), word)
    return out.withColumn("status", status.otherwise("pass"))


def write_freshness_report(spark: SparkSession, name: str, rows: DataFrame) -> None:
    if tables.relation_type(spark, name):
        tables.append(spark, name, rows)
    else:
        tables.build_table(spark, name, rows)

"""Portable date and time functions. Times are without zone."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scalar import ColumnOrName, _c

PARTS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond", "microsecond")
MICROS = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1000, "microsecond": 1}


def _part(part: str) -> str:
    if part not in PARTS:
        raise ValueError(f"unknown part {part!r}; one of {PARTS}")
    return part


def micros(t: ColumnOrName) -> Column:
    """Microseconds since 1970 of a time without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(t).cast("timestamp_ntz"))


def make_date(y: int, m: int, d: int) -> Column:
    return F.make_date(F.lit(y), F.lit(m), F.lit(d))


def dateadd(part: str, n: ColumnOrName | int, t: ColumnOrName) -> Column:
    """t moved on by n parts; month ends stay within their month."""
    n = F.lit(n) if isinstance(n, int) else _c(n)
    return F.timestamp_add(_part(part).upper(), n.cast("int"), _c(t).cast("timestamp_ntz"))


def datediff(a: ColumnOrName, b: ColumnOrName, part: str) -> Column:
    """How many boundaries of ``part`` lie between a and b (long), negative if b is before a.

    Not whole units that have passed: from 00:59 to 01:01 is one hour. Weeks begin on Sunday; backwards
    by an exact number of weeks counts one week more, as the portable definition has it.
    """
    a, b = _c(a).cast("timestamp_ntz"), _c(b).cast("timestamp_ntz")
    _part(part)
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    if part == "year":
        out = F.year(b) - F.year(a)
    elif part == "quarter":
        out = (F.year(b) - F.year(a)) * 4 + F.quarter(b) - F.quarter(a)
    elif part == "month":
        out = months
    elif part == "week":
        days = F.datediff(b.cast("date"), a.cast("date"))
        wa, wb = F.dayofweek(a), F.dayofweek(b)
        weeks = F.when(days >= 0, F.floor(days / 7)).otherwise(F.ceil(days / 7))
        out = weeks + F.when((a <= b) & (wa > wb), 1).when((a > b) & (wa <= wb), -1).otherwise(0)
    else:
        unit = MICROS[part]
        # times cut to their unit; their distance is a whole number of units
        cut = lambda t: micros(t) - F.pmod(micros(t), F.lit(unit))
        out = (cut(b) - cut(a)) / unit
    return out.cast("long")


def date_trunc(part: str, t: ColumnOrName) -> Column:
    return F.date_trunc(_part(part), _c(t).cast("timestamp_ntz")).cast("timestamp_ntz")


def last_day(t: ColumnOrName, part: str = "month") -> Column:
    """The last date of the year, quarter, month or week that holds t."""
    step = {"year": 12, "quarter": 3, "month": 1}
    start = F.date_trunc(_part(part), _c(t).cast("timestamp_ntz")).cast("date")
    if part in step:
        return F.date_sub(F.add_months(start, step[part]), 1)
    if part == "week":
        return F.date_add(start, 6)
    raise ValueError(f"no last day of a {part}")


def now(fixed: str | None = None) -> Column:
    """The run's time: the session's, or a fixed one that makes the run repeatable."""
    return F.current_timestamp().cast("timestamp_ntz") if fixed is None else F.lit(fixed).cast("timestamp_ntz")


def weekday_name(t: ColumnOrName) -> Column:
    return F.date_format(_c(t), "EEEE")


def to_date(t: ColumnOrName) -> Column:
    return F.to_date(_c(t))


def convert_datetime(text: ColumnOrName, fmt: str) -> Column:
    """Text to a time; text in another form is an error."""
    return F.to_timestamp_ntz(_c(text), F.lit(fmt))


def _literal(spark: SparkSession, column: Column):
    return spark.range(1).select(column.alias("v")).first()[0]


def intervals_between(spark: SparkSession, a: str | datetime, b: str | datetime, part: str) -> int:
    return _literal(spark, datediff(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"), part))


def generate_series(spark: SparkSession, n: int) -> DataFrame:
    """generated_number from 1 to n."""
    if n <= 0:
        raise ValueError(f"a series needs a positive length, not {n}")
    return spark.range(1, n + 1).select(F.col("id").alias("generated_number"))


def date_spine(spark: SparkSession, part: str, start: str | datetime | date, end: str | datetime | date) -> DataFrame:
    """date_<part>: one row for each period from start, as many as there are boundaries to end.

    So the end itself is left out when start lies on a boundary. No boundaries are an error.
    """
    n = intervals_between(spark, start, end, part)
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    at = dateadd(part, F.col("generated_number") - 1, first)
    return generate_series(spark, n).select(at.alias(f"date_{part}")).where(F.col(f"date_{part}") <= last)


def dates_in_range(spark: SparkSession, start: str, end: str, in_format: str = "yyyyMMdd", out_format: str = "yyyyMMdd") -> DataFrame:
    """day: every date from start to end, both included, as text; a reversed range is an error."""
    a, b = (datetime.strptime(x, _python_format(in_format)).date() for x in (start, end))
    if a > b:
        raise ValueError(f"{start} is after {end}")
    days = F.explode(F.sequence(F.lit(a), F.lit(b)))
    return spark.range(1).select(days.alias("d")).select(F.date_format("d", out_format).alias("day"))


def _python_format(fmt: str) -> str:
    for old, new in (("yyyy", "%Y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S")):
        fmt = fmt.replace(old, new)
    return fmt

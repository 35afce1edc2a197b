"""Comparing datasets without regard to order, and testing models on fixture rows."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL = "actual_or_expected"


def expected_columns(actual: DataFrame, expected: DataFrame | None, first_row: Mapping | None = None) -> list[str]:
    """What is compared: the columns of the first expected row, else all the query's."""
    if first_row:
        return list(first_row)
    return expected.columns if expected is not None and expected.columns else actual.columns


def label_union(actual: DataFrame, expected: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Both sides' rows, cut to the compared columns in the actual types, with a label."""
    columns = list(columns or expected.columns)
    typed = [F.col(c).cast(actual.schema[c].dataType).alias(c) for c in columns]
    return actual.select(*columns, F.lit("actual").alias(LABEL)).unionByName(expected.select(*typed, F.lit("expected").alias(LABEL)))


def multiset_diff(actual: DataFrame, expected: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows whose numbers differ, with surplus = times in actual - times in expected.

    One aggregate by all columns: nulls group together, repeated rows count, nothing is collected.
    """
    columns = list(columns or expected.columns)
    return _surplus(label_union(actual, expected, columns), columns)


def _surplus(both: DataFrame, columns: Sequence[str]) -> DataFrame:
    sign = F.when(F.col(LABEL) == "actual", 1).otherwise(-1).cast("long")
    return both.groupBy(*columns).agg(F.sum(sign).alias("surplus")).where("surplus <> 0")


def comparison(diff: DataFrame) -> DataFrame:
    """failures, passed: one row about a :func:`multiset_diff`."""
    total = F.coalesce(F.sum(F.abs("surplus")), F.lit(0)).cast("long")
    return diff.agg(total.alias("failures")).select("failures", (F.col("failures") == 0).alias("passed"))


def bucketed_diff(actual: DataFrame, expected: DataFrame, columns: Sequence[str] | None = None, buckets: int = 4096) -> DataFrame:
    """The rows of :func:`multiset_diff`, by way of checksums: tables that agree move none of their rows.

    Both sides are dealt into buckets by a hash of the row, and the halves of two 64-bit hashes are summed for each, plus for
    actual, minus for expected, which does not regard order and is done before the shuffle. Sums that are not
    zero name the buckets that differ (``buckets`` numbers at most); only their rows are compared. Rows that differ
    and leave all four sums at zero would need 128 bits of hash to agree by chance.
    """
    columns = list(columns or expected.columns)
    both = label_union(actual, expected, columns)
    # a hash passes nulls over, so whether a column is null is hashed as well
    seen = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    first, second = F.xxhash64(*seen), F.xxhash64(F.lit(1), *seen)
    bucket = F.pmod(first, F.lit(buckets))
    sign = F.when(F.col(LABEL) == "actual", 1).otherwise(-1).cast("long")
    halves = [half for h in (first, second) for half in (F.shiftright(h, 32), h.bitwiseAND(0xFFFFFFFF))]
    sums = [F.sum(sign * half).alias(f"s{k}") for k, half in enumerate([F.lit(1), *halves])]
    differs = reduce(Column.__or__, [F.col(f"s{k}") != 0 for k in range(5)])
    found = [r[0] for r in both.groupBy(bucket.alias("bucket")).agg(*sums).where(differs).select("bucket").collect()]
    some = both.where(bucket.isin(found)) if found else both.limit(0)
    return _surplus(some if len(found) < buckets else both, columns)


def diff_report(diff: DataFrame, limit: int = 20) -> list[str]:
    """The compared columns, then up to ``limit`` rows in order, with the side that has them too often and how many times;
    a last line says if there are more. Nothing for sides that agree."""
    columns = [c for c in diff.columns if c != "surplus"]
    text = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])
    times = F.concat(F.lit(" (x"), F.abs("surplus").cast("string"), F.lit("): "), text)
    line = F.when(F.col("surplus") > 0, F.concat(F.lit("+ actual  "), times)).otherwise(F.concat(F.lit("- expected"), times))
    lines = [r[0] for r in diff.select(text.alias("text"), line.alias("line")).orderBy("text", "line").limit(limit + 1).select("line").collect()]
    if not lines:
        return []
    return ["columns: " + ", ".join(columns), *lines[:limit], *["... (more rows differ)"] * (len(lines) > limit)]


def run_model_test(model: Callable[..., DataFrame], given: Mapping[str, DataFrame], expected: DataFrame, **options) -> tuple[bool, list[str]]:
    """Run a model on fixtures for its inputs: (passed, lines of difference).

    An input that the model does not take is an error. ``options`` are plain arguments of the model.
    """
    takes = inspect.signature(model).parameters
    unknown = [n for n in [*given, *options] if n not in takes]
    if unknown:
        raise ValueError(f"the model does not read {unknown}")
    diff = multiset_diff(model(**given, **options), expected)
    report = diff_report(diff)
    return not report, report

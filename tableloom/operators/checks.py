"""Data-quality checks. A check is a DataFrame of failing rows; a verdict is one row about them.

Checks over groups (unique, accepted_values) count bad values, the others count rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

VERDICT = "failures long, should_warn boolean, should_error boolean"


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


#: Hashes that a task packs at once, and as many as a group of them gets; repeated hashes that are broadcast at most.
PACKED, FEW_REPEATS = 2_000_000, 500_000


def hash_repeats(rows: DataFrame) -> DataFrame:
    """h: the 64-bit hashes that more than one row of ``rows`` has.

    A task sorts its hashes and sends the differences, split by the leading bits and compressed, in about six bytes a row
    however wide a row is; what repeats within a task is sent once. Groups of leading bits are as many as the count of
    the rows asks for, so each fits its task.
    """
    import zlib

    import pyarrow as pa

    h = F.xxhash64(*[x for c in rows.columns for x in (F.col(c), F.col(c).isNull())])
    bits = max(0, (rows.count() // PACKED).bit_length())
    at_once = PACKED

    def deltas(sorted_):
        import numpy as np

        return zlib.compress(np.diff(sorted_, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)

    def pack(batches):
        import numpy as np

        def packed(held):
            hashes, n = np.unique(np.concatenate(held), return_counts=True)
            group = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
            cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
            parts = [(int(group[i]), deltas(hashes[i:j]), deltas(hashes[i:j][n[i:j] > 1])) for i, j in zip(cuts[:-1], cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*parts), (pa.int64(), pa.binary(), pa.binary()))], ["g", "once", "twice"])

        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(held[-1])
            if size >= at_once:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    def repeats(table):
        import numpy as np

        whole = lambda data: np.cumsum(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel())
        every, n = np.unique(np.concatenate([whole(x) for x in table["once"].to_pylist()]), return_counts=True)
        found = np.unique(np.concatenate([every[n > 1], *[whole(x) for x in table["twice"].to_pylist()]]))
        return pa.table({"h": pa.array(found.view(np.int64))})

    return rows.select(h.alias("h")).mapInArrow(pack, "g long, once binary, twice binary").groupBy("g").applyInArrow(repeats, "h long")


def repeated_rows(rows: DataFrame) -> DataFrame:
    """The rows of ``rows`` that are there more than once, found by their hashes: rows that are there once stay where they are.

    A row whose hash is another's by chance may come along, so who counts must count these. Where more hashes repeat than are
    broadcast, it is all rows.
    """
    found = materialize(hash_repeats(rows), "repeated-hashes")
    if found.limit(FEW_REPEATS + 1).count() > FEW_REPEATS:
        return rows
    h = F.xxhash64(*[x for c in rows.columns for x in (F.col(c), F.col(c).isNull())])
    return rows.withColumn("__h", h).join(F.broadcast(found.withColumnRenamed("h", "__h")), "__h", "left_semi").drop("__h")


def unique(df: DataFrame, column: str, by_hash: bool = False) -> DataFrame:
    """unique_field, n_records: values, null aside, that more than one row has.

    ``by_hash`` is for large tables of wide keys: a first pass finds what repeats by hashes, and only that is shuffled.
    """
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("unique_field"))
    counts = (repeated_rows(rows) if by_hash else rows).groupBy("unique_field")
    return counts.agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 1")


def accepted_values(df: DataFrame, column: str, values: Sequence, quote: bool = True) -> DataFrame:
    """value_field, n_records: values outside the list. Null is neither in nor out, and passes.

    With ``quote=False`` the values are SQL expressions.
    """
    counts = df.groupBy(F.col(column).alias("value_field")).agg(F.count(F.lit(1)).alias("n_records"))
    listed = [F.lit(v) if quote else F.expr(str(v)) for v in values]
    return counts.where(~F.col("value_field").isin(*listed))


def relationships(child: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """from_field: child values, null aside, that no parent has, once for each row."""
    have = parent.select(F.col(field).alias("__to")).where("__to is not null")
    return child.where(F.col(column).isNotNull()).select(F.col(column).alias("from_field")).join(have, F.col("from_field") == F.col("__to"), "left_anti")


def _columns(df: DataFrame, columns: Sequence[str], skip: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in set(skip)] if columns else []


def aggregated_unique(df: DataFrame, columns: Sequence[str], skip: Sequence[str] = (), by_hash: bool = False) -> DataFrame:
    """column_name, unique_field, n_records: :func:`unique` for many columns in one scan and one shuffle."""
    names = _columns(df, columns, skip)
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, unique_field string, n_records long")
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("unique_field")) for c in names])
    rows = df.select(F.explode(cells).alias("c")).select("c.*").where("unique_field is not null")
    counts = (repeated_rows(rows) if by_hash else rows).groupBy("column_name", "unique_field")
    return counts.agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 1").orderBy("column_name", "unique_field")


def aggregated_not_null(df: DataFrame, columns: Sequence[str], skip: Sequence[str] = ()) -> DataFrame:
    """column_name, once for each null cell, in one scan."""
    names = _columns(df, columns, skip)
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string")
    cells = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in names]))
    return df.select(F.explode(cells).alias("column_name"))


def aggregated_verdict(failing: DataFrame, warn_if: str = "!= 0", error_if: str = "!= 0") -> DataFrame:
    """column_name, failures, should_warn, should_error for the failing rows of an aggregated check."""
    counts = failing.groupBy("column_name").agg(F.count(F.lit(1)).alias("failures"))
    return counts.select("*", F.expr(f"failures {warn_if}").alias("should_warn"), F.expr(f"failures {error_if}").alias("should_error"))


def greater_than(df: DataFrame, column: str, threshold) -> DataFrame:
    return df.where(F.col(column) <= threshold)


def is_positive(df: DataFrame, column: str) -> DataFrame:
    """Rows below zero; zero passes."""
    return df.where(F.col(column) < 0)


def not_empty(df: DataFrame) -> DataFrame:
    """One row, n_records = 0, if there are no rows."""
    return df.agg(F.count(F.lit(1)).alias("n_records")).where("n_records = 0")


def singular(failing: DataFrame) -> DataFrame:
    """Any query whose rows are failures."""
    return failing


def verdict(failing: DataFrame, fail_calc: str = "count(*)", warn_if: str = "!= 0", error_if: str = "!= 0", limit: int | None = None) -> DataFrame:
    """failures, should_warn, should_error: one row. ``limit`` caps the rows before they are counted."""
    capped = failing.limit(limit) if limit is not None else failing
    return capped.agg(F.expr(fail_calc).cast("long").alias("failures")).select(
        "failures", F.expr(f"failures {warn_if}").alias("should_warn"), F.expr(f"failures {error_if}").alias("should_error")
    )


def with_status(verdicts: DataFrame, severity: str | Column = "error") -> DataFrame:
    """Adds status: error, warn or pass. A null count is no failure; severity 'warn' never errors."""
    if isinstance(severity, str):
        if severity not in ("warn", "error"):
            raise ValueError("severity is 'warn' or 'error'")
        severity = F.lit(severity)
    error, warns = F.coalesce("should_error", F.lit(False)), F.coalesce("should_warn", F.lit(False))
    bad = error & (severity == "error")
    warn = warns | (error & (severity == "warn"))
    return verdicts.withColumn("status", F.when(bad, "error").when(warn, "warn").otherwise("pass"))


@dataclass(frozen=True)
class Check:
    """A named check for :func:`run_checks`: by its failing rows, or by ``rows`` and the condition ``bad``
    on a single row. Those that share their ``rows`` are counted together."""

    name: str
    table: str
    failing: DataFrame | None = None
    column: str | None = None
    severity: str = "error"
    fail_calc: str = "count(*)"
    warn_if: str = "!= 0"
    error_if: str = "!= 0"
    limit: int | None = None
    rows: DataFrame | None = None
    bad: str | None = None

    def __post_init__(self):
        if (self.failing is None) == (self.rows is None) or (self.rows is None) != (self.bad is None):
            raise ValueError("a check has failing rows, or rows and a condition")


def _judged(c: Check, verdicts: DataFrame) -> DataFrame:
    return with_status(verdicts, c.severity).select(
        F.lit(c.name).alias("check"), F.lit(c.table).alias("table"), F.lit(c.column).cast("string").alias("column"), "failures", "status"
    )


def _counted_together(rows: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """The verdicts of row checks on one table: one scan, one aggregate with a count for each check."""
    counts = rows.agg(*[F.count_if(F.expr(c.bad)).alias(f"n{k}") for k, c in enumerate(checks)])
    cells = []
    for k, c in enumerate(checks):
        n = F.col(f"n{k}") if c.limit is None else F.least(F.col(f"n{k}"), F.lit(c.limit).cast("long"))
        cells.append(F.struct(
            F.lit(c.name).alias("check"), F.lit(c.table).alias("table"), F.lit(c.column).cast("string").alias("column"), F.lit(c.severity).alias("severity"),
            n.alias("failures"), F.lit(c.warn_if).alias("warn_if"), F.lit(c.error_if).alias("error_if"),
        ))
    stacked = counts.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    for side in ("warn", "error"):
        told = F.lit(False)
        for text in dict.fromkeys(getattr(c, f"{side}_if") for c in checks):
            told = F.when(F.col(f"{side}_if") == text, F.expr(f"failures {text}")).otherwise(told)
        stacked = stacked.withColumn(f"should_{side}", told)
    return with_status(stacked, F.col("severity")).select("check", "table", "column", "failures", "status")


def run_checks(checks: Iterable[Check]) -> DataFrame:
    """check, table, column, failures, status: a row for each check, evaluated in one query.

    Row checks on one table that count rows share one scan of it.
    """
    checks = list(checks)
    if not checks:
        raise ValueError("no checks")
    parts, together = [], {}
    for c in checks:
        if c.rows is not None and c.fail_calc == "count(*)":
            together.setdefault(id(c.rows), []).append(c)
        else:
            failing = c.failing if c.rows is None else c.rows.where(c.bad)
            parts.append(_judged(c, verdict(failing, c.fail_calc, c.warn_if, c.error_if, c.limit)))
    parts += [_counted_together(own[0].rows, own) for own in together.values()]
    return reduce(DataFrame.unionByName, parts)


def where(df: DataFrame, condition: str | None) -> DataFrame:
    """The part of a table that a check looks at."""
    return df if condition is None else df.where(condition)

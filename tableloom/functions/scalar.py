"""Portable text, cast and small numeric functions: Column in, Column out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def concat(*fields: ColumnOrName) -> Column:
    """Joined texts; null if any is null."""
    return F.concat(*[_c(f).cast("string") for f in fields])


def length(s: ColumnOrName) -> Column:
    return F.char_length(_c(s))


def replace(s: ColumnOrName, old: str, new: str) -> Column:
    return F.replace(_c(s), F.lit(old), F.lit(new))


def right(s: ColumnOrName, n: int) -> Column:
    return F.right(_c(s), F.lit(n))


def position(sub: str, s: ColumnOrName) -> Column:
    """Where ``sub`` begins, from 1; 0 if it is not there."""
    return F.position(F.lit(sub), _c(s))


def split_part(s: ColumnOrName, delimiter: str, n: int) -> Column:
    """The n-th part, from the end if n is negative; '' beyond the last."""
    if n == 0:
        raise ValueError("parts count from 1 or from -1")
    return F.split_part(_c(s), F.lit(delimiter), F.lit(n))


def hash_text(x: ColumnOrName) -> Column:
    """md5 of the text form."""
    return F.md5(_c(x).cast("string"))


def cast(x: ColumnOrName, kind: str) -> Column:
    return _c(x).cast(kind)


def safe_cast(x: ColumnOrName, kind: str, strict: bool = True) -> Column:
    """A cast; with ``strict=False`` null where the value does not convert."""
    return _c(x).cast(kind) if strict else _c(x).try_cast(kind)


def cast_bool_to_text(x: ColumnOrName) -> Column:
    return _c(x).cast("boolean").cast("string")


def equals(a: ColumnOrName, b: ColumnOrName, null_safe: bool = False) -> Column:
    return _c(a).eqNullSafe(_c(b)) if null_safe else _c(a) == _c(b)


def safe_round(x: ColumnOrName, places: int = 2) -> Column:
    return F.round(_c(x), places)


def safe_ratio(a: ColumnOrName, b: ColumnOrName, places: int = 4) -> Column:
    """a / b rounded; 0 where b is not above 0 or is null."""
    return F.when(_c(b) > 0, F.round(_c(a) / _c(b), places)).otherwise(0.0)


def format_id(x: ColumnOrName, width: int | None = 5) -> Column:
    """A number as text, zero-padded to ``width`` or plain."""
    return _c(x).cast("string") if width is None else F.format_string(f"%0{width}d", _c(x))


def audit_columns(df: DataFrame, run_id: str, started_at: str) -> DataFrame:
    return df.withColumns({"run_id": F.lit(run_id), "run_started_at": F.lit(started_at).cast("timestamp_ntz")})


def bucketize(x: ColumnOrName, buckets: Sequence[tuple[float | None, float | None, str]], other: str | None = None) -> Column:
    """The label of the half-open span [low, high) that holds x; None is no bound."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, high, label in buckets:
        inside = F.lit(True)
        if low is not None:
            inside &= _c(x) >= low
        if high is not None:
            inside &= _c(x) < high
        out = out.when(_c(x).isNotNull() & inside, label)
    return out.otherwise(F.lit(other).cast("string"))

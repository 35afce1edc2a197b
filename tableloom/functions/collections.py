"""Array functions and the aggregates that go beyond sum and count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalar import ColumnOrName, _c


def array_construct(values: Sequence = (), kind: str = "int") -> Column:
    """An array of values of one type; an empty one still has its type."""
    return F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]).cast(f"array<{kind}>")


def array_append(a: ColumnOrName, x: ColumnOrName) -> Column:
    return F.array_append(_c(a), _c(x))


def array_concat(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.concat(_c(a), _c(b))


def any_value(x: ColumnOrName, stable: bool = True) -> Column:
    """Some value of a group; the smallest one unless ``stable`` is off."""
    return F.min(_c(x)) if stable else F.any_value(_c(x))


def bool_or(x: ColumnOrName) -> Column:
    return F.bool_or(_c(x))


def listagg(x: ColumnOrName, separator: str = ",", order_by: ColumnOrName | None = None, limit: int | None = None) -> Column:
    """The group's texts joined, in order; with ``limit`` only the first ones. Nulls are left out.

    It holds a whole group; where only the first few of large groups are wanted, :func:`listagg_first` does not.
    """
    key = _c(order_by if order_by is not None else x)
    pairs = F.array_sort(F.collect_list(F.when(_c(x).isNotNull(), F.struct(key.alias("k"), _c(x).cast("string").alias("v")))))
    texts = F.transform(pairs, lambda p: p["v"])
    joined = F.array_join(texts if limit is None else F.slice(texts, 1, limit), separator)
    return F.when(F.count(_c(x)) > 0, joined)


def listagg_first(df: DataFrame, keys: Sequence[str], x: str, limit: int, separator: str = ",", order_by: str | None = None, name: str = "listed") -> DataFrame:
    """keys and ``name``: :func:`listagg` with a limit, of which every task sends on ``limit`` rows a group
    at most, so no group is ever held. Groups without a value have null."""
    order = Window.partitionBy(*keys).orderBy(F.col(x).isNull(), *[F.col(c) for c in dict.fromkeys([order_by or x, x])])
    first = df.select(*dict.fromkeys([*keys, x, order_by or x])).withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= limit)
    return first.groupBy(*keys).agg(listagg(x, separator, F.col("__nth")).alias(name))


def count_each(x: ColumnOrName, values: Sequence, prefix: str = "") -> list[Column]:
    """One conditional count for each value: a pivot whose columns are known before."""
    return [F.count_if(_c(x) == v).alias(f"{prefix}{v}") for v in values]

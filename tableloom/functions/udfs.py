"""Functions that users define: SQL scalar functions, aggregates over pandas groups, Python models."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

VOLATILITY = {"deterministic": "DETERMINISTIC", "non-deterministic": "NOT DETERMINISTIC", "stable": ""}


def create_scalar_function(spark: SparkSession, name: str, args: Sequence[tuple], returns: str, body: str, volatility: str | None = None, temporary: bool = True) -> None:
    """A typed SQL function, inlined into the plans that call it.

    ``args`` are (name, type) or (name, type, default as SQL). Spark has no 'stable' functions; that
    and unknown words are warned of and left out.
    """
    listed = ", ".join(f"{a[0]} {a[1]}" + (f" DEFAULT {a[2]}" if len(a) > 2 else "") for a in args)
    word = ""
    if volatility is not None:
        word = VOLATILITY.get(volatility, "")
        if not word:
            warnings.warn(f"volatility {volatility!r} has no counterpart and is left out", stacklevel=2)
    kind = "TEMPORARY FUNCTION" if temporary else "FUNCTION"
    spark.sql(f"CREATE OR REPLACE {kind} {name}({listed}) RETURNS {returns} {word} RETURN {body}")


def create_aggregate_function(spark: SparkSession, name: str, function: Callable, returns: str) -> None:
    """An aggregate that sees a group's values as a pandas Series, by name in SQL.

    A group must fit in one task; built-in aggregates and :func:`aggregate_by` have no such bound and come first.
    """
    import pandas as pd

    def run(v):
        return function(v)

    run.__annotations__ = {"v": pd.Series, "return": float}
    spark.udf.register(name, F.pandas_udf(run, returns))


#: Groups whose states a task holds before it hands them on.
MAX_GROUPS = 50_000


@dataclass(frozen=True)
class Mergeable:
    """An aggregate in four parts, so that a group is never in one place.

    ``update(state or None, values)`` takes a pandas Series of a group's values, nulls included, ``merge`` two states, and ``finish`` gives
    the result. A state is a tuple of the columns that ``state`` names with their types; ``returns`` is the type of the result.
    """

    state: str
    returns: str
    update: Callable
    merge: Callable
    finish: Callable


def aggregate_by(df: DataFrame, keys: str | Sequence[str], value: str, rule: Mergeable, name: str = "value") -> DataFrame:
    """``keys`` and the aggregate of column ``value`` under ``name``; null is a key like any other.

    Tasks update states as they read and shuffle those: a group that holds a third of all rows sends one small row
    from each task. After the shuffle states of a key stand together and are merged as they stream by.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    key_fields = [T.StructField(f"k{n}", df.schema[k].dataType) for n, k in enumerate(keys)]
    state = T.StructType.fromDDL(rule.state)
    partial = T.StructType([*key_fields, *[T.StructField(f"s{n}", f.dataType) for n, f in enumerate(state)]])
    result = T.StructType([*key_fields, T.StructType.fromDDL(f"result {rule.returns}")[0]])
    n_keys, update, merge, finish, most = len(keys), rule.update, rule.merge, rule.finish, MAX_GROUPS
    partial_arrow, result_arrow = to_arrow_schema(partial), to_arrow_schema(result)

    def table(rows, schema):
        import pyarrow as pa

        columns = zip(*rows) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def updated(batches):
        import pyarrow as pa

        held: dict[tuple, tuple] = {}
        for batch in batches:
            groups = pa.Table.from_batches([batch]).group_by([f"k{n}" for n in range(n_keys)], use_threads=False).aggregate([("v", "list")])
            names = list(zip(*[groups[f"k{n}"].to_pylist() for n in range(n_keys)]))
            for key, values in zip(names, groups["v_list"].combine_chunks()):
                held[key] = update(held.get(key), values.values.to_pandas())
            if len(held) >= most:
                yield table([k + tuple(s) for k, s in held.items()], partial_arrow)
                held = {}
        yield table([k + tuple(s) for k, s in held.items()], partial_arrow)

    def merged(batches):
        key = so_far = None
        for batch in batches:
            done = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:n_keys] == key:
                    so_far = merge(so_far, row[n_keys:])
                    continue
                if key is not None:
                    done.append((*key, finish(so_far)))
                key, so_far = row[:n_keys], row[n_keys:]
            yield table(done, result_arrow)
        if key is not None:
            yield table([(*key, finish(so_far))], result_arrow)

    named = [f"k{n}" for n in range(n_keys)]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, named)], F.col(value).alias("v"))
    states = rows.mapInArrow(updated, partial).repartition(*named).sortWithinPartitions(*named)
    return states.mapInArrow(merged, result).select(*[F.col(n).alias(k) for k, n in zip(keys, named)], F.col("result").alias(name))


@dataclass(frozen=True)
class ModelContext:
    """What a Python model sees: its inputs, its settings, its own table and how it is run."""

    spark: SparkSession
    refs: Mapping[str, DataFrame]
    sources: Mapping[str, DataFrame] = field(default_factory=dict)
    config: Mapping[str, object] = field(default_factory=dict)
    this: str | None = None
    is_incremental: bool = False

    def ref(self, name: str) -> DataFrame:
        return self.refs[name]

    def source(self, name: str) -> DataFrame:
        return self.sources[name]


def run_model(model: Callable[[ModelContext], DataFrame], context: ModelContext) -> DataFrame:
    out = model(context)
    if not isinstance(out, DataFrame):
        raise TypeError(f"a model returns a DataFrame, not {type(out).__name__}")
    return out

"""Incremental builds: how a batch of new rows changes a table.

Each strategy is a function of (target, batch) that returns the new contents, so it can be tested and
composed; :func:`build_incremental` applies one to a stored table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import session
from . import tables
from .metadata import schema_changes, wider_type


#: A batch of at most so many rows, which are counted, is broadcast to its target.
FEW_ROWS = 100_000
#: Partitions that are named one by one; a load that touches more rewrites its table.
MAX_PARTITIONS = 2_000


class SchemaMismatch(ValueError):
    pass


class DuplicateKeys(ValueError):
    pass


def _listed(key: str | Sequence[str] | None) -> list[str]:
    return [] if key is None else [key] if isinstance(key, str) else list(key)


def append_rows(target: DataFrame, batch: DataFrame) -> DataFrame:
    return target.unionByName(batch.select(*target.columns))


def delete_insert(target: DataFrame, batch: DataFrame, key: str | Sequence[str], predicate: str | None = None) -> DataFrame:
    """Drop target rows whose key is in the batch, then add the whole batch, repeats included.

    A key with a null matches nothing. ``predicate`` (over target columns) limits the deletion only.
    """
    keys = _listed(key)
    gone = batch.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    match = _matches(keys, "{}", "__{}")
    if predicate:
        match &= F.expr(predicate)
    return target.join(gone, match, "left_anti").unionByName(batch.select(*target.columns))


def repeated_keys(batch: DataFrame, key: str | Sequence[str], null_safe: bool = False) -> DataFrame:
    """The keys that more than one row of a batch has. Those with nulls count only if null matches null."""
    keys = _listed(key)
    rows = batch if null_safe and len(keys) == 1 else batch.dropna(subset=keys)
    return rows.groupBy(*keys).count().where("count > 1").drop("count")


def _matches(keys: Sequence[str], left: str, right: str, null_safe: bool = False) -> Column:
    """Equality of the keys of two sides; null equals null for a single key at most."""
    pairs = [(F.col(left.format(k)), F.col(right.format(k))) for k in keys]
    return reduce(Column.__and__, [a.eqNullSafe(b) if null_safe and len(keys) == 1 else a == b for a, b in pairs])


def update_columns(columns: Sequence[str], update: Sequence[str] | None, exclude: Sequence[str] | None) -> list[str]:
    """Which columns a merge updates; exclusion does not regard case."""
    if update and exclude:
        raise ValueError("give the columns to update or the columns to exclude, not both")
    if update:
        return list(update)
    dropped = {c.lower() for c in exclude or ()}
    return [c for c in columns if c.lower() not in dropped]


def merge_rows(
    target: DataFrame, batch: DataFrame, key: str | Sequence[str] | None, update: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None, predicate: str | None = None, null_safe: bool = False, check: bool = True,
) -> DataFrame:
    """Update the target rows that the batch matches, insert the batch rows that match none.

    ``predicate`` speaks of the rows as ``target.column`` and ``batch.column`` and is part of the match.
    ``null_safe`` lets null equal null for a single key; keys of several columns always use plain
    equality. Without a key everything is inserted. A key that repeats within the batch is an
    error, found before (``check``), since the result would depend on chance.

    A batch that is counted to be small is broadcast: the target is read twice, the second time its keys
    only, and never shuffled. Beyond that, or without the count (``check`` off), it is one full outer join.
    """
    keys = _listed(key)
    if not keys:
        return append_rows(target, batch)
    if check and not repeated_keys(batch, keys, null_safe).isEmpty():
        raise DuplicateKeys(f"keys {keys} repeat within the batch")
    old = target.select(F.struct("*").alias("target"))
    new = batch.select(F.struct("*").alias("batch"))
    match = _matches(keys, "target.{}", "batch.{}", null_safe)
    if predicate:
        match &= F.expr(predicate)
    updated = set(update_columns(batch.columns, update, exclude))
    known = set(batch.columns)

    def cell(c: str) -> Column:
        was = F.col(f"target.{c}")
        comes = F.col(f"batch.{c}") if c in known else F.lit(None)
        both = comes if c in updated and c in known else was
        return F.when(F.col("batch").isNull(), was).when(F.col("target").isNull(), comes).otherwise(both).alias(c)

    if check and batch.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        few = F.broadcast(new)
        met = old.join(few, match).select(*[F.col(f"batch.{k}").alias(f"__{k}") for k in keys]).distinct()
        same = reduce(Column.__and__, [F.col(f"batch.{k}").eqNullSafe(F.col(f"__{k}")) for k in keys])
        added = new.join(F.broadcast(met), same, "left_anti").select(F.lit(None).cast(old.schema["target"].dataType).alias("target"), "batch")
        return old.join(few, match, "left").unionByName(added).select(*map(cell, target.columns))
    return old.join(new, match, "full_outer").select(*map(cell, target.columns))


def insert_overwrite(target: DataFrame, batch: DataFrame, predicate: str | None = None) -> DataFrame:
    """Replace all rows, or those that meet ``predicate``, by the batch."""
    batch = batch.select(*target.columns)
    if predicate is None:
        return batch
    return target.where(~F.coalesce(F.expr(predicate), F.lit(False))).unionByName(batch)


def microbatch(target: DataFrame, batch: DataFrame, key: str | Sequence[str] | None, **options) -> DataFrame:
    if not _listed(key):
        raise ValueError("a microbatch needs a unique key, so that a window can be run again")
    return merge_rows(target, batch, key, **options)


def apply_strategy(target: DataFrame, batch: DataFrame, strategy: str = "default", key: str | Sequence[str] | None = None, **options) -> DataFrame:
    """New contents by the named strategy; 'default' is delete+insert with a key, append without."""
    if strategy == "default":
        strategy = "delete+insert" if _listed(key) else "append"
    if strategy == "append":
        return append_rows(target, batch)
    if strategy == "delete+insert":
        if not _listed(key):
            raise ValueError("delete+insert needs a unique key")
        return delete_insert(target, batch, key, options.get("predicate"))
    if strategy == "merge":
        return merge_rows(target, batch, key, **options)
    if strategy == "insert_overwrite":
        return insert_overwrite(target, batch, options.get("predicate"))
    if strategy == "microbatch":
        return microbatch(target, batch, key, **options)
    raise ValueError(f"unknown strategy {strategy!r}")


def expand_column_types(target: DataFrame, batch: DataFrame) -> DataFrame:
    """The target with its columns as wide as the batch's."""
    comes = {f.name: f.dataType for f in batch.schema}
    return target.select(*[
        F.col(f"`{f.name}`").cast(wider_type(f.dataType, comes.get(f.name, f.dataType))).alias(f.name) for f in target.schema
    ])


def align(target: DataFrame, batch: DataFrame, on_schema_change: str = "ignore") -> tuple[DataFrame, DataFrame]:
    """Both sides with one schema, by the named rule; an unknown rule is 'ignore'.

    ignore: the target's columns, and a batch that lacks one is an error; append_new_columns: the
    batch's new columns are added, null in old rows; sync_all_columns: the batch's columns and types;
    fail: any difference is an error.
    """
    change = schema_changes(target, batch)
    if on_schema_change == "fail" and change["changed"]:
        raise SchemaMismatch("target and batch differ: " + ", ".join(f"{k} {v}" for k, v in change.items() if k != "changed" and v))
    if on_schema_change == "sync_all_columns":
        have = set(target.columns)
        old = [(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in batch.schema]
        return target.select(*old), batch
    if on_schema_change == "append_new_columns":
        added = [f for f in batch.schema if f.name not in set(target.columns)]
        target = target.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in added])
        lacking = [f for f in target.schema if f.name not in set(batch.columns)]
        batch = batch.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in lacking])
        return target, batch.select(*target.columns)
    missing = [c for c in target.columns if c not in set(batch.columns)]
    if missing:
        raise SchemaMismatch(f"the batch lacks the columns {missing}")
    return target, batch.select(*target.columns)


def is_incremental(spark: SparkSession, name: str, full_refresh: bool = False) -> bool:
    """Whether a run only adds to what is there."""
    return not full_refresh and tables.relation_type(spark, name) == "table"


def after_high_water(df: DataFrame, column: str, target: DataFrame, target_column: str, floor) -> DataFrame:
    """Rows later than the target's latest (or than ``floor`` if it is empty).

    The mark is a scalar subquery: one aggregate over one column, then a filter that reaches the scan.
    """
    mark = target.agg(F.coalesce(F.max(target_column), F.lit(floor)).alias("mark")).scalar()
    return df.where(F.col(column) > mark)


def build_incremental(
    spark: SparkSession, name: str, batch: DataFrame, strategy: str = "default", key: str | Sequence[str] | None = None,
    on_schema_change: str = "ignore", full_refresh: bool = False, partition_by: Sequence[str] = (), **options,
) -> DataFrame:
    """Create the table, rebuild it (full refresh, or a view stands there), or apply the batch to it.

    What stands in a table keeps its layout, properties and comments. While the schema and the layout stay,
    'append' writes the batch alone; on a partitioned table an overwrite whose predicate speaks of partition
    columns only, a merge and a delete+insert rewrite just the partitions that they change (:func:`change_partitions`).
    Everything else writes new contents and swaps them in.
    """
    tables.recover(spark, name)
    if not is_incremental(spark, name, full_refresh):
        like = tables.layout_of(spark, name) if tables.relation_type(spark, name) == "table" else None
        return tables.build_table(spark, name, batch, partition_by, like=like)
    target, layout = spark.table(name), tables.layout_of(spark, name)
    old, new = align(target, batch, on_schema_change)
    new = new.select(*old.columns)
    parts = set(layout.partition_by)
    same = [(f.name, f.dataType) for f in expand_column_types(old, new).schema] == [(f.name, f.dataType) for f in target.schema]
    if same and (not partition_by or set(partition_by) == parts):
        if strategy == "append" or strategy == "default" and not _listed(key):
            tables.append(spark, name, new)
            return spark.table(name)
        if strategy == "insert_overwrite" and parts and _speaks_of(target, options.get("predicate"), parts):
            return overwrite_where(spark, name, new, options["predicate"])
        if strategy in ("merge", "microbatch", "delete+insert", "default") and parts and _listed(key):
            held = session.materialize(new, "batch")  # it is asked several times
            try:
                done = change_partitions(spark, name, held, strategy, key, **options)
            finally:
                session.delete(spark, held.kept_at)
            if done is not None:
                return done
    return tables.build_table(spark, name, apply_strategy(expand_column_types(old, new), new, strategy, key, **options), partition_by, like=layout)


def _speaks_of(df: DataFrame, predicate: str | None, columns: set[str]) -> bool:
    """Whether a predicate can be told from these columns alone."""
    if predicate is None:
        return False
    try:
        df.select(*columns).where(predicate)
    except AnalysisException:
        return False
    return True


def overwrite_where(spark: SparkSession, name: str, batch: DataFrame, predicate: str) -> DataFrame:
    """Replace the partitions that meet ``predicate`` by the batch; no other partition is read or written.

    The batch may have rows of other partitions, which are added, and may read the table. Partitions that
    meet the predicate and get no rows are dropped.
    """
    staging = name + tables.NEW
    tables.drop_relation(spark, staging)
    batch.write.saveAsTable(staging)
    staged, columns = spark.table(staging), list(tables.layout_of(spark, name).partition_by)
    meets = F.coalesce(F.expr(predicate), F.lit(False))
    # one row for each partition: their number is bounded by the catalog that lists them
    keep = staged.where(meets).select(*columns).distinct()
    same = reduce(Column.__and__, [F.col(f"p.{c}").eqNullSafe(F.col(f"k.{c}")) for c in columns])
    empty = spark.table(name).select(*columns).distinct().where(meets).alias("p").join(keep.alias("k"), same, "left_anti").collect()
    tables.overwrite_partitions(spark, name, staged.where(meets))
    for row in empty:
        tables.drop_partition(spark, name, row.asDict())
    tables.append(spark, name, staged.where(~meets))
    tables.drop_relation(spark, staging)
    return spark.table(name)


def changed_partitions(target: DataFrame, batch: DataFrame, key: str | Sequence[str], partition: Sequence[str], null_safe: bool = False, predicate: str | None = None) -> list[Row] | None:
    """The partitions with rows that a batch matches, or None if they are more than MAX_PARTITIONS.

    A scan of the keys alone: a broadcast semi-join where the batch is counted to be small. If the key has
    partition columns, only the partitions that the batch names are scanned.
    """
    keys, parts = _listed(key), list(partition)
    named = [c for c in parts if c in keys]
    if named:
        near = batch.select(*named).distinct().limit(MAX_PARTITIONS + 1).collect()
        if len(near) <= MAX_PARTITIONS:
            target = target.where(tables.in_partitions(target, near))
    wanted = batch.select(*[F.col(k).alias(f"__{k}") for k in keys])
    wanted = F.broadcast(wanted) if batch.limit(FEW_ROWS + 1).count() <= FEW_ROWS else wanted
    match = _matches(keys, "{}", "__{}", null_safe)
    if predicate:
        match &= F.expr(predicate)
    found = target.join(wanted, match, "left_semi").select(*parts).distinct().limit(MAX_PARTITIONS + 1).collect()
    return found if len(found) <= MAX_PARTITIONS else None


def change_partitions(spark: SparkSession, name: str, batch: DataFrame, strategy: str, key: str | Sequence[str], **options) -> DataFrame | None:
    """A merge or delete+insert that rewrites the partitions with rows that the batch matches, and no others.

    Rows for other partitions are appended to them; a row that moves leaves its old partition, and a partition
    that loses its last row is dropped. None, and nothing is done, if too many are touched. A run that was cut
    short is mended by running the same batch again.
    """
    target, parts = spark.table(name), list(tables.layout_of(spark, name).partition_by)
    predicate = options.get("predicate") if strategy in ("delete+insert", "default") else None  # a merge's may speak of both sides
    found = changed_partitions(target, batch, key, parts, options.get("null_safe", False), predicate)
    if found is None:
        return None
    staging = name + tables.NEW
    tables.drop_relation(spark, staging)
    apply_strategy(target.where(tables.in_partitions(target, found)), batch, strategy, key, **options).write.saveAsTable(staging)
    staged = spark.table(staging)
    inside = tables.in_partitions(staged, found)
    rewrite_partitions(spark, name, staged.where(inside), found)
    tables.append(spark, name, staged.where(~F.coalesce(inside, F.lit(False))))
    tables.drop_relation(spark, staging)
    return spark.table(name)


def rewrite_partitions(spark: SparkSession, name: str, rows: DataFrame, partitions: Sequence[Row]) -> None:
    """Put ``rows``, which don't read the table, in the place of these partitions; those without rows are dropped."""
    if not partitions:
        return
    left = {tuple(r) for r in rows.select(*partitions[0].__fields__).distinct().collect()}
    tables.overwrite_partitions(spark, name, rows)
    for row in partitions:
        if tuple(row) not in left:
            tables.drop_partition(spark, name, row.asDict())


def merge_partitions(spark: SparkSession, name: str, batch: DataFrame, key: str | Sequence[str], partition: str | Sequence[str], **options) -> DataFrame:
    """A merge that reads and rewrites only the partitions that the batch has rows of, the null partition included.

    Right if a key never moves to another partition; :func:`change_partitions` finds a key wherever it is.
    """
    touched = batch.select(*_listed(partition)).distinct().collect()  # as many as the table gets
    target, staging = spark.table(name), name + tables.NEW
    tables.drop_relation(spark, staging)
    merge_rows(target.where(tables.in_partitions(target, touched)), batch, key, **options).write.saveAsTable(staging)
    tables.overwrite_partitions(spark, name, spark.table(staging))
    tables.drop_relation(spark, staging)
    return spark.table(name)

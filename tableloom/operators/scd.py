"""Slowly changing dimensions: a table that keeps every version of a row with its span of validity."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables

NAMES = {"valid_from": "valid_from", "valid_to": "valid_to", "scd_id": "scd_id", "updated_at": "updated_at", "is_deleted": "is_deleted"}
HARD_DELETES = ("ignore", "invalidate", "new_record")


@dataclass(frozen=True)
class Timestamp:
    """A row has changed if its ``updated_at`` is later than the current version's start."""

    updated_at: str


@dataclass(frozen=True)
class Check:
    """A row has changed if any of ``columns`` differs, null being a value; 'all' takes every column."""

    columns: Sequence[str] | str = "all"


@dataclass(frozen=True)
class Scd2:
    """How a history is kept. ``now`` is one time for a whole run, so a run can be repeated.

    ``valid_to_current`` is the end of current versions: null, or a far date. ``names`` renames the
    columns of the history.
    """

    keys: Sequence[str]
    strategy: Timestamp | Check
    hard_deletes: str = "ignore"
    valid_to_current: str | None = None
    names: Mapping[str, str] | None = None

    def __post_init__(self):
        if self.hard_deletes not in HARD_DELETES:
            raise ValueError(f"hard_deletes is one of {HARD_DELETES}")
        if isinstance(self.strategy, Check) and self.strategy.columns != "all" and not self.strategy.columns:
            raise ValueError("check needs at least one column")

    def name(self, column: str) -> str:
        return (NAMES | dict(self.names or {}))[column]

    @property
    def meta(self) -> list[str]:
        return [self.name(c) for c in NAMES if c != "is_deleted" or self.hard_deletes == "new_record"]


def as_time(text: str | None = None) -> Column:
    """A time without zone; without an argument the session's present."""
    return (F.current_timestamp() if text is None else F.lit(text)).cast("timestamp_ntz")


def scd_id(columns: Sequence[Column]) -> Column:
    """The identity of a version: md5 of its texts, null as nothing, joined by '|'."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def check_time_types(source: DataFrame, rule: Scd2) -> None:
    if isinstance(rule.strategy, Timestamp):
        kind = source.schema[rule.strategy.updated_at].dataType
        if not isinstance(kind, T.TimestampNTZType):
            warnings.warn(f"{rule.strategy.updated_at} is {kind.simpleString()}, the snapshot's times are timestamp_ntz", stacklevel=3)


def _open(rule: Scd2) -> Column:
    return as_time(rule.valid_to_current) if rule.valid_to_current else F.lit(None).cast("timestamp_ntz")


def _is_current(rule: Scd2, valid_to: Column) -> Column:
    return valid_to.isNull() | (valid_to == _open(rule)) if rule.valid_to_current else valid_to.isNull()


def _changed_at(rule: Scd2, now: Column) -> Column:
    return F.col(rule.strategy.updated_at).cast("timestamp_ntz") if isinstance(rule.strategy, Timestamp) else now


def _version(source: DataFrame, rule: Scd2, now: Column) -> DataFrame:
    """The source's rows as open versions."""
    at = _changed_at(rule, now)
    extra = {
        rule.name("scd_id"): scd_id([F.col(k) for k in rule.keys] + [at]),
        rule.name("updated_at"): at,
        rule.name("valid_from"): at,
        rule.name("valid_to"): _open(rule),
    }
    if rule.hard_deletes == "new_record":
        extra[rule.name("is_deleted")] = F.lit("False")
    return source.select("*", *[c.alias(n) for n, c in extra.items()])


def scd2_init(source: DataFrame, rule: Scd2, now: str) -> DataFrame:
    """The first load: every row is a current version."""
    check_time_types(source, rule)
    return _version(source, rule, as_time(now))


def _classified(history: DataFrame, source: DataFrame, rule: Scd2, now: str) -> tuple[DataFrame, Column, Column]:
    """The current versions joined with the source (columns old and new), the changes of each pair, and
    what stays of its old version. One full outer join; versions that have ended take no part."""
    check_time_types(source, rule)
    time, name = as_time(now), rule.name
    new_record = rule.hard_deletes == "new_record"
    versions = _version(source, rule, time)
    fresh = [c for c in source.columns if c not in history.columns]
    for c in fresh:
        history = history.withColumn(c, F.lit(None).cast(source.schema[c].dataType))
    columns = [c for c in history.columns if c not in rule.meta] + rule.meta
    lacking = [c for c in columns if c not in versions.columns]
    versions = versions.select("*", *[F.lit(None).cast(history.schema[c].dataType).alias(c) for c in lacking])

    old = history.where(_is_current(rule, F.col(name("valid_to")))).select(F.struct(*columns).alias("old"))
    new = versions.select(F.struct(*columns).alias("new"))
    same_key = reduce(Column.__and__, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in rule.keys])
    if isinstance(rule.strategy, Timestamp):
        differs = F.coalesce(F.col(f"old.{name('valid_from')}") < F.col(f"new.{name('updated_at')}"), F.lit(False))
    elif rule.strategy.columns == "all" and fresh:
        differs = F.lit(True)
    else:
        checked = source.columns if rule.strategy.columns == "all" else rule.strategy.columns
        differs = reduce(Column.__or__, [~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in checked])
    was_deleted = F.coalesce(F.col(f"old.{name('is_deleted')}") == "True", F.lit(False)) if new_record else F.lit(False)

    def ended(kind: str, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("change_type"), F.col("old").withField(name("valid_to"), at).alias("version"))

    insert = F.struct(F.lit("insert").alias("change_type"), F.col("new").alias("version"))
    nothing = F.array().cast(T.ArrayType(T.StructType([T.StructField("change_type", T.StringType(), False), T.StructField("version", new.schema["new"].dataType)])))
    gone = nothing
    if rule.hard_deletes == "invalidate":
        gone = F.array(ended("delete", time))
    elif new_record:
        tomb = F.col("old")
        for field, value in (("scd_id", scd_id([F.col(f"old.{name('scd_id')}"), time])), ("updated_at", time), ("valid_from", time), ("is_deleted", F.lit("True"))):
            tomb = tomb.withField(name(field), value)
        for c in fresh:
            tomb = tomb.withField(c, F.lit(None).cast(source.schema[c].dataType))
        entry = F.struct(F.lit("insert").alias("change_type"), tomb.alias("version"))
        gone = F.when(was_deleted, nothing).otherwise(F.array(ended("delete", time), entry))
    changes = (
        F.when(F.col("old").isNull(), F.array(insert))
        .when(F.col("new").isNull(), gone)
        .when(differs | was_deleted, F.array(ended("update", F.col(f"new.{name('updated_at')}")), insert))
        .otherwise(nothing)
    )
    stays = F.array(F.struct(F.lit("").alias("change_type"), F.col("old").alias("version")))
    ends = F.exists(changes, lambda c: c["change_type"] != "insert")
    kept = F.when(F.col("old").isNull() | ends, nothing).otherwise(stays)
    return old.join(new, same_key, "full_outer"), changes, kept


def scd2_stage(history: DataFrame, source: DataFrame, rule: Scd2, now: str) -> DataFrame:
    """The changes a run makes: change_type (insert, update, delete), and a version for each.

    One full outer join of the current versions with the source classifies every key; a changed row
    becomes two changes, the end of the old version (its scd_id and new valid_to) and the new one. A
    key with a null matches nothing, so its row is inserted at every run.
    """
    both, changes, _ = _classified(history, source, rule, now)
    return both.select(F.explode(changes).alias("c")).select("c.change_type", "c.version.*")


def scd2_apply(history: DataFrame, staged: DataFrame, rule: Scd2) -> DataFrame:
    """The history after the staged changes: versions that end, and new ones; new columns are added.

    One full outer join by version, so the staged changes are computed once: an ending meets its
    current version, a new version meets nothing and comes through. Versions that have ended before pass
    by the join.
    """
    name = rule.name
    columns = history.columns + [c for c in staged.columns if c not in history.columns and c != "change_type"]
    current = F.coalesce(_is_current(rule, F.col(name("valid_to"))), F.lit(False))
    old = history.where(current).select(F.struct("*").alias("old"))
    ended = history.where(~current).select("*", *[F.lit(None).cast(staged.schema[c].dataType).alias(c) for c in columns if c not in history.columns])
    new = staged.select("change_type", F.struct(*[c for c in staged.columns if c != "change_type"]).alias("new"))
    meets = (
        (F.col(f"old.{name('scd_id')}") == F.col(f"new.{name('scd_id')}"))
        & (F.col("change_type") != "insert")
    )
    both = old.join(new, meets, "full_outer").where(F.col("old").isNotNull() | (F.col("change_type") == "insert"))
    was = set(history.columns)

    def cell(c: str) -> Column:
        kept = F.col(f"old.{c}") if c in was else F.lit(None)
        if c == name("valid_to"):
            kept = F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(kept)
        comes = F.col(f"new.{c}") if c in staged.columns else F.lit(None)
        return F.when(F.col("old").isNull(), comes).otherwise(kept).alias(c)

    return ended.select(*columns).unionByName(both.select(*map(cell, columns)))


def scd2_step(history: DataFrame, source: DataFrame, rule: Scd2, now: str) -> DataFrame:
    """:func:`scd2_stage` and :func:`scd2_apply` in one: the join that classifies the keys gives the
    current versions' part of the new history as well, so there is one shuffle of current versions and
    none of those that have ended."""
    both, changes, kept = _classified(history, source, rule, now)
    rows = both.select(F.explode(F.concat(kept, changes)).alias("c")).select("c.version.*")
    current = F.coalesce(_is_current(rule, F.col(rule.name("valid_to"))), F.lit(False))
    ended = history.where(~current)
    added = [c for c in rows.columns if c not in history.columns]
    ended = ended.select("*", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in added])
    return ended.unionByName(rows.select(*history.columns, *added))


#: Properties of a history that is split, and of a step's rows that were written to their end.
SPLIT, WHOLE = "tableloom.split", "tableloom.whole"


def snapshot_table(
    spark: SparkSession, name: str, source: DataFrame, rule: Scd2, now: str, partition_by: Sequence[str] = (), split: str | None = None,
) -> DataFrame:
    """Keep the history of ``source`` in a table: created at first, stepped forward after that.

    ``partition_by`` lays out a new history; what stands keeps its layout, properties and comments.
    ``split`` names a boolean column, true for current versions, that a new history is partitioned by before all else:
    a step then reads and replaces the current versions alone and appends those that end, so its cost follows
    what is current and not the length of the history.
    """
    tables.recover(spark, name)
    if tables.relation_type(spark, name) is None:
        first = scd2_init(source, rule, now)
        if not split:
            return tables.build_table(spark, name, first, partition_by)
        return tables.build_table(spark, name, first.withColumn(split, F.lit(True)), [split, *partition_by], properties={SPLIT: split})
    layout = tables.layout_of(spark, name)
    split = layout.properties.get(SPLIT)
    if split is None:
        return tables.build_table(spark, name, scd2_step(spark.table(name), source, rule, now), like=layout)
    return _step_apart(spark, name, source, rule, now, split)


def _step_apart(spark: SparkSession, name: str, source: DataFrame, rule: Scd2, now: str, split: str) -> DataFrame:
    """A step on a split history. What it makes is written aside first; a step that was cut short after that is
    finished by the next, one cut short before has changed nothing."""
    staging, valid_to = name + tables.NEW, rule.name("valid_to")
    if tables.relation_type(spark, staging):
        if tables.layout_of(spark, staging).properties.get(WHOLE):
            _publish_apart(spark, name, staging, rule, split, again=True)
        tables.drop_relation(spark, staging)
    history = spark.table(name)
    fresh = [f for f in source.schema if f.name not in history.columns]
    wider = [c for c in source.columns if c in history.columns and source.schema[c].dataType != history.schema[c].dataType]
    if wider:
        raise TypeError(f"the history of {name} has other types for {wider}")
    both, changes, kept = _classified(history.where(F.col(split)).drop(split), source, rule, now)
    rows = both.select(F.explode(F.concat(kept, changes)).alias("c")).select("c.version.*")
    rows.withColumn(split, F.coalesce(_is_current(rule, F.col(valid_to)), F.lit(False))).write.saveAsTable(staging)
    if fresh:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in fresh)})")
    spark.sql(f"ALTER TABLE {staging} SET TBLPROPERTIES ('{WHOLE}' = 'yes')")
    _publish_apart(spark, name, staging, rule, split)
    tables.drop_relation(spark, staging)
    return spark.table(name)


def _publish_apart(spark: SparkSession, name: str, staging: str, rule: Scd2, split: str, again: bool = False) -> None:
    """Replace the current versions, then append those that end. ``again`` leaves out what a first try has appended."""
    staged, parts = spark.table(staging), list(tables.layout_of(spark, name).partition_by)
    current = staged.where(F.col(split))
    was = [v for v in tables.partitions_of(spark, name).values() if v[split] == "true"]
    stays = {tuple(r) for r in current.select(*[F.col(c).cast("string") for c in parts]).distinct().collect()}
    tables.overwrite_partitions(spark, name, current)
    for values in was:
        if tuple(values[c] for c in parts) not in stays:
            tables.drop_partition(spark, name, values)
    ended = staged.where(~F.col(split))
    if again:
        version = [rule.name("scd_id"), rule.name("valid_to")]
        ended = ended.join(spark.table(name).where(~F.col(split)).select(*version), version, "left_anti")
    tables.append(spark, name, ended)

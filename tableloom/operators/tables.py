"""Building and publishing tables and views in the session's catalog.

Parquet tables are not changed in place: new contents are written under another name and then swapped
in by renames. A run that dies between the renames leaves a backup, which the next one restores.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

NEW, OLD = "__new", "__old"


def relation_type(spark: SparkSession, name: str) -> str | None:
    """'table', 'view' or None if there is no such relation."""
    if not spark.catalog.tableExists(name):
        return None
    return "view" if spark.catalog.getTable(name).tableType in ("VIEW", "TEMPORARY") else "table"


def drop_relation(spark: SparkSession, name: str) -> None:
    kind = relation_type(spark, name)
    if kind:
        spark.sql(f"DROP {kind.upper()} IF EXISTS {name}")


def ensure_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}")


def drop_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP SCHEMA IF EXISTS {name} CASCADE")


def recover(spark: SparkSession, target: str) -> None:
    """Undo a swap that was cut short: restore a backup without a target, drop any other leftover."""
    if relation_type(spark, target + OLD):
        if relation_type(spark, target):
            drop_relation(spark, target + OLD)
        else:
            rename(spark, target + OLD, target)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Rename a table; where a catalog leaves the partitions' places behind, they are set anew."""
    spark.sql(f"ALTER TABLE {old} RENAME TO {new}")
    details = {r[0]: r[1] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {new}").collect()}
    if not [c for c in spark.catalog.listColumns(new) if c.isPartition]:
        return
    place = details["Location"].rstrip("/")
    for path, values in partitions_of(spark, new).items():
        spark.sql(f"ALTER TABLE {new} PARTITION ({_spec(values)}) SET LOCATION {_text(f'{place}/{path}')}")


def partitions_of(spark: SparkSession, name: str) -> dict[str, dict[str, str | None]]:
    """What the catalog lists of a partitioned table: path -> values by column, as texts."""
    out = {}
    for (path,) in spark.sql(f"SHOW PARTITIONS {name}").collect():
        pairs = [part.partition("=")[::2] for part in path.split("/")]
        out[path] = {unquote(c): None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v) for c, v in pairs}
    return out


def _spec(values: Mapping[str, object]) -> str:
    return ", ".join(f"`{c}` = " + ("null" if v is None else _text(v)) for c, v in values.items())


def publish_swap(spark: SparkSession, staging: str, target: str) -> None:
    """Put the table ``staging`` in the place of ``target`` (a table, a view or nothing)."""
    recover(spark, target)
    kind = relation_type(spark, target)
    if kind == "view":
        drop_relation(spark, target)
    elif kind == "table":
        rename(spark, target, target + OLD)
    rename(spark, staging, target)
    drop_relation(spark, target + OLD)
    spark.catalog.refreshTable(target)


@dataclass(frozen=True)
class Layout:
    """How a table is stored and described."""

    partition_by: tuple[str, ...] = ()
    cluster_by: tuple[str, ...] = ()
    buckets: int = 0
    properties: Mapping[str, str] = field(default_factory=dict)
    description: str | None = None
    columns: Mapping[str, str] = field(default_factory=dict)


def layout_of(spark: SparkSession, name: str) -> Layout:
    """The layout, properties and comments of a stored table."""
    columns = spark.catalog.listColumns(name)
    details = {r[0]: r[1] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    bucketed = tuple(re.findall(r"`([^`]+)`", details.get("Bucket Columns", "")))
    properties = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect() if not re.match(r"transient_|spark\.sql\.", r[0])}
    return Layout(
        tuple(c.name for c in columns if c.isPartition), bucketed, int(details.get("Num Buckets") or 0) if bucketed else 0, properties,
        spark.catalog.getTable(name).description, {c.name: c.description for c in columns if c.description},
    )


def build_table(
    spark: SparkSession, name: str, df: DataFrame, partition_by: Sequence[str] = (), cluster_by: Sequence[str] = (),
    buckets: int = 0, properties: Mapping[str, str] | None = None, like: Layout | None = None,
) -> DataFrame:
    """Create or replace a table from ``df``, which may read the table itself.

    ``cluster_by`` sorts within the files, or with ``buckets`` deals rows into hashed buckets, so that
    later joins on those columns need no shuffle. What is not given is taken from ``like``, so far as
    ``df`` has the columns.
    """
    recover(spark, name)
    if like:
        have = set(df.columns)
        partition_by = partition_by or tuple(c for c in like.partition_by if c in have)
        if not cluster_by and have.issuperset(like.cluster_by):
            cluster_by, buckets = like.cluster_by, like.buckets
        properties = dict(like.properties) | dict(properties or {})
    drop_relation(spark, name + NEW)
    if cluster_by and not buckets:
        df = df.sortWithinPartitions(*partition_by, *cluster_by)
    writer = df.write.format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if buckets:
        writer = writer.bucketBy(buckets, *cluster_by).sortBy(*cluster_by)
    writer.saveAsTable(name + NEW)
    if properties:
        pairs = ", ".join(f"{_text(k)} = {_text(v)}" for k, v in properties.items())
        spark.sql(f"ALTER TABLE {name + NEW} SET TBLPROPERTIES ({pairs})")
    if like:
        persist_docs(spark, name + NEW, like.description, like.columns)
    publish_swap(spark, name + NEW, name)
    return spark.table(name)


def build_view(spark: SparkSession, name: str, query: str) -> DataFrame:
    """Create or replace a view; a table of that name makes room for it."""
    if relation_type(spark, name) == "table":
        drop_relation(spark, name)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {query}")
    return spark.table(name)


def ephemeral(df: DataFrame, name: str | None = None) -> DataFrame:
    """A model that is never stored: its plan is part of whatever reads it."""
    if name:
        df.createOrReplaceTempView(name)
    return df


SETTING = "tableloom.setting."


def build_materialized_view(spark: SparkSession, name: str, df: DataFrame, settings: Mapping[str, str] | None = None, on_configuration_change: str = "apply", full_refresh: bool = False) -> str:
    """A stored result that is refreshed by running again. Returns what was done.

    'created', 'rebuilt' (full refresh, or it was something else), 'refreshed', or for changed
    settings 'altered' (apply), 'skipped' (continue) or an error (fail).
    """
    wanted = {SETTING + k: str(v) for k, v in (settings or {}).items()}
    own = {SETTING + "kind": "materialized view"}
    kind = relation_type(spark, name)
    now = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect() if r[0].startswith(SETTING)} if kind == "table" else {}
    if kind is None:
        done = "created"
    elif full_refresh or now.get(SETTING + "kind") is None:
        done = "rebuilt"
    elif {k: v for k, v in now.items() if k not in own} == wanted:
        done = "refreshed"
    elif on_configuration_change == "apply":
        done = "altered"
    elif on_configuration_change == "continue":
        warnings.warn(f"settings of {name} changed; it was left as it is", stacklevel=2)
        return "skipped"
    elif on_configuration_change == "fail":
        raise ValueError(f"settings of {name} changed")
    else:
        raise ValueError(f"unknown on_configuration_change {on_configuration_change!r}")
    like = layout_of(spark, name) if kind == "table" else None
    if like:  # settings that are no longer wanted go, the rest of what was said about the table stays
        like = replace(like, properties={k: v for k, v in like.properties.items() if not k.startswith(SETTING)})
    build_table(spark, name, df, properties=own | wanted, like=like)
    return done


def clone_table(spark: SparkSession, src: str, dst: str, as_view: bool = False, full_refresh: bool = False) -> bool:
    """Copy a table, or put a view on it. Nothing is done if they are one or the target is there."""
    if src == dst or (relation_type(spark, dst) and not full_refresh):
        return False
    if as_view:
        build_view(spark, dst, f"SELECT * FROM {src}")
    else:
        build_table(spark, dst, spark.table(src))
    return True


def truncate(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")


def append(spark: SparkSession, name: str, df: DataFrame) -> None:
    """Insert by column name, whatever the order; a column the table lacks is an error."""
    columns = spark.table(name).columns
    extra = set(df.columns) - set(columns)
    if extra:
        raise ValueError(f"{name} has no columns {sorted(extra)}")
    df.select(*columns).write.insertInto(name)


def overwrite_partitions(spark: SparkSession, name: str, df: DataFrame) -> None:
    """Replace just the partitions that ``df`` has rows for."""
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        df.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(key, before)


def drop_partition(spark: SparkSession, name: str, values: Mapping[str, object]) -> None:
    spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({_spec(values)})")


def in_partitions(df: DataFrame, rows: Sequence[Row]) -> Column:
    """Whether a row of ``df`` is in one of these partitions (rows of partition columns, null being a value).

    Literals only, so the scan is pruned when it is planned.
    """
    if not rows:
        return F.lit(False)
    columns = rows[0].__fields__
    lit = lambda c, v: F.lit(v).cast(df.schema[c].dataType)
    if len(columns) == 1:
        (c,) = columns
        some = F.col(c).isin([lit(c, r[0]) for r in rows if r[0] is not None])
        return some | F.col(c).isNull() if any(r[0] is None for r in rows) else some
    either = [reduce(Column.__and__, [F.col(c).isNull() if v is None else F.col(c) == lit(c, v) for c, v in zip(columns, r)]) for r in rows]
    while len(either) > 1:  # a flat tree, however many
        either = [a | b for a, b in zip(either[::2], either[1::2])] + either[len(either) // 2 * 2 :]
    return either[0]


def _text(value: str) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def persist_docs(spark: SparkSession, name: str, description: str | None = None, columns: Mapping[str, str] | None = None) -> None:
    """Comments on a table and on those of the named columns that it has."""
    if description is not None:
        spark.sql(f"COMMENT ON TABLE {name} IS {_text(description)}")
    for column in spark.table(name).columns:
        if column in (columns or {}):
            spark.sql(f"ALTER TABLE {name} ALTER COLUMN `{column}` COMMENT {_text(columns[column])}")


def write_failures(spark: SparkSession, name: str, failing: DataFrame, view_of: str | None = None) -> int:
    """Keep the failing rows of a check (or, as a view, its query) and count the stored copy."""
    if view_of is None:
        build_table(spark, name, failing)
    else:
        build_view(spark, name, view_of)
    return spark.table(name).count()

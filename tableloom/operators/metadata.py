"""Schemas, contracts and the catalog as data."""

from __future__ import annotations

import fnmatch
import warnings
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = "name string, type string, length int, precision int, scale int, position int"
TYPE_LABELS = {"MANAGED": "table", "EXTERNAL": "external", "VIEW": "view", "TEMPORARY": "view", "MATERIALIZED_VIEW": "materializedview"}


def query_schema(df: DataFrame) -> list[tuple]:
    """(name, type, length, precision, scale, position) of each column; nothing is read."""
    out = []
    for k, f in enumerate(df.schema):
        kind = f.dataType
        decimal = isinstance(kind, T.DecimalType)
        length = kind.length if isinstance(kind, (T.VarcharType, T.CharType)) else None
        out.append((f.name, kind.simpleString(), length, kind.precision if decimal else None, kind.scale if decimal else None, k + 1))
    return out


def columns_of(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame(query_schema(spark.table(table)), COLUMNS)


def diff_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns of a that b has not, by exact name."""
    return [c for c in a.columns if c not in set(b.columns)]


#: Numbers widen from left to right.
WIDER = ("tinyint", "smallint", "int", "bigint", "float", "double")


def wider_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both, or ``a`` if there is none."""
    x, y = a.simpleString(), b.simpleString()
    if x in WIDER and y in WIDER:
        return a if WIDER.index(x) >= WIDER.index(y) else b
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        whole = max(a.precision - a.scale, b.precision - b.scale)
        return T.DecimalType(min(38, whole + scale), scale)
    return a


def diff_column_types(a: DataFrame, b: DataFrame) -> list[tuple[str, str, str]]:
    """(name, type in a, type in b) of shared columns where a's type does not hold b's."""
    mine, out = {f.name: f.dataType for f in a.schema}, []
    for f in b.schema:
        if f.name in mine and mine[f.name] != f.dataType:
            fits = wider_type(mine[f.name], f.dataType) == wider_type(f.dataType, mine[f.name]) == mine[f.name]
            if not fits:
                out.append((f.name, mine[f.name].simpleString(), f.dataType.simpleString()))
    return out


def schema_changes(target: DataFrame, batch: DataFrame) -> dict:
    """What a batch's schema changes: changed, added, removed, retyped."""
    added, removed, retyped = diff_columns(batch, target), diff_columns(target, batch), diff_column_types(target, batch)
    return {"changed": bool(added or removed or retyped), "added": added, "removed": removed, "retyped": retyped}


def schema_change_report(target: DataFrame, batch: DataFrame) -> DataFrame:
    """One row for each difference: change, name, old_type, new_type."""
    change = schema_changes(target, batch)
    old, new = ({f.name: f.dataType.simpleString() for f in df.schema} for df in (target, batch))
    rows = [("added", c, None, new[c]) for c in change["added"]] + [("removed", c, old[c], None) for c in change["removed"]]
    rows += [("retyped", *r) for r in change["retyped"]]
    return target.sparkSession.createDataFrame(rows, "change string, name string, old_type string, new_type string")


def declared(columns: Mapping[str, str]) -> T.StructType:
    """A schema from names and type names; a column without a type is an error."""
    if not columns:
        raise ValueError("a contract needs declared columns")
    out = T.StructType()
    for name, kind in columns.items():
        if not kind:
            raise ValueError(f"column {name!r} has no type")
        if kind.strip().lower() in ("decimal", "numeric", "dec"):
            warnings.warn(f"column {name!r}: a decimal without precision and scale drops fractions", stacklevel=3)
        out.add(name, T.DataType.fromDDL(kind))
    return out


def empty_with_schema(spark: SparkSession, columns: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame([], declared(columns))


def assert_contract(df: DataFrame, columns: Mapping[str, str]) -> None:
    """Raise, showing both sides, unless ``df`` has exactly these columns and types, in any order."""
    want = sorted((f.name.lower(), f.dataType.simpleString()) for f in declared(columns))
    have = sorted((f.name.lower(), f.dataType.simpleString()) for f in df.schema)
    if want != have:
        raise TypeError(f"contract broken; declared: {want}; found: {have}")


def apply_contract(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """``df`` in the declared order, once the contract holds."""
    assert_contract(df, columns)
    return df.select(*columns)


def list_relations(spark: SparkSession, schema: str) -> DataFrame:
    """schema, name, type of its tables and views; a session's temporary views are in no schema."""
    rows = [(schema, t.name, TYPE_LABELS.get(t.tableType, t.tableType.lower())) for t in spark.catalog.listTables(schema) if not t.isTemporary]
    return spark.createDataFrame(rows, "schema string, name string, type string")


def relations_like(spark: SparkSession, schema_pattern: str, table_pattern: str, exclude: str = "", excluded_schemas: Iterable[str] = ()) -> DataFrame:
    """Relations whose schema and name are like SQL patterns (% and _), regardless of case."""
    def like(text: str, pattern: str) -> bool:
        return fnmatch.fnmatchcase(text.lower(), pattern.lower().replace("[", "[[]").replace("*", "[*]").replace("?", "[?]").replace("%", "*").replace("_", "?"))

    rows = []
    for db in spark.catalog.listDatabases():
        if like(db.name, schema_pattern) and db.name not in set(excluded_schemas):
            for t in spark.catalog.listTables(db.name):
                if not t.isTemporary and like(t.name, table_pattern) and not (exclude and like(t.name, exclude)):
                    rows.append((db.name, t.name, TYPE_LABELS.get(t.tableType, t.tableType.lower())))
    return spark.createDataFrame(sorted(set(rows)), "schema string, name string, type string")


CATALOG = "relation string, relation_type string, column string, position int, type string"


def catalog_report(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """One row for each column of the tables; those that do not exist are left out."""
    rows = []
    for name in tables:
        if spark.catalog.tableExists(name):
            kind = TYPE_LABELS.get(spark.catalog.getTable(name).tableType, "table")
            rows += [(name, kind, c[0], c[5], c[1]) for c in query_schema(spark.table(name))]
    return spark.createDataFrame(rows, CATALOG)


def column_profile(frames: Mapping[str, DataFrame]) -> DataFrame:
    """relation, column, position, n_rows, n_values: the catalog with counts, one scan for each frame."""
    parts = []
    for name, df in frames.items():
        counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(df.columns)])
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k + 1).alias("position"), F.col(f"c{k}").alias("n_values")) for k, c in enumerate(df.columns)])
        parts.append(counts.select(F.lit(name).alias("relation"), "n", F.explode(cells).alias("c")).select("relation", "c.column", "c.position", F.col("n").alias("n_rows"), "c.n_values"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)

"""Materialised views of aggregates that are refreshed from what has changed in their source.

The state of a view is a table of partial aggregates for each partition of the source and each group. A refresh
compares the files of the source's partitions with those that it saw last, recomputes the partial aggregates of the partitions
that differ, drops those of partitions that are gone, and merges the state into the view. Nothing else of the source is read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import incremental, tables

STATE, SEEN = "__state", "__seen"
#: Of a sketch of quantiles; ranks are then right to about 1.3 percent of the rows, at 99 percent confidence.
QUANTILE_SIZE = 200
DEFINED = tables.SETTING + "defined as"


@dataclass(frozen=True)
class AggregateView:
    """``source`` (a table, best partitioned) grouped by ``keys``.

    ``measures`` maps a column of the view to (function, SQL of what it takes): count (of '*' too), sum, min, max, avg, bool_or,
    bool_and, approx_distinct, whose standard error is about 1.6 percent, or quantiles, a sketch that
    :func:`quantile` reads. ``where`` filters the source's rows.
    """

    source: str
    keys: Sequence[str]
    measures: Mapping[str, tuple[str, str]]
    where: str | None = None

    def text(self) -> str:
        return json.dumps([self.source, list(self.keys), {k: list(v) for k, v in self.measures.items()}, self.where])

    def partials(self) -> list[Column]:
        """What is kept of the rows of a partition and group."""
        out = []
        for name, (kind, column) in self.measures.items():
            value = F.lit(1) if column == "*" else F.expr(column)
            made = {
                "count": [F.count(value)], "sum": [F.sum(value)], "min": [F.min(value)], "max": [F.max(value)],
                "avg": [F.sum(value), F.count(value)], "bool_or": [F.bool_or(value)], "bool_and": [F.bool_and(value)],
                "approx_distinct": [F.hll_sketch_agg(value, F.lit(12))],
                "quantiles": [F.kll_sketch_agg_double(value.try_cast("double"), F.lit(QUANTILE_SIZE))],
            }[kind]
            out += [c.alias(f"{name}__{k}") for k, c in enumerate(made)]
        return out

    def merged(self) -> list[Column]:
        """The measures from their partial aggregates."""
        out = []
        for name, (kind, _) in self.measures.items():
            a, b = F.col(f"{name}__0"), F.col(f"{name}__1")
            made = {
                "count": lambda: F.sum(a), "sum": lambda: F.sum(a), "min": lambda: F.min(a), "max": lambda: F.max(a),
                "avg": lambda: F.try_divide(F.sum(a), F.sum(b)), "bool_or": lambda: F.bool_or(a), "bool_and": lambda: F.bool_and(a),
                "approx_distinct": lambda: F.hll_sketch_estimate(F.hll_union_agg(a)),
                "quantiles": lambda: F.kll_merge_agg_double(a, F.lit(QUANTILE_SIZE)),
            }[kind]()
            out.append(made.alias(name))
        return out

    def rows(self, spark: SparkSession) -> DataFrame:
        source = spark.table(self.source)
        return source.where(self.where) if self.where else source

    def whole(self, spark: SparkSession) -> DataFrame:
        """The view's query over the whole source."""
        return self.rows(spark).groupBy(*self.keys).agg(*self.partials()).groupBy(*self.keys).agg(*self.merged())


def file_digests(spark: SparkSession, name: str) -> dict[str, str]:
    """A digest of the file names of each partition of a table ('' if it has none). Files are never changed, only replaced."""
    found: dict[str, list[str]] = {}
    for file in spark.table(name).inputFiles():
        parts = [p for p in file.split("/")[:-1] if "=" in p]
        found.setdefault("/".join(parts), []).append(file)
    return {k: hashlib.sha256("\n".join(sorted(v)).encode()).hexdigest() for k, v in found.items()}


def _rows_of(spark: SparkSession, name: str, paths: Sequence[str], parts: Sequence[str]) -> list[Row]:
    """Partition paths as rows of their columns' types."""
    if not paths:
        return []
    values = []
    for path in paths:
        pairs = dict(p.split("=", 1) for p in path.split("/"))
        named = {unquote(unquote(k)): v for k, v in pairs.items()}
        values.append([None if named[c] == "__HIVE_DEFAULT_PARTITION__" else unquote(unquote(named[c])) for c in parts])
    schema = spark.table(name).schema
    texts = spark.createDataFrame(values, ", ".join(f"`{c}` string" for c in parts))
    return texts.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in parts]).collect()


def refresh(spark: SparkSession, name: str, view: AggregateView, full_refresh: bool = False) -> str:
    """Bring the view ``name`` up to date: 'created', 'rebuilt' (asked for, defined anew, or the source has no partitions), 'refreshed' or 'unchanged'.

    The digests seen are written last, so a refresh that was cut short is done again.
    """
    state, seen = name + STATE, name + SEEN
    layout = tables.layout_of(spark, view.source)
    parts = list(layout.partition_by)
    kind = tables.relation_type(spark, name)
    like = tables.layout_of(spark, name) if kind == "table" else None
    fits = bool(like) and like.properties.get(DEFINED) == view.text()
    own = {tables.SETTING + "kind": "materialized view", DEFINED: view.text()}
    if not parts:
        tables.build_table(spark, name, view.whole(spark), properties=own, like=like)
        return "rebuilt" if kind else "created"
    now = file_digests(spark, view.source)
    known = {}
    if fits and not full_refresh and tables.relation_type(spark, seen) and tables.relation_type(spark, state):
        known = {r.path: r.digest for r in spark.table(seen).collect()}  # a row for each partition
    changed = [p for p in now if known.get(p) != now[p]]
    gone = [p for p in known if p not in now]
    if known and not changed and not gone:
        return "unchanged"
    columns = {c: f"part__{c}" for c in parts}

    def partial(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*[F.col(c).alias(n) for c, n in columns.items()], *view.keys).agg(*view.partials())

    if not known or len(changed) > incremental.MAX_PARTITIONS:
        tables.build_table(spark, state, partial(view.rows(spark)), partition_by=list(columns.values()))
    else:
        kept = [Row(*columns.values())(*r) for r in _rows_of(spark, view.source, [*changed, *gone], parts)]
        wanted = _rows_of(spark, view.source, changed, parts)
        rows = view.rows(spark)
        incremental.rewrite_partitions(spark, state, partial(rows.where(tables.in_partitions(rows, wanted))), kept)
    held = spark.table(state).groupBy(*view.keys).agg(*view.merged())
    tables.build_table(spark, name, held, properties=own, like=like)
    tables.build_table(spark, seen, spark.createDataFrame(sorted(now.items()), "path string, digest string"))
    return "created" if kind is None else "refreshed" if known else "rebuilt"


def quantile(sketch: Column, share: float) -> Column:
    """The value below which about ``share`` of a measure of kind quantiles lies; null if there were none."""
    some = F.kll_sketch_get_n_double(sketch) > 0
    return F.when(some, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))


PROFILE = "relation string, column string, position int, n_rows long, n_values long, n_distinct long, low string, high string, q25 double, median double, q75 double"


def table_statistics(spark: SparkSession, name: str, statistics: str, columns: Sequence[str] | None = None) -> DataFrame:
    """PROFILE: a row for each column of a table, from a view named ``statistics`` that is refreshed first.

    Row counts, values, least and greatest are exact. Distinct values (of types that have an order) and quantiles (of numbers) come from sketches
    that are kept for each partition and merged, so only partitions that are new or changed are scanned, all columns at once.
    """
    schema = spark.table(name).schema
    plain = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)
    named = [c for c in columns or schema.names if isinstance(schema[c].dataType, plain)]
    measures: dict[str, tuple[str, str]] = {"n_rows": ("count", "*")}
    for k, c in enumerate(named):
        text = f"cast(`{c}` as string)"
        measures |= {f"values_{k}": ("count", f"`{c}`"), f"low_{k}": ("min", f"`{c}`"), f"high_{k}": ("max", f"`{c}`"), f"distinct_{k}": ("approx_distinct", text)}
        if isinstance(schema[c].dataType, T.NumericType):
            measures[f"quantiles_{k}"] = ("quantiles", f"`{c}`")
    refresh(spark, statistics, AggregateView(name, [], measures))
    held = spark.table(statistics)
    nothing = F.lit(None).cast("double")

    def row(k: int, c: str) -> Column:
        shares = [quantile(F.col(f"quantiles_{k}"), x) if f"quantiles_{k}" in measures else nothing for x in (0.25, 0.5, 0.75)]
        ends = [F.col(f"{end}_{k}").cast("string") for end in ("low", "high")]
        return F.struct(F.lit(name).alias("relation"), F.lit(c).alias("column"), F.lit(schema.names.index(c) + 1).alias("position"), F.col("n_rows").alias("n_rows"),
                        F.col(f"values_{k}").alias("n_values"), F.col(f"distinct_{k}").alias("n_distinct"), ends[0].alias("low"), ends[1].alias("high"),
                        shares[0].alias("q25"), shares[1].alias("median"), shares[2].alias("q75"))

    return held.select(F.explode(F.array(*[row(k, c) for k, c in enumerate(named)])).alias("r")).select("r.*")

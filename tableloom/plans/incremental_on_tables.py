"""Incremental loads, histories, event-time windows and published tables over the tables."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from ..operators import checks as ck
from ..operators import incremental as inc
from ..operators import scd, tables, views
from ..streaming import events as ev
from .base import query
from .catalog_on_tables import exported, scratch

OLD = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'"
NEW = "SELECT o_orderkey, o_custkey, 'N' AS o_orderstatus, o_totalprice * 1.1 AS o_totalprice, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01'"
WITH = f"WITH t AS ({OLD}), b AS ({NEW})"
COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]


def target(t):
    return t.orders.where("o_orderdate < timestamp_ntz '1997-01-01'").select(*COLUMNS)


def batch(t):
    rows = t.orders.where("o_orderdate >= timestamp_ntz '1996-06-01'")
    return rows.select("o_orderkey", "o_custkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") * 1.1).alias("o_totalprice"), "o_orderdate")


@query(f"{WITH} SELECT * FROM t UNION ALL SELECT * FROM b")
def inc_append(t):
    return inc.apply_strategy(target(t), batch(t), "append")


@query(f"{WITH} SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) OR NOT (o_orderstatus = 'F') UNION ALL SELECT * FROM b")
def inc_delete_insert(t):
    return inc.apply_strategy(target(t), batch(t), "delete+insert", "o_orderkey", predicate="o_orderstatus = 'F'")


@query(f"{WITH} SELECT * FROM b UNION ALL SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)")
def inc_default(t):
    return inc.apply_strategy(target(t), batch(t), key="o_orderkey")


@query(f"{WITH} SELECT * FROM b UNION ALL SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)")
def inc_merge(t):
    return inc.merge_rows(target(t), batch(t), "o_orderkey")


@query(f"""{WITH}
SELECT t.o_orderkey, t.o_custkey, t.o_orderstatus, b.o_totalprice, t.o_orderdate FROM t JOIN b ON t.o_orderkey = b.o_orderkey
UNION ALL SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)""")
def inc_merge_columns(t):
    return inc.merge_rows(target(t), batch(t), "o_orderkey", update=["o_totalprice"])


@query(f"""{WITH}
SELECT b.o_orderkey, b.o_custkey, t.o_orderstatus, b.o_totalprice, b.o_orderdate FROM t JOIN b ON t.o_orderkey = b.o_orderkey AND t.o_custkey = b.o_custkey
UNION ALL SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)""")
def inc_merge_exclude(t):
    return inc.merge_rows(target(t), batch(t), ["o_orderkey", "o_custkey"], exclude=["O_ORDERSTATUS"])


@query(f"{WITH} SELECT * FROM t WHERE NOT (o_orderdate >= TIMESTAMP '1996-01-01') UNION ALL SELECT * FROM b")
def inc_insert_overwrite(t):
    return inc.insert_overwrite(target(t), batch(t), "o_orderdate >= timestamp_ntz '1996-01-01'")


@query("SELECT event_id, ts FROM events WHERE ts > (SELECT coalesce(max(ts), TIMESTAMP '1970-01-01') FROM events WHERE ts < TIMESTAMP '2024-01-15')")
def inc_high_water(t):
    return inc.after_high_water(t.events, "ts", t.events.where("ts < timestamp_ntz '2024-01-15'"), "ts", "1970-01-01 00:00:00").select("event_id", "ts")


WIDE = "SELECT *, o_totalprice > 100000 AS big FROM b"


@query(f"{WITH} SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) UNION ALL SELECT * FROM b")
def inc_ignore_columns(t):
    old, new = inc.align(target(t), batch(t).withColumn("big", F.col("o_totalprice") > 100000), "ignore")
    return inc.delete_insert(old, new, "o_orderkey")


@query(f"{WITH} SELECT *, CAST(NULL AS BOOLEAN) AS big FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) UNION ALL {WIDE}")
def inc_append_columns(t):
    old, new = inc.align(target(t), batch(t).withColumn("big", F.col("o_totalprice") > 100000), "append_new_columns")
    return inc.delete_insert(old, new, "o_orderkey")


@query(f"""{WITH} SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_totalprice, CAST(NULL AS BOOLEAN) AS big FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)
UNION ALL SELECT o_orderkey, CAST(o_custkey AS VARCHAR), o_totalprice, o_totalprice > 100000 FROM b""")
def inc_sync_columns(t):
    new = batch(t).select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), "o_totalprice", (F.col("o_totalprice") > 100000).alias("big"))
    old, new = inc.align(target(t), new, "sync_all_columns")
    return inc.delete_insert(old, new, "o_orderkey")


@query("SELECT CAST(c_nationkey AS BIGINT) AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def inc_widen(t):
    new = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return inc.append_rows(inc.expand_column_types(t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v")), new), new)


V1 = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS nation, TIMESTAMP '2024-01-01' AS changed FROM customer WHERE c_custkey % 13 <> 0"
V2 = """SELECT c_custkey, c_name, c_nationkey + CASE WHEN c_custkey % 7 = 0 THEN 100 ELSE 0 END AS nation,
  CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS changed FROM customer WHERE c_custkey % 11 <> 0"""
NOW1, NOW2, NOW3 = "2024-01-10 00:00:00", "2024-02-10 00:00:00", "2024-03-10 00:00:00"


def version_1(t):
    rows = t.customer.where("c_custkey % 13 <> 0")
    return rows.select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("nation"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("changed"))


def version_2(t):
    seventh = F.col("c_custkey") % 7 == 0
    return t.customer.where("c_custkey % 11 <> 0").select(
        "c_custkey", "c_name", (F.col("c_nationkey") + F.when(seventh, 100).otherwise(0)).cast("long").alias("nation"),
        F.when(seventh, "2024-02-01 00:00:00").otherwise("2024-01-01 00:00:00").cast("timestamp_ntz").alias("changed"),
    )


def _open_version(at: str, source: str, more: str = "") -> str:
    return f"""SELECT c_custkey, c_name, nation, changed, md5(CAST(c_custkey AS VARCHAR) || '|' || CAST({at} AS VARCHAR)) AS scd_id, {at} AS updated_at, {at} AS valid_from,
  CAST(NULL AS TIMESTAMP) AS valid_to{more} FROM {source}"""


@query(f"WITH v1 AS ({V1}) {_open_version('changed', 'v1')}")
def scd_init(t):
    return scd.scd2_init(version_1(t), scd.Scd2(["c_custkey"], scd.Timestamp("changed")), NOW1)


def _history(at1: str, at2: str, differs: str, gone: str) -> str:
    """SQL of a second run: versions that stay or end, then new ones."""
    return f"""
WITH v1 AS ({V1}), v2 AS ({V2}), h AS ({_open_version(at1, 'v1')}),
ends AS (SELECT h.c_custkey, {at2.replace('changed', 'v2.changed')} AS e FROM h JOIN v2 USING (c_custkey) WHERE {differs} {gone})
SELECT h.* REPLACE (ends.e AS valid_to) FROM h LEFT JOIN ends USING (c_custkey)
UNION ALL SELECT n.* FROM ({_open_version(at2, 'v2')}) n LEFT JOIN h USING (c_custkey) WHERE h.c_custkey IS NULL
UNION ALL SELECT n.* FROM ({_open_version(at2, 'v2')}) n JOIN h USING (c_custkey) JOIN v2 USING (c_custkey) WHERE {differs}"""


T1, T2 = f"TIMESTAMP '{NOW1}'", f"TIMESTAMP '{NOW2}'"


@query(_history("changed", "changed", "h.valid_from < v2.changed", ""))
def scd_timestamp(t):
    rule = scd.Scd2(["c_custkey"], scd.Timestamp("changed"))
    return scd.scd2_step(scd.scd2_init(version_1(t), rule, NOW1), version_2(t), rule, NOW2)


@query(_history(T1, T2, "h.nation IS DISTINCT FROM v2.nation", ""))
def scd_check(t):
    rule = scd.Scd2(["c_custkey"], scd.Check(["nation"]))
    return scd.scd2_step(scd.scd2_init(version_1(t), rule, NOW1), version_2(t), rule, NOW2)


ANY = "(h.nation IS DISTINCT FROM v2.nation OR h.changed IS DISTINCT FROM v2.changed OR h.c_name IS DISTINCT FROM v2.c_name)"
GONE = f"UNION ALL SELECT c_custkey, {T2} FROM h WHERE c_custkey NOT IN (SELECT c_custkey FROM v2)"


@query(_history(T1, T2, ANY, GONE))
def scd_invalidate(t):
    rule = scd.Scd2(["c_custkey"], scd.Check("all"), hard_deletes="invalidate")
    return scd.scd2_step(scd.scd2_init(version_1(t), rule, NOW1), version_2(t), rule, NOW2)


T3 = f"TIMESTAMP '{NOW3}'"


@query(f"""
WITH v1 AS ({V1}), h AS ({_open_version(T1, 'v1', ", 'False' AS is_deleted")}),
gone AS (SELECT * FROM h WHERE c_custkey % 11 = 0),
tomb AS (SELECT * REPLACE (md5(scd_id || '|' || CAST({T2} AS VARCHAR)) AS scd_id, {T2} AS updated_at, {T2} AS valid_from, 'True' AS is_deleted) FROM gone)
SELECT * FROM h WHERE c_custkey % 11 <> 0
UNION ALL SELECT * REPLACE ({T2} AS valid_to) FROM gone
UNION ALL SELECT * REPLACE ({T3} AS valid_to) FROM tomb
UNION ALL {_open_version(T3, "(SELECT * FROM v1 WHERE c_custkey % 11 = 0)", ", 'False' AS is_deleted")}""")
def scd_new_record(t):
    """Rows vanish, leave tombstones, and come back."""
    rule = scd.Scd2(["c_custkey"], scd.Check(["nation"]), hard_deletes="new_record")
    full = version_1(t)
    first = scd.scd2_init(full, rule, NOW1)
    second = scd.scd2_step(first, full.where("c_custkey % 11 <> 0"), rule, NOW2)
    return scd.scd2_step(second, full, rule, NOW3)


@query("SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def evt_window(t):
    return ev.event_time_window(t.events, "ts", "2024-01-10 00:00:00", "2024-01-11 00:00:00").drop("props")


@query("""
SELECT event_id, user_id, CASE WHEN ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13' THEN value * 2 ELSE value END AS value
FROM events WHERE ts < TIMESTAMP '2024-01-13'""")
def evt_microbatch(t):
    """What stands of the days before the 12th, and the window from the 10th to the 12th run over it."""
    columns = ["event_id", "user_id", "value"]
    stored = t.events.where("ts < timestamp_ntz '2024-01-12'").select(*columns)
    window = ev.windowed({"events": t.events}, {"events": "ts"}, "2024-01-10 00:00:00", "2024-01-13 00:00:00")["events"]
    return inc.microbatch(stored, window.withColumn("value", F.col("value") * 2).select(*columns), "event_id")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def snk_table(t):
    return tables.build_table(t.spark, scratch(t, "orders"), t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT n_nationkey, n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def snk_view(t):
    name = scratch(t, "nation_view")
    at = lambda x: f"parquet.`{t.folder}/{x}.parquet`"
    return tables.build_view(t.spark, name, f"SELECT n_nationkey, n_name, count(c_custkey) AS n FROM {at('nation')} LEFT JOIN {at('customer')} ON c_nationkey = n_nationkey GROUP BY 1, 2")


@query("SELECT s_suppkey, s_name, s_acctbal + 1 AS s_acctbal FROM supplier")
def snk_swap_again(t):
    """Built, then rebuilt from its own contents."""
    name = scratch(t, "supplier")
    first = tables.build_table(t.spark, name, t.supplier.select("s_suppkey", "s_name", "s_acctbal"))
    return tables.build_table(t.spark, name, first.withColumn("s_acctbal", F.col("s_acctbal") + 1))


@query("SELECT event_type, event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-10' UNION ALL SELECT event_type, event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-25'")
def snk_append(t):
    name = scratch(t, "events")
    rows = t.events.select("event_type", "event_id", "ts")
    tables.build_table(t.spark, name, rows.where("ts < timestamp_ntz '2024-01-10'"), partition_by=["event_type"])
    tables.append(t.spark, name, rows.where("ts >= timestamp_ntz '2024-01-25'").select("ts", "event_type", "event_id"))
    return t.spark.table(name).select("event_type", "event_id", "ts")


@query("SELECT event_type, event_id, CASE WHEN event_type = 'click' THEN value * 10 ELSE value END AS value FROM events")
def snk_partitions(t):
    """A partition-scoped merge: only the click partition is read and written again."""
    name = scratch(t, "events_by_type")
    rows = t.events.select("event_id", "value", "event_type")
    tables.build_table(t.spark, name, rows, partition_by=["event_type"])
    clicks = rows.where("event_type = 'click'").withColumn("value", F.col("value") * 10)
    return inc.merge_partitions(t.spark, name, clicks, "event_id", "event_type").select("event_type", "event_id", "value")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def snk_failures(t):
    name = scratch(t, "failures")
    tables.write_failures(t.spark, name, ck.is_positive(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal"))
    return t.spark.table(name)


@query("SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def snk_materialized_view(t):
    name = scratch(t, "nations")
    rows = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    tables.build_materialized_view(t.spark, name, rows, {"layout": "plain"})
    tables.build_materialized_view(t.spark, name, rows, {"layout": "plain"})
    return t.spark.table(name)


@query("SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_size > 25")
def snk_clone(t):
    src, dst = scratch(t, "part"), scratch(t, "part_clone")
    tables.build_table(t.spark, src, t.part.where("p_size > 25").select("p_partkey", "p_brand", "p_retailprice"), cluster_by=["p_partkey"], buckets=4)
    tables.clone_table(t.spark, src, dst)
    return t.spark.table(dst)


@query(f"{WITH} SELECT * FROM b UNION ALL SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)")
def inc_build(t):
    """A view stands in the way, then a first run, a full refresh, and two merges of one batch."""
    name = scratch(t, "orders")
    tables.build_view(t.spark, name, "SELECT 1 AS one")
    inc.build_incremental(t.spark, name, batch(t).limit(0), "merge", "o_orderkey")
    inc.build_incremental(t.spark, name, target(t), "merge", "o_orderkey", full_refresh=True)
    inc.build_incremental(t.spark, name, batch(t), "merge", "o_orderkey")
    return inc.build_incremental(t.spark, name, batch(t), "merge", "o_orderkey")


@query("""
SELECT o_orderkey, o_totalprice * CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS o_totalprice, o_orderstatus FROM orders""")
def inc_build_partitions(t):
    """A merge whose key has the partition column touches one partition of the table, which keeps its layout."""
    name, rows = scratch(t, "orders"), t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    inc.build_incremental(t.spark, name, rows, "merge", ["o_orderkey", "o_orderstatus"], partition_by=["o_orderstatus"])
    some = rows.where("o_orderstatus = 'F' and o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return inc.build_incremental(t.spark, name, some, "merge", ["o_orderkey", "o_orderstatus"])


@query("""
SELECT event_id, value, event_type FROM events WHERE event_type NOT IN ('click', 'view')
UNION ALL SELECT event_id, 0.5, event_type FROM events WHERE event_type = 'click' AND event_id % 3 = 0
UNION ALL SELECT -event_id, 1.0, event_type FROM events WHERE event_type = 'purchase'""")
def inc_build_overwrite(t):
    """Two partitions replaced, of which one gets no rows; rows of a third are added."""
    name, rows = scratch(t, "events"), t.events.select("event_id", "value", "event_type")
    inc.build_incremental(t.spark, name, rows, partition_by=["event_type"])
    clicks = rows.where("event_type = 'click' and event_id % 3 = 0").withColumn("value", F.lit(0.5))
    more = rows.where("event_type = 'purchase'").select((-F.col("event_id")).alias("event_id"), F.lit(1.0).alias("value"), "event_type")
    return inc.build_incremental(t.spark, name, clicks.union(more), "insert_overwrite", predicate="event_type in ('click', 'view')")


@query("SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-10' UNION ALL SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def inc_is_incremental(t):
    """The model reads all that is needed at first, later only what lies above its high-water mark."""
    name = scratch(t, "events")
    for upto in ("2024-01-10", "2030-01-01"):
        rows = t.events.where(f"ts < timestamp_ntz '{upto}'").select("event_id", "ts")
        if inc.is_incremental(t.spark, name):
            rows = inc.after_high_water(rows, "ts", t.spark.table(name), "ts", "1970-01-01 00:00:00")
        inc.build_incremental(t.spark, name, rows, "append")
    return t.spark.table(name)


@query("SELECT s_suppkey, s_name, 'columns differ' AS refused FROM supplier")
def inc_fail_columns(t):
    """A batch of other columns is refused; the table stays as it was."""
    name = scratch(t, "supplier")
    inc.build_incremental(t.spark, name, t.supplier.select("s_suppkey", "s_name"))
    said = ""
    try:
        inc.build_incremental(t.spark, name, t.supplier.select("s_suppkey", "s_acctbal"), on_schema_change="fail")
    except inc.SchemaMismatch:
        said = "columns differ"
    return t.spark.table(name).withColumn("refused", F.lit(said))


@query("""
SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1, 2""")
def evt_run_microbatch(t):
    """Four days, each a batch of its own; one day runs twice."""
    name = scratch(t, "daily")
    model = lambda events: events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    for day in (8, 9, 10, 9, 11):
        ev.run_microbatch(t.spark, model, {"events": t.events}, {"events": "ts"}, f"2024-01-{day:02d}", f"2024-01-{day + 1:02d}", name, ["user_id", "day"])
    return t.spark.table(name)


CHECKED = _history(T1, T2, "h.nation IS DISTINCT FROM v2.nation", "")


@query(f"SELECT * REPLACE (coalesce(valid_to, TIMESTAMP '9999-12-31') AS valid_to) FROM ({CHECKED})")
def scd_sentinel(t):
    """Current versions end at a far date instead of null."""
    rule = scd.Scd2(["c_custkey"], scd.Check(["nation"]), valid_to_current="9999-12-31 00:00:00")
    return scd.scd2_step(scd.scd2_init(version_1(t), rule, NOW1), version_2(t), rule, NOW2)


@query(f"SELECT * EXCLUDE (valid_from, valid_to, scd_id), valid_from AS seen_from, valid_to AS seen_until, scd_id AS version FROM ({CHECKED})")
def scd_names(t):
    names = {"valid_from": "seen_from", "valid_to": "seen_until", "scd_id": "version"}
    rule = scd.Scd2(["c_custkey"], scd.Check(["nation"]), names=names)
    return scd.scd2_step(scd.scd2_init(version_1(t), rule, NOW1), version_2(t), rule, NOW2)


@query(f"SELECT * REPLACE (md5(c_custkey || '|' || c_name || '|' || CAST(updated_at AS VARCHAR)) AS scd_id) FROM ({CHECKED})")
def scd_composite(t):
    """A key of two columns, staged and applied one after the other."""
    rule = scd.Scd2(["c_custkey", "c_name"], scd.Check(["nation"]))
    first = scd.scd2_init(version_1(t), rule, NOW1)
    return scd.scd2_apply(first, scd.scd2_stage(first, version_2(t), rule, NOW2), rule)


@query(f"SELECT x.*, CASE WHEN x.updated_at = {T2} THEN c_mktsegment END AS segment FROM ({CHECKED}) x JOIN customer USING (c_custkey)")
def scd_new_column(t):
    """A column that the history lacks is added, null in old versions."""
    rule = scd.Scd2(["c_custkey"], scd.Check(["nation"]))
    wider = version_2(t).join(t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment")), "c_custkey")
    return scd.scd2_step(scd.scd2_init(version_1(t), rule, NOW1), wider, rule, NOW2)


@query(f"""
WITH v1 AS (SELECT * REPLACE (CAST(changed AS DATE) AS changed), CAST(changed AS TIMESTAMP) AS midnight FROM ({V1}))
SELECT c_custkey, c_name, nation, changed, md5(CAST(c_custkey AS VARCHAR) || '|' || CAST(midnight AS VARCHAR)) AS scd_id,
  midnight AS updated_at, midnight AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to FROM v1""")
def scd_date_times(t):
    """Dates as times of change: a warning, and times at midnight."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return scd.scd2_init(version_1(t).withColumn("changed", F.col("changed").cast("date")), scd.Scd2(["c_custkey"], scd.Timestamp("changed")), NOW1)


BY_STATUS = "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status"


@query(f"""
SELECT o_orderkey, o_totalprice * CASE WHEN o_orderkey % 4 = 1 THEN 2 ELSE 1 END AS o_totalprice, CASE WHEN o_orderkey % 4 = 1 THEN 'moved' ELSE status END AS status
FROM (SELECT *, {BY_STATUS} FROM orders) UNION ALL SELECT -o_orderkey, o_totalprice, NULL FROM orders WHERE o_orderkey % 50 = 10""")
def inc_build_null_partition(t):
    """A merge into a table with a null partition: rows move to another partition, others are added to the null one, which keeps its own."""
    name = scratch(t, "orders")
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")
    rows = t.orders.select("o_orderkey", "o_totalprice", status)
    inc.build_incremental(t.spark, name, rows, "merge", "o_orderkey", partition_by=["status"])
    moved = rows.where("o_orderkey % 4 = 1").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit("moved").alias("status"))
    more = t.orders.where("o_orderkey % 50 = 10").select((-F.col("o_orderkey")).alias("o_orderkey"), "o_totalprice", F.lit(None).cast("string").alias("status"))
    return inc.build_incremental(t.spark, name, moved.union(more), "merge", "o_orderkey")


@query("""
SELECT event_id, user_id, value, event_type FROM events WHERE event_type <> 'click' OR user_id % 5 <> 0
UNION ALL SELECT -event_id, user_id, 0.5, 'click' FROM events WHERE event_type = 'click' AND user_id % 5 = 0 AND event_id % 2 = 0""")
def inc_build_delete_insert(t):
    """delete+insert by user within clicks: the partition of clicks is written again, the others are not read but for their keys."""
    name, rows = scratch(t, "events"), t.events.select("event_id", "user_id", "value", "event_type")
    inc.build_incremental(t.spark, name, rows, partition_by=["event_type"])
    again = rows.where("event_type = 'click' and user_id % 5 = 0 and event_id % 2 = 0")
    gone = rows.where("event_type = 'click' and user_id % 5 = 0").select("user_id", "event_type").distinct()
    again = gone.join(again.select("user_id", "event_type", (-F.col("event_id")).alias("event_id"), F.lit(0.5).alias("value")), ["user_id", "event_type"], "left")
    inc.build_incremental(t.spark, name, again.select(*rows.columns), "delete+insert", ["user_id", "event_type"])
    return t.spark.table(name).where("event_id is not null")


SPLIT = _history(T1, T2, "h.nation IS DISTINCT FROM v2.nation", GONE)


@query(f"SELECT *, valid_to IS NULL AS is_open FROM ({SPLIT})")
def scd_partitioned(t):
    """A history whose current and ended versions are stored apart; the third run changes nothing."""
    name, rule = scratch(t, "customers"), scd.Scd2(["c_custkey"], scd.Check(["nation"]), hard_deletes="invalidate")
    for rows, now in ((version_1(t), NOW1), (version_2(t), NOW2), (version_2(t), NOW3)):
        scd.snapshot_table(t.spark, name, rows, rule, now, split="is_open")
    return t.spark.table(name)


@query("""
SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, max(ts) AS latest, round(avg(value), 6) AS mean, bool_or(value > 400) AS high
FROM events WHERE event_type NOT IN ('view') GROUP BY 1""")
def snk_view_refresh(t):
    """A view over a table whose partitions come, change and go: a refresh reads those that did."""
    src, name = scratch(t, "events"), scratch(t, "users")
    rows = t.events.select("user_id", "value", "ts", (F.col("value") > 400).alias("over"), "event_type")
    tables.build_table(t.spark, src, rows.where("event_type = 'view' or event_id % 2 = 0"), partition_by=["event_type"])
    measures = {"n": ("count", "*"), "total": ("sum", "value"), "latest": ("max", "ts"), "mean": ("avg", "value"), "high": ("bool_or", "over")}
    view = views.AggregateView(src, ["user_id"], measures)
    views.refresh(t.spark, name, view)
    tables.append(t.spark, src, rows.where("event_type <> 'view' and event_id % 2 = 1"))
    tables.drop_partition(t.spark, src, {"event_type": "view"})
    views.refresh(t.spark, name, view)
    return t.spark.table(name).select("user_id", "n", F.round("total", 4).alias("total"), "latest", F.round("mean", 6).alias("mean"), "high")


@query("SELECT user_id, max(ts) AS latest FROM events GROUP BY 1")
def evt_stream_latest(t):
    """Events in three files, in no order of time, streamed one file at a time: the latest of each user stands in the table."""
    path, name = exported(t, "stream"), scratch(t, "latest")
    rows = t.events.select("user_id", "ts", "event_id")
    rows.repartition(3, F.pmod(F.xxhash64("event_id"), F.lit(3))).write.parquet(path)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    ev.merge_stream(stream, name, "user_id", f"{path}-checkpoint", event_time="ts").awaitTermination()
    t.spark.catalog.refreshTable(name)
    return t.spark.table(name).select("user_id", F.col("ts").alias("latest"))

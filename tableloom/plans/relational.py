"""Projections, filters, joins, aggregates, windows and set operations over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import collections as fc
from ..functions import scalar as fs
from ..sources.relations import lookup_rows
from .base import query


@query("SELECT c_custkey AS customer_id, c_name AS name, 'retail' AS channel, c_acctbal AS balance FROM customer")
def rel_rename(t):
    return t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.lit("retail").alias("channel"), F.col("c_acctbal").alias("balance"))


@query("SELECT l_orderkey, l_linenumber, l_quantity / 100.0 AS hundreds, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def rel_arithmetic(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 100.0).alias("hundreds"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("SELECT event_id, ts, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND event_type <> 'view'")
def rel_filter(t):
    return t.events.where("ts >= timestamp_ntz '2024-01-05' and ts < timestamp_ntz '2024-01-12' and event_type <> 'view'").select("event_id", "ts", "user_id")


@query("SELECT * EXCLUDE (props) FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def rel_except_column(t, development: bool = True):
    rows = t.events.where("ts >= timestamp_ntz '2024-01-20'") if development else t.events
    return rows.drop("props")


BUCKETS = [(None, 10, "low"), (10, 50, "middle"), (50, 200, "high"), (200, None, "top")]


@query("""
SELECT bucket, count(*) AS n FROM (
  SELECT CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'middle' WHEN value < 200 THEN 'high' WHEN value >= 200 THEN 'top' END AS bucket FROM events)
GROUP BY bucket""")
def rel_buckets(t):
    return t.events.groupBy(fs.bucketize("value", BUCKETS).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def rel_daily(t):
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""
WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1),
big AS (SELECT * FROM spent WHERE s > 100000)
SELECT c_custkey, c_name, round(coalesce(s, 0), 2) AS spent FROM customer LEFT JOIN big ON o_custkey = c_custkey""")
def rel_composed(t):
    spent = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    big = spent.where("s > 100000")
    return t.customer.join(big, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", F.round(F.coalesce("s", F.lit(0.0)), 2).alias("spent"))


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def join_inner(t):
    orders = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return orders.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_left(t):
    n = t.orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n_orders"))
    return t.customer.join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_anti(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def join_semi(t):
    return t.part.join(t.lineitem.where("l_quantity >= 49"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_partkey", "p_name")


@query("""
SELECT a.doc_id, b.quality FROM (SELECT doc_id, nullif(n_chars % 7, 0) AS k FROM documents) a
JOIN (SELECT doc_id, quality, nullif(doc_id % 7, 0) AS k2 FROM labels) b ON a.doc_id = b.doc_id AND a.k IS NOT DISTINCT FROM b.k2""")
def join_composite_null_safe(t):
    a = t.documents.select("doc_id", F.nullif(F.col("n_chars") % 7, F.lit(0)).alias("k"))
    b = t.labels.select(F.col("doc_id").alias("id2"), "quality", F.nullif(F.col("doc_id") % 7, F.lit(0)).alias("k2"))
    return a.join(b, (F.col("doc_id") == F.col("id2")) & fs.equals("k", "k2", null_safe=True)).select("doc_id", "quality")


@query("""
SELECT c_custkey, coalesce(label, 'other') AS label FROM customer
LEFT JOIN (VALUES ('BUILDING', 'b2b'), ('MACHINERY', 'b2b'), ('HOUSEHOLD', 'b2c')) AS m(segment, label) ON c_mktsegment = segment""")
def join_broadcast(t):
    labels = lookup_rows(t.spark, [("BUILDING", "b2b"), ("MACHINERY", "b2b"), ("HOUSEHOLD", "b2c")], "segment string, label string")
    return t.customer.join(F.broadcast(labels), F.col("c_mktsegment") == F.col("segment"), "left").select("c_custkey", F.coalesce("label", F.lit("other")).alias("label"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS avg_discount,
       min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1, 2""")
def agg_basic(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("avg_discount"),
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
    )


@query("SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def agg_distinct(t):
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("user_id").alias("users"))


@query("""
SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) FILTER (event_type = 'view') AS n_view
FROM events GROUP BY 1""")
def agg_pivot(t):
    return t.events.groupBy("user_id").agg(*fc.count_each("event_type", ["click", "purchase", "view"], "n_"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 30")
def agg_having(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).where("n > 30")


@query("""
SELECT user_id, CASE WHEN sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) > 0
  THEN round(CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS DOUBLE) / sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END), 4) ELSE 0.0 END AS ratio
FROM events GROUP BY 1""")
def agg_guarded_ratio(t):
    n = t.events.groupBy("user_id").agg(*fc.count_each("event_type", ["click", "view"]))
    return n.select("user_id", fs.safe_ratio("click", "view").alias("ratio"))


@query("SELECT o_custkey, min(o_orderpriority) AS some_priority FROM orders GROUP BY 1")
def agg_any(t):
    return t.orders.groupBy("o_custkey").agg(fc.any_value("o_orderpriority").alias("some_priority"))


@query("SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned FROM lineitem GROUP BY 1")
def agg_bool_or(t):
    return t.lineitem.groupBy("l_orderkey").agg(fc.bool_or(F.col("l_returnflag") == "R").alias("any_returned"))


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def agg_listagg(t):
    return t.orders.groupBy("o_custkey").agg(fc.listagg("o_orderkey", "|").alias("orders"))


@query("""
SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS first_orders
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 3 GROUP BY 1""")
def agg_listagg_limit(t):
    return fc.listagg_first(t.orders, ["o_custkey"], "o_orderkey", 3, name="first_orders")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def win_dedupe(t):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    # one row for each key: a minimum of structs aggregates before the shuffle, a window would not
    return t.lineitem.groupBy("l_orderkey").agg(F.min(order).alias("first")).select("l_orderkey", "first.*")


@query("""
SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS nth FROM orders""")
def win_row_number(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", "o_custkey", F.row_number().over(w).alias("nth"))


@query("SELECT c_nationkey AS k, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def set_union_all(t):
    return t.customer.select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("kind")).unionByName(t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("k")))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_except(t):
    return t.part.select(F.col("p_partkey").alias("k")).subtract(t.lineitem.where("l_quantity > 45").select("l_partkey"))


@query("SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_intersect(t):
    return t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("k")).intersect(t.customer.where("c_acctbal > 0").select("c_custkey"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def set_distinct(t):
    return t.lineitem.select("l_partkey", "l_suppkey").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def srt_top(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1 ORDER BY 2 DESC")
def srt_order(t):
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")).orderBy(F.desc("n"))

"""End-to-end models made of the operators, over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import collections as fc
from ..functions import scalar as fs
from ..operators.incremental import after_high_water, merge_rows
from ..sources.relations import lookup_rows
from .base import query


@query("""
SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, coalesce(amount, 0.0) AS amount
FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS amount FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def pip_orders(t):
    paid = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("amount"))
    return t.orders.join(paid, "o_orderkey", "left").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", F.coalesce("amount", F.lit(0.0)).alias("amount"))


@query("""
SELECT c_custkey, c_name, first_order, last_order, n_orders, coalesce(spent, 0.0) AS lifetime_value FROM customer LEFT JOIN (
  SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent
  FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def pip_customers(t):
    by = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"), F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent")
    )
    return t.customer.join(by, "c_custkey", "left").select("c_custkey", "c_name", "first_order", "last_order", "n_orders", F.coalesce("spent", F.lit(0.0)).alias("lifetime_value"))


@query("SELECT l_orderkey AS order_id, l_linenumber AS line, 'line' AS kind, l_extendedprice / 100.0 AS amount, l_shipdate AS shipped_at FROM lineitem")
def pip_staging(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.lit("line").alias("kind"), (F.col("l_extendedprice") / 100.0).alias("amount"), F.col("l_shipdate").alias("shipped_at")
    )


@query("SELECT c_custkey AS customer_id, c_name AS name, c_nationkey AS nation_id FROM customer")
def pip_staging_customers(t):
    return t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation_id"))


@query("SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS ordered_at, o_orderstatus AS status FROM orders")
def pip_staging_orders(t):
    return t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("ordered_at"), F.col("o_orderstatus").alias("status"))


def daily_summary(events):
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), fs.safe_round(F.avg("value"), 7).alias("avg_value")
    )


@query("""
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 7) AS avg_value
FROM events GROUP BY 1, 2""")
def pip_incremental_daily(t):
    """The summary of the days before the 15th, then a merge of what lies above its high-water mark."""
    events = t.events
    stored = daily_summary(events.where("ts < timestamp_ntz '2024-01-15'"))
    dated = events.withColumn("day", F.to_date("ts"))
    batch = daily_summary(after_high_water(dated, "day", stored, "day", "1970-01-01").drop("day"))
    return merge_rows(stored, batch, ["day", "event_type"], check=False)


@query("""
SELECT bucket, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase
FROM (SELECT event_type, CASE WHEN value < 20 THEN 'short' WHEN value < 100 THEN 'medium' ELSE 'long' END AS bucket FROM events WHERE value IS NOT NULL) GROUP BY 1""")
def pip_pivot(t):
    sized = t.events.where("value is not null").withColumn("bucket", fs.bucketize("value", [(None, 20, "short"), (20, 100, "medium"), (100, None, "long")]))
    return sized.groupBy("bucket").agg(*fc.count_each("event_type", ["click", "view", "purchase"]))


@query("""
WITH m AS (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(15, 2))) AS DOUBLE) / count(*) AS avg_price FROM orders GROUP BY 1)
SELECT printf('%05d', c_custkey) AS customer, c_name, n, avg_price, 'run-1' AS run_id FROM customer JOIN m ON o_custkey = c_custkey WHERE n >= 5""")
def pip_active(t):
    # prices summed as decimals: a sum of doubles depends on its order
    total = F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("double")
    metrics = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), (total / F.count(F.lit(1))).alias("avg_price"))
    active = t.customer.join(metrics, F.col("o_custkey") == F.col("c_custkey")).where("n >= 5")
    return fs.audit_columns(active.select(fs.format_id("c_custkey").alias("customer"), "c_name", "n", "avg_price"), "run-1", "2024-01-01").drop("run_started_at")


@query("""
SELECT coalesce(label, 'unknown') AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS largest
FROM orders LEFT JOIN (VALUES ('F', 'fulfilled'), ('O', 'open')) AS m(code, label) ON o_orderstatus = code GROUP BY 1""")
def pip_status_summary(t):
    labels = lookup_rows(t.spark, [("F", "fulfilled"), ("O", "open")], "code string, label string")
    named = t.orders.join(F.broadcast(labels), F.col("o_orderstatus") == F.col("code"), "left")
    return named.groupBy(F.coalesce("label", F.lit("unknown")).alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_totalprice").alias("largest")
    )


@query("""
WITH s AS (SELECT l_suppkey, count(*) AS lines, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1)
SELECT s_suppkey, s_name, n_name, coalesce(lines, 0) AS lines, coalesce(revenue, 0.0) AS revenue FROM supplier
LEFT JOIN s ON l_suppkey = s_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey ORDER BY revenue DESC, s_suppkey LIMIT 50""")
def pip_dashboard(t):
    by = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    rows = t.supplier.join(by, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    rows = rows.select("s_suppkey", "s_name", "n_name", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("revenue", F.lit(0.0)).alias("revenue"))
    return rows.orderBy(F.desc("revenue"), "s_suppkey").limit(50)


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS bought FROM events GROUP BY 1),
u AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS users FROM events GROUP BY 1)
SELECT d.day, n, users, round(bought / CAST(nullif(users, 0) AS DOUBLE), 4) AS bought_per_user FROM d JOIN u ON d.day = u.day""")
def pip_daily_ratio(t):
    d = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("bought"), F.countDistinct("user_id").alias("users"))
    return d.select("day", "n", "users", fs.safe_round(F.col("bought") / F.nullif("users", F.lit(0)), 4).alias("bought_per_user"))


@query("""
WITH i AS (SELECT l_partkey, count(*) AS impressions, count(*) FILTER (l_returnflag = 'R') AS clicks FROM lineitem GROUP BY 1)
SELECT p_partkey, p_brand, coalesce(impressions, 0) AS impressions, coalesce(clicks, 0) AS clicks,
  CASE WHEN coalesce(impressions, 0) > 0 THEN round(CAST(clicks AS DOUBLE) / impressions, 4) ELSE 0.0 END AS rate
FROM part LEFT JOIN i ON l_partkey = p_partkey""")
def pip_campaign(t):
    i = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("impressions"), F.count_if(F.col("l_returnflag") == "R").alias("clicks"))
    rows = t.part.join(i, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", "p_brand", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("impressions", "clicks")])
    return rows.withColumn("rate", fs.safe_ratio("clicks", "impressions"))


@query("SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS active_users FROM events GROUP BY 1")
def pip_daily_active(t):
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("user_id").alias("active_users"))


@query("""
SELECT c_custkey, c_name, coalesce(n, 0) AS n_events, last_seen FROM customer
LEFT JOIN (SELECT user_id, count(*) AS n, max(ts) AS last_seen FROM events GROUP BY 1) ON user_id = c_custkey""")
def pip_user_activity(t):
    by = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_seen"))
    return t.customer.join(by, F.col("user_id") == F.col("c_custkey"), "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_events"), "last_seen")


@query("""
SELECT c_custkey, n, CASE WHEN n < 5 THEN 'low' WHEN n < 12 THEN 'medium' ELSE 'high' END AS tier FROM (
  SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) ORDER BY n DESC""")
def pip_tiers(t):
    by = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    n = t.customer.join(by, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("k", F.lit(0)).alias("n"))
    return n.withColumn("tier", fs.bucketize("n", [(None, 5, "low"), (5, 12, "medium"), (12, None, "high")])).orderBy(F.desc("n"))


@query("SELECT count(*) AS customer_count FROM customer")
def pip_row_count(t):
    return t.customer.agg(F.count(F.lit(1)).alias("customer_count"))


@query("""
SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def pip_nation_totals(t):
    # totals by customer first: the join then moves a row for each customer, not for each order
    by = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    named = by.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return named.groupBy("n_name").agg(F.sum("n").alias("n_orders"), F.round(F.sum("s"), 2).alias("total"))

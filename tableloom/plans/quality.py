"""Checks, comparisons, freshness, contracts, lineage and run records over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as ck
from ..operators import compare, freshness, lineage, metadata, runs
from .base import query


def labelled(t):
    return t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")


LABELLED = "documents LEFT JOIN labels USING (doc_id)"


@query(f"SELECT doc_id, lang, source, quality, toxic FROM {LABELLED} WHERE quality IS NULL")
def chk_not_null(t):
    return ck.not_null(labelled(t), "quality")


@query("SELECT l_orderkey * 10 + l_linenumber AS unique_field, count(*) AS n_records FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def chk_unique(t):
    return ck.unique(t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id")), "line_id")


@query("SELECT event_type AS value_field, count(*) AS n_records FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def chk_accepted_values(t):
    return ck.accepted_values(t.events, "event_type", ["click", "view"])


@query("SELECT o_custkey AS from_field FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)")
def chk_relationships(t):
    return ck.relationships(t.orders, "o_custkey", t.customer.where("c_custkey % 5 <> 0"), "c_custkey")


@query(f"""
SELECT * FROM (SELECT 'lang' AS column_name, lang AS unique_field, count(*) AS n_records FROM documents GROUP BY lang
UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), count(*) FROM {LABELLED} WHERE quality IS NOT NULL GROUP BY quality
UNION ALL SELECT 'doc_id', CAST(doc_id AS VARCHAR), count(*) FROM documents GROUP BY doc_id) WHERE n_records > 1 AND unique_field IS NOT NULL""")
def chk_agg_unique(t):
    return ck.aggregated_unique(labelled(t), ["doc_id", "lang", "source", "quality"], skip=["source"])


@query(f"""
SELECT 'quality' AS column_name FROM {LABELLED} WHERE quality IS NULL UNION ALL SELECT 'toxic' FROM {LABELLED} WHERE toxic IS NULL
UNION ALL SELECT 'lang' FROM documents WHERE lang IS NULL""")
def chk_agg_not_null(t):
    return ck.aggregated_not_null(labelled(t), ["quality", "toxic", "lang", "source"], skip=["source"])


@query(f"""
SELECT column_name, n AS failures, n <> 0 AS should_warn, n > 1000000 AS should_error FROM (
  SELECT 'quality' AS column_name, count(*) AS n FROM {LABELLED} WHERE quality IS NULL
  UNION ALL SELECT 'toxic', count(*) FROM {LABELLED} WHERE toxic IS NULL) WHERE n > 0""")
def chk_agg_verdict(t):
    return ck.aggregated_verdict(ck.aggregated_not_null(labelled(t), ["quality", "toxic", "lang"]), error_if="> 1000000")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity <= 3")
def chk_greater_than(t):
    return ck.greater_than(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 3)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def chk_positive(t):
    return ck.is_positive(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal")


@query("SELECT count(*) AS n_records FROM events WHERE event_type = 'refund' HAVING count(*) = 0")
def chk_not_empty(t):
    return ck.not_empty(t.events.where("event_type = 'refund'"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def chk_singular(t):
    return ck.singular(t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey"))


@query("SELECT least(50, count(*)) AS failures, count(*) > 0 AS should_warn, least(50, count(*)) > 10 AS should_error FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_discount > 0.05")
def chk_where_limit(t):
    recent = ck.where(t.lineitem, "l_shipdate >= timestamp_ntz '1996-01-01'")
    return ck.verdict(recent.where("l_discount > 0.05"), error_if="> 10", limit=50)


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS failures, sum(l_linenumber) > 5 AS should_warn, sum(l_linenumber) > 1000000000 AS should_error FROM lineitem WHERE l_discount = 0")
def chk_verdict(t):
    return ck.verdict(t.lineitem.where("l_discount = 0"), fail_calc="sum(l_linenumber)", warn_if="> 5", error_if="> 1000000000")


@query(f"""
SELECT 'not_null' AS "check", 'documents' AS "table", 'quality' AS "column", count(*) AS failures, CASE WHEN count(*) > 0 THEN 'warn' ELSE 'pass' END AS status FROM {LABELLED} WHERE quality IS NULL
UNION ALL SELECT 'is_positive', 'documents', 'doc_id', least(7, count(*)), CASE WHEN least(7, count(*)) > 5 THEN 'error' WHEN count(*) > 0 THEN 'warn' ELSE 'pass' END FROM documents WHERE doc_id < 10
UNION ALL SELECT 'unique', 'orders', 'o_orderkey', count(*), CASE WHEN count(*) > 0 THEN 'error' ELSE 'pass' END FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'accepted_values', 'events', 'event_type', count(*), CASE WHEN count(*) > 0 THEN 'error' ELSE 'pass' END FROM (SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click'))""")
def chk_report(t):
    docs = labelled(t)
    return ck.run_checks([
        ck.Check("not_null", "documents", column="quality", severity="warn", rows=docs, bad="quality is null"),
        ck.Check("is_positive", "documents", column="doc_id", rows=docs, bad="doc_id < 10", error_if="> 5", limit=7),
        ck.Check("unique", "orders", ck.unique(t.orders, "o_orderkey"), "o_orderkey"),
        ck.Check("accepted_values", "events", ck.accepted_values(t.events, "event_type", ["click"]), "event_type"),
    ])


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus"]


@query("""
WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 7 = 0),
u AS (SELECT *, 1 AS s FROM a UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, -1 FROM orders)
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(sum(s) AS BIGINT) AS surplus FROM u GROUP BY 1, 2, 3 HAVING sum(s) <> 0""")
def cmp_multiset(t):
    orders = t.orders.select(*ORDER_COLUMNS)
    return compare.multiset_diff(orders.where("o_orderkey % 10 <> 0").union(orders.where("o_orderkey % 7 = 0")), orders)


@query("""
WITH k AS (SELECT 'order-' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-line-' || l_linenumber AS name FROM lineitem
  UNION ALL SELECT 'order-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '-line-1' FROM orders WHERE o_orderkey % 97 = 3)
SELECT name AS unique_field, count(*) AS n_records FROM k GROUP BY 1 HAVING count(*) > 1""")
def chk_unique_by_hash(t):
    """Wide keys: their hashes are packed and shuffled, and of the keys themselves only those that repeat."""
    name = lambda order, line: F.concat(F.lit("order-"), F.lpad(F.col(order).cast("string"), 12, "0"), F.lit("-line-"), line.cast("string")).alias("name")
    keys = t.lineitem.select(name("l_orderkey", F.col("l_linenumber"))).union(t.orders.where("o_orderkey % 97 = 3").select(name("o_orderkey", F.lit(1))))
    return ck.unique(keys, "name", by_hash=True)


@query("""
WITH a AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 1000 = 7 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders),
u AS (SELECT *, 1 AS s FROM a UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, -1 FROM orders)
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(sum(s) AS BIGINT) AS surplus FROM u GROUP BY 1, 2, 3 HAVING sum(s) <> 0""")
def cmp_bucketed(t):
    """Checksums of buckets find where two large tables differ; the rest of their rows stay where they are."""
    orders = t.orders.select(*ORDER_COLUMNS)
    return compare.bucketed_diff(orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 1000 != 7, F.col("o_orderstatus"))), orders)


@query("""
SELECT CAST(count(*) FILTER (o_orderkey % 10 = 0) AS BIGINT) AS failures, count(*) FILTER (o_orderkey % 10 = 0) = 0 AS passed FROM orders""")
def cmp_verdict(t):
    orders = t.orders.select(*ORDER_COLUMNS)
    return compare.comparison(compare.multiset_diff(orders.where("o_orderkey % 10 <> 0"), orders))


@query("""
SELECT c_custkey, c_name, 'actual' AS actual_or_expected FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, 'expected' FROM customer""")
def cmp_label_union(t):
    return compare.label_union(t.customer.where("c_custkey % 2 = 0"), t.customer.select("c_custkey", "c_name"))


@query("""
SELECT event_type, max(ts) AS max_loaded_at, TIMESTAMP '2024-01-31 06:00:00' AS snapshotted_at,
  date_diff('microsecond', max(ts), TIMESTAMP '2024-01-31 06:00:00') / 1000000.0 AS age_seconds,
  CASE WHEN date_diff('microsecond', max(ts), TIMESTAMP '2024-01-31 06:00:00') / 1000000.0 > 10 * 86400 THEN 'error'
       WHEN date_diff('microsecond', max(ts), TIMESTAMP '2024-01-31 06:00:00') / 1000000.0 > 6 * 3600 THEN 'warn' ELSE 'pass' END AS status
FROM events WHERE value IS NOT NULL GROUP BY 1""")
def frs_eval(t):
    collected = freshness.collect_freshness(t.events, "ts", "2024-01-31 06:00:00", "value is not null", by=("event_type",))
    return freshness.evaluate_freshness(collected, freshness.Limit(6, "hour"), freshness.Limit(10, "day"))


@query("""
SELECT max(o_orderdate) AS max_loaded_at, TIMESTAMP '2030-01-01' AS snapshotted_at,
  date_diff('microsecond', max(o_orderdate), TIMESTAMP '2030-01-01') / 1000000.0 AS age_seconds, 'error' AS status FROM orders""")
def frs_text_times(t):
    texts = t.orders.select(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("+00")).alias("loaded_at"))
    return freshness.evaluate_freshness(freshness.collect_freshness(texts, "loaded_at", "2030-01-01 00:00:00"), error_after=freshness.Limit(1, "day"))


@query("""
SELECT 'customer' AS relation, c.column, CAST(c.position AS INT) AS position, n AS n_rows, c.k AS n_values FROM (
  SELECT count(*) AS n, unnest([{'column': 'c_custkey', 'position': 1, 'k': count(c_custkey)}, {'column': 'c_name', 'position': 2, 'k': count(c_name)},
    {'column': 'c_nationkey', 'position': 3, 'k': count(c_nationkey)}, {'column': 'c_acctbal', 'position': 4, 'k': count(c_acctbal)},
    {'column': 'c_mktsegment', 'position': 5, 'k': count(c_mktsegment)}]) AS c FROM customer)
UNION ALL SELECT 'labels', c.column, CAST(c.position AS INT), n, c.k FROM (
  SELECT count(*) AS n, unnest([{'column': 'doc_id', 'position': 1, 'k': count(doc_id)}, {'column': 'quality', 'position': 2, 'k': count(quality)},
    {'column': 'toxic', 'position': 3, 'k': count(toxic)}]) AS c FROM labels)""")
def met_profile(t):
    return metadata.column_profile({"customer": t.customer, "labels": t.labels})


@query("SELECT c_name AS name, c_custkey AS id, c_acctbal AS balance FROM customer")
def met_contract(t):
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))
    return metadata.apply_contract(rows, {"name": "string", "id": "bigint", "balance": "double"})


def edges(t):
    """Region to nation to customer to order, as text ids."""
    def pair(df, a, b, ka, kb):
        return df.select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("src"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("dst"))

    return pair(t.nation, "r", "n", "n_regionkey", "n_nationkey").union(pair(t.customer, "n", "c", "c_nationkey", "c_custkey")).union(pair(t.orders, "c", "o", "o_custkey", "o_orderkey"))


EDGES = """edges AS (
SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


@query(f"""
WITH RECURSIVE {EDGES}, walk(node, depth) AS (SELECT 'r1', 0 UNION ALL SELECT dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 3)
SELECT node, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY 1""")
def lin_reach(t):
    e = edges(t)
    return lineage.reach(e, e.where("src = 'r1'").select(F.col("src").alias("node")), "down", 3)


@query(f"""
WITH {EDGES} SELECT DISTINCT node FROM (
  SELECT dst AS node FROM edges WHERE dst = 'c10' UNION SELECT src FROM edges WHERE dst = 'c10' UNION SELECT dst FROM edges WHERE src = 'c10')""")
def lin_neighbours(t):
    e = edges(t)
    return lineage.neighbours(e, e.where("dst = 'c10'").select(F.col("dst").alias("node")).distinct())


@query("""
WITH cur AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS body, md5(coalesce(text, '') || CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE '' END) AS checksum FROM documents),
prev AS (SELECT doc_id, text AS body, md5(coalesce(text, '')) AS checksum FROM documents WHERE doc_id % 11 <> 0)
SELECT c.doc_id, p.doc_id IS NULL AS is_new,
  p.doc_id IS NULL OR CASE WHEN c.body IS NOT NULL AND p.body IS NOT NULL THEN c.body <> p.body ELSE coalesce(c.checksum <> p.checksum, true) END AS is_modified
FROM cur c LEFT JOIN prev p ON c.doc_id = p.doc_id""")
def dif_changes(t):
    docs = t.documents.select("doc_id", F.col("text").alias("body"), F.md5(F.coalesce("text", F.lit(""))).alias("checksum"))
    body = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    mark = F.when(F.col("doc_id") % 10 == 0, "x").otherwise("")
    current = t.documents.select("doc_id", body.alias("body"), F.md5(F.concat(F.coalesce("text", F.lit("")), mark)).alias("checksum"))
    return lineage.change_set(docs.where("doc_id % 11 <> 0"), current, "doc_id", "body", "checksum")


def results(t):
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "skipped").otherwise("success")
    return t.events.select(F.concat(F.lit("model."), F.col("event_id").cast("string")).alias("unique_id"), status.alias("status"))


@query("""
SELECT count(*) FILTER (event_type NOT IN ('error', 'signup')) AS n_pass, count(*) FILTER (event_type = 'error') AS n_error,
  count(*) FILTER (event_type = 'signup') AS n_skip, count(*) AS n_total FROM events""")
def run_summary(t):
    return runs.run_summary(results(t))


@query("SELECT 'model.' || event_id AS unique_id FROM events WHERE event_type IN ('error', 'signup')")
def retry_set(t):
    return runs.retry_set(results(t))

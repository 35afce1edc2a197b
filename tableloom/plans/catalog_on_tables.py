"""Sources, seeds, fixtures, published tables and the catalog, over exports of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import compare, freshness, incremental, metadata, runs, tables, views
from ..session import SCRATCH, own_dir
from ..sources import fixtures, relations, seeds
from .base import query
from .quality import ORDER_COLUMNS


def scratch(t, kind: str) -> str:
    """A name of its own in the scratch schema."""
    tables.ensure_schema(t.spark, SCRATCH)
    return f"{SCRATCH}.{kind}_{uuid.uuid4().hex}"


def exported(t, kind: str) -> str:
    """A new folder in the shared one."""
    return f"{own_dir(t.spark)}/{kind}-{uuid.uuid4().hex}"


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_nationkey < 12 UNION ALL SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 40")
def src_ref(t):
    """A model by name, and one that is read where it stands as ours is not built."""
    mine, theirs, missing = scratch(t, "suppliers"), scratch(t, "their_parts"), scratch(t, "parts")
    tables.build_table(t.spark, mine, t.supplier.where("s_nationkey < 12").select("s_suppkey", "s_name", "s_nationkey"))
    tables.build_table(t.spark, theirs, t.part.where("p_size > 40").select("p_partkey", "p_name", "p_size"))
    found = relations.ref(t.spark, mine) if relations.relation_exists(t.spark, mine) else None
    return found.union(relations.read_with_fallback(t.spark, missing, theirs))


@query("SELECT c_custkey, c_name, c_acctbal, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS code FROM customer")
def src_seed(t):
    """Customers written as CSV and loaded as a seed, twice: codes keep their zeros, rows are not doubled."""
    path, name = exported(t, "seed"), scratch(t, "seed")
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal", F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("code"))
    rows.write.option("header", True).option("sep", ";").csv(path)
    kinds = {"c_custkey": "bigint", "c_name": "string", "c_acctbal": "double", "code": "string"}
    for refresh in (False, False, True):
        seeds.load_seed(t.spark, path, name, kinds, ";", refresh)
    return t.spark.table(name)


@query("""
SELECT n_nationkey, n_name, n_regionkey, count(c_custkey) AS n FROM (SELECT * FROM nation UNION ALL SELECT r_regionkey + 100, r_name, r_regionkey FROM region)
LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""")
def src_fixtures(t):
    """Nations as CSV text and regions as rows stand in for a table of nations, and meet the customers."""
    schema = t.nation.select("n_nationkey", "n_name", "n_regionkey").schema
    nations = t.nation.select("n_nationkey", "n_name", "n_regionkey").collect()  # 25 rows whatever the scale
    text = "n_nationkey,n_name,n_regionkey\n" + "\n".join(f"{r[0]},{r[1]},{r[2]}" for r in nations)
    rows = [{"N_NATIONKEY": r.r_regionkey + 100, "n_name": r.r_name, "n_regionkey": r.r_regionkey} for r in t.region.select("r_regionkey", "r_name").collect()]
    both = fixtures.fixture_csv(t.spark, text, schema).union(fixtures.fixture_rows(t.spark, rows, schema))
    return both.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_name", "n_regionkey").agg(F.count("c_custkey").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def src_fixture_sql(t):
    text = f"SELECT CAST(o_orderkey AS STRING) AS o_orderkey, CAST(o_totalprice AS STRING) AS o_totalprice FROM parquet.`{t.folder}/orders.parquet` WHERE o_orderstatus = 'F'"
    return fixtures.fixture_sql(t.spark, text, t.orders.select("o_orderkey", "o_totalprice").schema)


def run_rows(t):
    """Events dressed as results of runs."""
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "skipped").otherwise("success")
    return t.events.select(F.concat(F.lit("model."), F.col("event_id").cast("string")).alias("unique_id"), status.alias("status"), F.coalesce("value", F.lit(-1.0)).alias("execution_time"))


RUNS = """
SELECT 'model.' || event_id AS unique_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'skipped' ELSE 'success' END AS status,
  coalesce(value, -1.0) AS execution_time FROM events"""


@query(RUNS)
def run_read(t):
    """Results written as eight JSON documents and read back."""
    path = exported(t, "results")
    listed = run_rows(t).withColumn("part", F.pmod(F.xxhash64("unique_id"), F.lit(8))).groupBy("part").agg(F.collect_list(F.struct("unique_id", "status", "execution_time")).alias("results"))
    listed.write.partitionBy("part").json(path)
    return runs.read_run_results(t.spark, path).select("unique_id", "status", "execution_time")


@query(f"SELECT status, count(*) * 2 AS n, round(sum(greatest(execution_time, 0)) * 2, 4) AS seconds FROM ({RUNS}) GROUP BY 1")
def run_write(t):
    """The results of two runs kept in one table."""
    name = scratch(t, "results")
    for _ in range(2):
        runs.write_run_results(t.spark, name, run_rows(t))
    return t.spark.table(name).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.greatest("execution_time", F.lit(0.0))), 4).alias("seconds"))


@query("SELECT event_type, max(ts) AS max_loaded_at, TIMESTAMP '2024-02-01' AS snapshotted_at FROM events GROUP BY 1 UNION ALL SELECT 'all', max(ts), TIMESTAMP '2024-03-01' FROM events")
def frs_report(t):
    """Two collections, by column and by query, in one report table."""
    name = scratch(t, "freshness")
    freshness.write_freshness_report(t.spark, name, freshness.collect_freshness(t.events, "ts", "2024-02-01 00:00:00", by=("event_type",)))
    one = freshness.collect_freshness_query(t.spark, f"SELECT max(ts) FROM parquet.`{t.folder}/events.parquet`", "2024-03-01 00:00:00")
    freshness.write_freshness_report(t.spark, name, one.withColumn("event_type", F.lit("all")))
    return t.spark.table(name)


@query("SELECT c_nationkey, avg(c_acctbal) > 0 AS positive, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def snk_ephemeral(t):
    name = f"rich_{uuid.uuid4().hex}"
    tables.ephemeral(t.customer.where("c_acctbal > 0"), name)
    return t.spark.sql(f"SELECT c_nationkey, avg(c_acctbal) > 0 AS positive, count(*) AS n FROM {name} GROUP BY 1")


@query("SELECT event_id, value FROM events WHERE event_type = 'purchase'")
def snk_truncate(t):
    """Filled, emptied, and filled again with other rows."""
    name = scratch(t, "events")
    tables.build_table(t.spark, name, t.events.where("event_type = 'click'").select("event_id", "value"))
    tables.truncate(t.spark, name)
    tables.append(t.spark, name, t.events.where("event_type = 'purchase'").select("event_id", "value"))
    return t.spark.table(name)


@query("""
SELECT c.column, c.comment, c.k AS n_values FROM (SELECT unnest([{'column': 'n_nationkey', 'comment': 'the key', 'k': count(n_nationkey)}, {'column': 'n_name', 'comment': 'it''s a name', 'k': count(n_name)},
  {'column': 'n_regionkey', 'comment': NULL, 'k': count(n_regionkey)}]) AS c FROM nation)""")
def snk_docs(t):
    """Comments on a table's columns, beside the counts of their values; they outlive a rebuild."""
    name, rows = scratch(t, "nation"), t.nation.select("n_nationkey", "n_name", "n_regionkey")
    tables.build_table(t.spark, name, rows)
    tables.persist_docs(t.spark, name, "nations", {"n_nationkey": "the key", "n_name": "it's a name", "none": "x"})
    tables.build_table(t.spark, name, rows, like=tables.layout_of(t.spark, name))
    told = t.spark.createDataFrame([(c.name, c.description) for c in t.spark.catalog.listColumns(name)], "column string, comment string")
    return metadata.column_profile({"nation": t.spark.table(name)}).join(told, "column").select("column", "comment", "n_values")


@query("SELECT 'orders_f' AS name, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'orders_p', count(*) FROM orders WHERE o_orderstatus = 'P'")
def snk_schema(t):
    """A schema that comes and goes with its tables, of which one is dropped before."""
    schema = f"tableloom_{uuid.uuid4().hex}"
    tables.ensure_schema(t.spark, schema)
    tables.ensure_schema(t.spark, schema)
    for status in "FOP":
        tables.build_table(t.spark, f"{schema}.orders_{status.lower()}", t.orders.where(F.col("o_orderstatus") == status).select("o_orderkey"))
    tables.drop_relation(t.spark, f"{schema}.orders_o")
    counts = [(r.name, t.spark.table(f"{schema}.{r.name}").count()) for r in metadata.list_relations(t.spark, schema).collect()]
    tables.drop_schema(t.spark, schema)
    return t.spark.createDataFrame(counts, "name string, n long")


@query("""
SELECT 'orders_1996' AS name, 'table' AS type, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 UNION ALL SELECT 'orders_late', 'view', count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'""")
def met_relations(t):
    """The relations whose names are like a pattern, beside their numbers of rows."""
    schema = f"tableloom_{uuid.uuid4().hex}"
    tables.ensure_schema(t.spark, schema)
    tables.build_table(t.spark, f"{schema}.orders_1996", t.orders.where("year(o_orderdate) = 1996").select("o_orderkey"))
    tables.build_table(t.spark, f"{schema}.other", t.region.select("r_name"))
    tables.build_view(t.spark, f"{schema}.orders_late", f"SELECT o_orderkey FROM parquet.`{t.folder}/orders.parquet` WHERE o_orderdate >= timestamp_ntz '1997-01-01'")
    found = metadata.relations_like(t.spark, schema.upper(), "orders_%", exclude="%_old")
    counts = [(r.name, t.spark.table(f"{schema}.{r.name}").count()) for r in found.collect()]
    tables.drop_schema(t.spark, schema)
    return found.select("name", "type").join(t.spark.createDataFrame(counts, "name string, n long"), "name")


PROFILE = """
SELECT c.name, c.type, CAST(c.position AS INT) AS position, c.k AS n_values FROM (SELECT unnest([{'name': 's_suppkey', 'type': 'bigint', 'position': 1, 'k': count(s_suppkey)},
  {'name': 's_name', 'type': 'string', 'position': 2, 'k': count(s_name)}, {'name': 'balance', 'type': 'decimal(12,2)', 'position': 3, 'k': count(s_acctbal)}]) AS c FROM supplier)"""


def suppliers(t):
    return t.supplier.select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name", F.col("s_acctbal").cast("decimal(12,2)").alias("balance"))


@query(PROFILE)
def met_columns(t):
    """A stored table's columns from the catalog, beside counts of their values."""
    name = scratch(t, "supplier")
    tables.build_table(t.spark, name, suppliers(t))
    counts = metadata.column_profile({"s": t.spark.table(name)}).select(F.col("column").alias("name"), "n_values")
    return metadata.columns_of(t.spark, name).join(counts, "name").select("name", "type", "position", "n_values")


@query(PROFILE)
def met_query_schema(t):
    """The same of a query, before it runs."""
    rows = suppliers(t)
    kinds = t.spark.createDataFrame(metadata.query_schema(rows), metadata.COLUMNS)
    counts = metadata.column_profile({"s": rows}).select(F.col("column").alias("name"), "n_values")
    return kinds.join(counts, "name").select("name", "type", "position", "n_values")


@query("SELECT s_name, s_suppkey FROM supplier")
def met_empty(t):
    """Rows added to an empty relation of declared columns take its names, order and types."""
    return metadata.empty_with_schema(t.spark, {"s_name": "string", "s_suppkey": "bigint"}).unionByName(t.supplier.select("s_suppkey", "s_name"))


@query("""
SELECT * FROM (SELECT 'added' AS change, 'c_phone' AS name, NULL AS old_type, 'string' AS new_type, count(*) AS n FROM customer
UNION ALL SELECT 'removed', 'c_mktsegment', 'string', NULL, count(*) FROM customer UNION ALL SELECT 'retyped', 'c_name', 'string', 'int', count(*) FROM customer)""")
def met_changes(t):
    """What a batch of another schema changes, beside the rows that it touches."""
    old = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    new = t.customer.select("c_custkey", F.length("c_name").alias("c_name"), F.lit("x").alias("c_phone"))
    return metadata.schema_change_report(old, new).withColumn("n", new.agg(F.count(F.lit(1))).scalar())


@query("""
SELECT c.relation, 'table' AS relation_type, c.column, CAST(c.position AS INT) AS position, c.type, c.k AS n_values FROM (SELECT unnest([
  {'relation': 'region', 'column': 'r_regionkey', 'position': 1, 'type': 'bigint', 'k': count(r_regionkey)}, {'relation': 'region', 'column': 'r_name', 'position': 2, 'type': 'string', 'k': count(r_name)}]) AS c FROM region)
UNION ALL SELECT 'parts', 'table', 'p_partkey', 1, 'bigint', count(p_partkey) FROM part""")
def met_catalog(t):
    """The catalog of two tables, beside counts; a table that is not there is left out."""
    names = {"region": scratch(t, "region"), "parts": scratch(t, "parts")}
    tables.build_table(t.spark, names["region"], t.region.select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"), "r_name"))
    tables.build_table(t.spark, names["parts"], t.part.select(F.col("p_partkey").cast("bigint").alias("p_partkey")))
    report = metadata.catalog_report(t.spark, [*names.values(), scratch(t, "none")])
    counts = metadata.column_profile({n: t.spark.table(n) for n in names.values()}).select("relation", "column", "n_values")
    short = F.create_map(*[F.lit(x) for k, v in names.items() for x in (v, k)])
    return report.join(counts, ["relation", "column"]).select(short[F.col("relation")].alias("relation"), "relation_type", "column", "position", "type", "n_values")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
def met_preview(t):
    return metadata.preview(t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey"), 7)


@query("""
WITH d AS (SELECT o_orderkey, o_custkey, o_orderstatus, 1 AS s FROM orders WHERE o_orderkey % 10 = 3 UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, -1 FROM orders WHERE o_orderkey % 10 = 0),
n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey || ', ' || o_custkey || ', ' || o_orderstatus) AS r FROM d)
SELECT 'columns: o_orderkey, o_custkey, o_orderstatus' AS line
UNION ALL SELECT CASE s WHEN 1 THEN '+ actual   (x2): ' ELSE '- expected (x1): ' END || o_orderkey || ', ' || o_custkey || ', ' || o_orderstatus FROM n WHERE r <= 20
UNION ALL SELECT '... (more rows differ)' FROM n WHERE r = 21""")
def cmp_report(t):
    """The columns and the first twenty rows of a comparison, some there too often, twice, and some missing."""
    orders = t.orders.select(*ORDER_COLUMNS)
    more = orders.where("o_orderkey % 10 = 3")
    actual = orders.where("o_orderkey % 10 <> 0").union(more).union(more)
    return t.spark.createDataFrame([(x,) for x in compare.diff_report(compare.multiset_diff(actual, orders))], "line string")


@query("""
WITH d AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), x AS (
  SELECT o_custkey || ', ' || n AS row, '+ actual   (x1): ' AS side FROM d WHERE o_custkey % 9 = 0 UNION ALL SELECT o_custkey || ', ' || (n + 1), '- expected (x1): ' FROM d WHERE o_custkey % 9 = 0),
y AS (SELECT *, row_number() OVER (ORDER BY row, side) AS r FROM x)
SELECT false AS passed, 'columns: o_custkey, n' AS line FROM y WHERE r = 1
UNION ALL SELECT false, side || row FROM y WHERE r <= 20 UNION ALL SELECT false, '... (more rows differ)' FROM y WHERE r = 21""")
def cmp_model_test(t):
    """A model run on its input, against expectations that are wrong for some keys."""
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    wrong = counts.withColumn("n", F.when(F.col("o_custkey") % 9 == 0, F.col("n") + 1).otherwise(F.col("n")))
    model = lambda orders: orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    passed, lines = compare.run_model_test(model, {"orders": t.orders}, wrong)
    return t.spark.createDataFrame([(passed, x) for x in lines], "passed boolean, line string")


@query("SELECT c_custkey, CAST(1 AS BIGINT) AS surplus FROM customer WHERE c_custkey % 6 = 1")
def cmp_columns(t):
    """Only the columns that the first expected row names are compared."""
    expected = t.customer.where("c_custkey % 6 <> 1").select("c_custkey", F.lit("other").alias("c_name"))
    columns = compare.expected_columns(t.customer, expected, {"c_custkey": 1})
    return compare.multiset_diff(t.customer.select("c_custkey", "c_name"), expected, columns)


@query("""
WITH e AS (SELECT * FROM events WHERE event_type <> 'view' OR event_id % 3 <> 0)
SELECT 'events' AS relation, 'event_id' AS "column", 1 AS position, count(*) AS n_rows, count(event_id) AS n_values, CAST(min(event_id) AS VARCHAR) AS low, CAST(max(event_id) AS VARCHAR) AS high, true AS near_distinct, true AS near_median FROM e
UNION ALL SELECT 'events', 'user_id', 2, count(*), count(user_id), CAST(min(user_id) AS VARCHAR), CAST(max(user_id) AS VARCHAR), true, true FROM e
UNION ALL SELECT 'events', 'event_type', 3, count(*), count(event_type), min(event_type), max(event_type), true, NULL FROM e""")
def met_statistics(t):
    """Statistics kept for each partition: a second look scans the partition that changed. Sketches are held against exact numbers."""
    name, kept = scratch(t, "events"), scratch(t, "statistics")
    rows = t.events.select("event_id", "user_id", "event_type")
    tables.build_table(t.spark, name, rows, partition_by=["event_type"])
    views.table_statistics(t.spark, name, kept)
    incremental.overwrite_where(t.spark, name, rows.where("event_type = 'view' and event_id % 3 <> 0"), "event_type = 'view'")
    found = views.table_statistics(t.spark, name, kept)
    now = t.spark.table(name)
    exact = now.agg(*[F.count_distinct(c).alias(c) for c in now.columns], *[F.percentile(c, F.array(F.lit(0.46), F.lit(0.54))).alias(f"{c}_middle") for c in ("event_id", "user_id")]).first()
    pick = lambda suffix, n=None: F.coalesce(*[F.when(F.col("column") == c, F.lit(exact[c + suffix] if n is None else exact[c + suffix][n])) for c in now.columns if c + suffix in exact])
    near = (F.abs(F.col("n_distinct") - pick("")) <= 0.08 * pick("") + 1).alias("near_distinct")
    middle = F.col("median").between(pick("_middle", 0), pick("_middle", 1)).alias("near_median")
    return found.select(F.lit("events").alias("relation"), "column", "position", "n_rows", "n_values", "low", "high", near, middle)

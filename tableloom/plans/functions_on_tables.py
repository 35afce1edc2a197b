"""The portable functions over columns of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import collections as fc
from ..functions import dates as fd
from ..functions import scalar as fs
from ..functions import udfs
from .base import query


@query("""
SELECT p_partkey, p_brand || '/' || p_type AS joined, CAST(length(p_name) AS INT) AS n, replace(p_name, 'a', '_') AS replaced, "right"(p_name, 4) AS tail,
  CAST(position('e' IN p_name) AS INT) AS place FROM part""")
def fn_text(t):
    return t.part.select(
        "p_partkey", fs.concat("p_brand", F.lit("/"), "p_type").alias("joined"), fs.length("p_name").alias("n"), fs.replace("p_name", "a", "_").alias("replaced"),
        fs.right("p_name", 4).alias("tail"), fs.position("e", "p_name").alias("place"),
    )


@query("SELECT page_id, split_part(url, '/', 1) AS p1, split_part(url, '/', 3) AS p3, split_part(url, '/', -1) AS last FROM pages")
def fn_split_part(t):
    return t.pages.select("page_id", fs.split_part("url", "/", 1).alias("p1"), fs.split_part("url", "/", 3).alias("p3"), fs.split_part("url", "/", -1).alias("last"))


@query("SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS h, md5(o_orderpriority) AS hp FROM orders")
def fn_hash(t):
    return t.orders.select("o_orderkey", fs.hash_text("o_orderkey").alias("h"), fs.hash_text("o_orderpriority").alias("hp"))


@query("""
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS as_text, TRY_CAST(split_part(o_orderpriority, '-', 1) AS INT) AS level, TRY_CAST(o_orderpriority AS INT) AS none,
  CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS even, o_orderstatus = 'F' AS done FROM orders""")
def fn_casts(t):
    return t.orders.select(
        "o_orderkey", fs.cast("o_orderkey", "string").alias("as_text"), fs.safe_cast(fs.split_part("o_orderpriority", "-", 1), "int", strict=False).alias("level"),
        fs.safe_cast("o_orderpriority", "int", strict=False).alias("none"), fs.cast_bool_to_text(F.col("o_orderkey") % 2 == 0).alias("even"), fs.equals("o_orderstatus", F.lit("F")).alias("done"),
    )


@query("""
SELECT doc_id, lang IS NOT DISTINCT FROM nullif(source, 'src1') AS same, nullif(lang, 'en') IS NOT DISTINCT FROM nullif(lang, 'en') AS self, nullif(lang, 'en') = lang AS plain FROM documents""")
def fn_equals(t):
    other, no_en = F.nullif("source", F.lit("src1")), F.nullif("lang", F.lit("en"))
    return t.documents.select("doc_id", fs.equals("lang", other, True).alias("same"), fs.equals(no_en, no_en, True).alias("self"), fs.equals(no_en, "lang").alias("plain"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(15, 2)) * CAST(l_tax AS DECIMAL(4, 2)), 1) AS DOUBLE) AS tax,
  CAST(round(CAST(l_quantity AS DECIMAL(10, 2)) * 0.25, 0) AS BIGINT) AS lots FROM lineitem""")
def fn_round(t):
    """Rounded half up, in decimals: of a binary product the tie is a matter of its last bit."""
    price, tax = F.col("l_extendedprice").cast("decimal(15,2)"), F.col("l_tax").cast("decimal(4,2)")
    lots = F.col("l_quantity").cast("decimal(10,2)") * F.lit("0.25").cast("decimal(3,2)")
    return t.lineitem.select("l_orderkey", "l_linenumber", fs.safe_round(price * tax, 1).cast("double").alias("tax"), fs.safe_round(lots, 0).cast("long").alias("lots"))


@query("SELECT l_orderkey, l_linenumber, printf('%05d', l_suppkey) AS supplier, CAST(l_partkey AS VARCHAR) AS part FROM lineitem")
def fn_format_id(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", fs.format_id("l_suppkey").alias("supplier"), fs.format_id("l_partkey", None).alias("part"))


@query("SELECT o_orderkey, 'r7' AS run_id, TIMESTAMP '2024-02-01' AS run_started_at FROM orders")
def fn_audit_columns(t):
    return fs.audit_columns(t.orders.select("o_orderkey"), "r7", "2024-02-01 00:00:00")


@query("""
SELECT event_id, ts + INTERVAL 3 DAY AS d3, ts - INTERVAL 90 MINUTE AS m90, ts + to_months(CAST(event_id % 14 AS INT)) AS mo, make_date(2024, 2, 29) AS leap FROM events""")
def fn_dateadd(t):
    return t.events.select(
        "event_id", fd.dateadd("day", 3, "ts").alias("d3"), fd.dateadd("minute", -90, "ts").alias("m90"), fd.dateadd("month", F.col("event_id") % 14, "ts").alias("mo"), fd.make_date(2024, 2, 29).alias("leap")
    )


@query("""
WITH p AS (SELECT event_id, ts AS a, TIMESTAMP '2024-01-15 10:20:30' AS b FROM events)
SELECT event_id, date_diff('year', a, b) AS y, date_diff('quarter', a, b) AS q, date_diff('month', a, b) AS mo,
  date_diff('day', a, b) AS d, date_diff('hour', a, b) AS h, date_diff('minute', a, b) AS mi, date_diff('second', a, b) AS s, date_diff('millisecond', a, b) AS ms,
  date_diff('microsecond', a, b) AS us,
  CASE WHEN a <= b THEN CAST(floor(date_diff('day', DATE '1970-01-04', CAST(b AS DATE)) / 7.0) - floor(date_diff('day', DATE '1970-01-04', CAST(a AS DATE)) / 7.0) AS BIGINT)
    ELSE trunc(date_diff('day', a, b) / 7.0)::BIGINT - CASE WHEN dayofweek(a) <= dayofweek(b) THEN 1 ELSE 0 END END AS w FROM p""")
def fn_datediff(t):
    b = F.lit("2024-01-15 10:20:30").cast("timestamp_ntz")
    parts = {"y": "year", "q": "quarter", "mo": "month", "d": "day", "h": "hour", "mi": "minute", "s": "second", "ms": "millisecond", "us": "microsecond", "w": "week"}
    return t.events.select("event_id", *[fd.datediff("ts", b, p).alias(k) for k, p in parts.items()])


@query("""
SELECT event_id, date_trunc('hour', ts) AS h, date_trunc('month', ts) AS m, CAST(date_trunc('quarter', ts) AS DATE) AS q, last_day(CAST(ts AS DATE)) AS eom,
  CAST(date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS eoq, CAST(date_trunc('year', ts) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS eoy,
  CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS mo, dayname(ts) AS weekday, CAST(ts AS DATE) AS day FROM events""")
def fn_date_parts(t):
    return t.events.select(
        "event_id", fd.date_trunc("hour", "ts").alias("h"), fd.date_trunc("month", "ts").alias("m"), fd.to_date(fd.date_trunc("quarter", "ts")).alias("q"),
        fd.last_day("ts").alias("eom"), fd.last_day("ts", "quarter").alias("eoq"), fd.last_day("ts", "year").alias("eoy"), F.year("ts").alias("y"), F.month("ts").alias("mo"),
        fd.weekday_name("ts").alias("weekday"), fd.to_date("ts").alias("day"),
    )


@query("SELECT event_id, strptime(strftime(ts, '%Y/%m/%d %H:%M:%S'), '%Y/%m/%d %H:%M:%S') AS parsed, ts < TIMESTAMP '2024-01-20' AS before_now FROM events")
def fn_convert_datetime(t):
    text = F.date_format("ts", "yyyy/MM/dd HH:mm:ss")
    return t.events.select("event_id", fd.convert_datetime(text, "yyyy/MM/dd HH:mm:ss").alias("parsed"), (F.col("ts") < fd.now("2024-01-20 00:00:00")).alias("before_now"))


@query("""
SELECT o_orderkey, array_to_string([CAST(o_custkey AS INT), 7], ',') AS made, CAST(len(CAST([] AS INT[])) AS INT) AS none,
  array_to_string(list_append([o_orderkey], o_custkey), ',') AS added, array_to_string([o_orderkey] || [o_custkey, 1], ',') AS both FROM orders""")
def fn_arrays(t):
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    one = fc.array_construct([F.col("o_orderkey")], "bigint")
    return t.orders.select(
        "o_orderkey", text(fc.array_construct([F.col("o_custkey"), 7])).alias("made"), F.size(fc.array_construct()).alias("none"),
        text(fc.array_append(one, "o_custkey")).alias("added"), text(fc.array_concat(one, fc.array_construct([F.col("o_custkey"), 1], "bigint"))).alias("both"),
    )


@query("SELECT CAST(r AS BIGINT) AS generated_number FROM range(1, (SELECT CAST(max(user_id) AS BIGINT) FROM events) + 1) AS s(r)")
def fn_series(t):
    return fd.generate_series(t.spark, t.events.agg(F.max("user_id")).first()[0])


@query("""
SELECT d AS date_day, count(event_id) AS n FROM (SELECT unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) - 1, INTERVAL 1 DAY)) AS d FROM events)
LEFT JOIN events ON CAST(ts AS DATE) = CAST(d AS DATE) GROUP BY 1""")
def fn_date_spine(t):
    first, last = t.events.agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
    n = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("k"))
    spine = fd.date_spine(t.spark, "day", first, last)
    return spine.join(n, F.to_date("date_day") == F.col("day"), "left").select("date_day", F.coalesce("k", F.lit(0)).alias("n"))


@query("""
SELECT day, count(o_orderkey) AS n FROM (SELECT strftime(unnest(generate_series(CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE), INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM orders)
LEFT JOIN orders ON strftime(o_orderdate, '%Y-%m-%d') = day GROUP BY 1""")
def fn_dates_in_range(t):
    first, last = t.orders.agg(F.date_format(F.min("o_orderdate"), "yyyyMMdd"), F.date_format(F.max("o_orderdate"), "yyyyMMdd")).first()
    days = fd.dates_in_range(t.spark, first, last, "yyyyMMdd", "yyyy-MM-dd")
    n = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("k"))
    return days.join(n, "day", "left").select("day", F.coalesce("k", F.lit(0)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 + l_tax), 4) AS with_tax, round(l_extendedprice * 1.1, 4) AS at_default FROM lineitem")
def udf_scalar(t):
    name = f"order_total_{uuid.uuid4().hex[:8]}"
    udfs.create_scalar_function(t.spark, name, [("amount", "double"), ("rate", "double", "0.1D")], "double", "amount * (1 + rate)", "deterministic")
    return t.lineitem.selectExpr("l_orderkey", "l_linenumber", f"round({name}(l_extendedprice, l_tax), 4) AS with_tax", f"round({name}(l_extendedprice), 4) AS at_default")


@query("SELECT user_id, round(max(value) - min(value), 6) AS spread FROM events WHERE value IS NOT NULL GROUP BY 1")
def udf_aggregate(t):
    name = f"spread_{uuid.uuid4().hex[:8]}"
    udfs.create_aggregate_function(t.spark, name, lambda v: float(v.max() - v.min()), "double")
    return t.events.where("value is not null").groupBy("user_id").agg(F.round(F.expr(f"{name}(value)"), 6).alias("spread"))


@query("SELECT event_type, round(stddev_samp(value), 6) AS deviation FROM events GROUP BY 1")
def udf_mergeable(t):
    """A deviation from counts, means and squares that tasks make of their own rows and merge: every group here is a hot one."""
    def update(state, values):
        v = values.dropna().to_numpy()
        own = (len(v), float(v.mean()) if len(v) else 0.0, float(((v - v.mean()) ** 2).sum()) if len(v) else 0.0)
        return own if state is None else merge(state, own)

    def merge(a, b):
        n = a[0] + b[0]
        far = b[1] - a[1]
        return (n, a[1] + far * b[0] / n, a[2] + b[2] + far * far * a[0] * b[0] / n) if n else a

    rule = udfs.Mergeable("n long, mean double, squares double", "double", update, merge, lambda s: (s[2] / (s[0] - 1)) ** 0.5 if s[0] > 1 else None)
    return udfs.aggregate_by(t.events, "event_type", "value", rule, "deviation").withColumn("deviation", F.round("deviation", 6))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def udf_python_model(t):
    def model(ctx):
        return ctx.source("orders").where(F.col("o_totalprice") > ctx.config["least"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))

    return udfs.run_model(model, udfs.ModelContext(t.spark, {}, {"orders": t.orders}, {"least": 1000}))

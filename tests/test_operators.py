"""Operators on small hand-made rows: the edge cases that the tables do not have."""

import warnings
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from tableloom import session
from tableloom.functions import collections
from tableloom.functions import dates as fd
from tableloom.functions import scalar as fs
from tableloom.functions import udfs
from tableloom.operators import checks, compare, freshness, lineage, metadata, runs, scd, tables, views
from tableloom.operators import incremental as inc
from tableloom.sources import fixtures, relations, seeds
from tableloom.streaming import events


def got(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture()
def name(spark):
    import uuid

    tables.ensure_schema(spark, "t")
    return f"t.x_{uuid.uuid4().hex}"


def test_shop_marts(spark):
    orders = spark.createDataFrame([(1, 1, "2018-01-01"), (2, 3, "2018-01-02"), (3, 4, "2018-01-04"), (4, 1, "2018-01-05"), (5, 2, "2018-01-05")], "id int, user_id int, d string")
    payments = spark.createDataFrame([(1, 1000), (2, 2000), (3, 100), (4, 2500), (5, 1700)], "order_id int, amount int")
    paid = payments.groupBy("order_id").agg((F.sum("amount") / 100).alias("amount"))
    mart = orders.join(paid, F.col("id") == F.col("order_id"), "left")
    assert got(mart.select("id", "amount")) == [(1, 10.0), (2, 20.0), (3, 1.0), (4, 25.0), (5, 17.0)]
    customers = spark.range(1, 6).select(F.col("id").alias("c"))
    by = mart.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("amount").alias("v"))
    out = customers.join(by, F.col("c") == F.col("user_id"), "left").select("c", "n", F.coalesce("v", F.lit(0.0)))
    assert got(out) == [(1, 2, 35.0), (2, 1, 17.0), (3, 1, 20.0), (4, 1, 1.0), (5, None, 0.0)]


@pytest.mark.parametrize("a,b,part,n", [
    ("2024-01-01 00:59:00", "2024-01-01 01:01:00", "hour", 1), ("2024-01-01 23:59:00", "2024-01-02 00:01:00", "day", 1),
    ("2023-12-31 23:59:59", "2024-01-01 00:00:00", "year", 1), ("2024-03-31 00:00:00", "2024-04-01 00:00:00", "quarter", 1),
    ("2024-01-31 00:00:00", "2024-02-01 00:00:00", "month", 1), ("2024-01-06 12:00:00", "2024-01-07 01:00:00", "week", 1),
    ("2024-01-08 00:00:00", "2024-01-01 00:00:00", "week", -2), ("2024-01-01 00:00:01", "2024-01-01 00:00:00", "second", -1),
    ("2024-01-01 00:00:00.999", "2024-01-01 00:00:01.000", "second", 1), ("2024-01-01 00:00:00.0009", "2024-01-01 00:00:00.001", "millisecond", 1),
    ("1969-12-31 23:59:59", "1970-01-01 00:00:00", "minute", 1), ("2024-01-01 00:00:00", "2024-01-01 00:00:00.000001", "microsecond", 1),
])
def test_datediff_counts_boundaries(spark, a, b, part, n):
    assert fd.intervals_between(spark, a, b, part) == n


def test_dates(spark):
    assert [r[0].day for r in fd.date_spine(spark, "day", "2024-01-01", "2024-01-04").collect()] == [1, 2, 3]
    assert [r[0] for r in fd.dates_in_range(spark, "20240228", "20240301").orderBy("day").collect()] == ["20240228", "20240229", "20240301"]
    for bad in (lambda: fd.date_spine(spark, "day", "2024-01-04", "2024-01-04"), lambda: fd.dates_in_range(spark, "20240302", "20240301"), lambda: fd.generate_series(spark, 0), lambda: fd.datediff("a", "b", "era")):
        with pytest.raises(ValueError):
            bad()


def test_scalar_edges(spark):
    df = spark.createDataFrame([("a.b.c", 4, None), (None, 5, "x")], "s string, n int, o string")
    out = df.select(fs.split_part("s", ".", -2).alias("p"), fs.concat("s", "o").alias("j"), fs.safe_cast("s", "int", strict=False).alias("i"), fs.bucketize("n", [(None, 5, "low"), (5, 9, "high")]).alias("b"), fs.format_id("n").alias("f"))
    assert got(out) == sorted([("b", None, None, "low", "00004"), (None, None, None, "high", "00005")], key=repr)
    with pytest.raises(Exception):
        df.select(fs.safe_cast("s", "int")).collect()


def test_checks_nulls_and_status(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "z"), (2, "b")], "k int, v string")
    assert got(checks.unique(df, "k")) == [(1, 2)]
    assert got(checks.accepted_values(df, "v", ["a", "b"])) == [("z", 1)]
    assert got(checks.accepted_values(df, "k", ["1", "1 + 1"], quote=False)) == []
    assert checks.not_null(df, "v").count() == 1
    assert got(checks.relationships(df, "k", df.where("k = 2"), "k")) == [(1,), (1,)]
    assert checks.aggregated_unique(df, []).count() == 0 and checks.aggregated_not_null(df, ["k"], skip=["k"]).count() == 0
    assert got(checks.aggregated_not_null(df, ["k", "v"])) == [("k",), ("v",)]
    assert checks.not_empty(df.limit(0)).count() == 1 and checks.not_empty(df).count() == 0
    bad = checks.verdict(df, warn_if="> 1", error_if="> 10")
    assert checks.with_status(bad).first().status == "warn"
    assert checks.with_status(checks.verdict(df)).first().status == "error"
    assert checks.with_status(checks.verdict(df), "warn").first().status == "warn"
    assert checks.with_status(checks.verdict(df.limit(0), fail_calc="sum(k)")).first().status == "pass"
    assert checks.verdict(df, limit=2).first().failures == 2


def test_compare(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([("1", None), ("2", "x"), ("3", "NULL")], "k string, v string")
    diff = compare.multiset_diff(a, b)
    assert got(diff) == sorted([(1, None, 1), (3, "NULL", -1)], key=repr)
    assert compare.comparison(diff).first() == (2, False)
    assert compare.diff_report(diff) == ["columns: k, v", "+ actual   (x1): 1, NULL", "- expected (x1): 3, NULL"]
    assert compare.diff_report(diff, 1) == ["columns: k, v", "+ actual   (x1): 1, NULL", "... (more rows differ)"]
    assert compare.comparison(compare.multiset_diff(a, a)).first() == (0, True)
    assert compare.expected_columns(a, b, {"v": 1}) == ["v"] and compare.expected_columns(a, None) == ["k", "v"]
    assert compare.run_model_test(lambda orders: orders.select("k"), {"orders": a}, a.select("k")) == (True, [])
    with pytest.raises(ValueError):
        compare.run_model_test(lambda orders: orders, {"customers": a}, a)


def test_fixtures(spark):
    schema = spark.createDataFrame([], "id int, amount double, active boolean, note string").schema
    assert got(fixtures.fixture_csv(spark, "id,amount,active,note\n1,2.5,true,\n2,3,FALSE,hello", schema)) == [(1, 2.5, True, None), (2, 3.0, False, "hello")]
    assert got(fixtures.fixture_rows(spark, [{"ID": 7}], schema)) == [(7, None, None, None)]
    empty = fixtures.fixture_rows(spark, [], schema)
    assert empty.schema == schema and empty.count() == 0
    with pytest.raises(ValueError):
        fixtures.fixture_rows(spark, [{"other": 1}], schema)
    assert got(fixtures.fixture_sql(spark, "SELECT 1 AS id, '2' AS amount, true AS active, 'n' AS note", schema)) == [(1, 2.0, True, "n")]


def test_freshness(spark):
    now = "2026-01-01 12:00:00"
    one = spark.createDataFrame([("2026-01-01T06:00:00+00",), ("2026-01-01 08:00:00+03:00",), ("2026-01-01",), ("2026-01-01T06:00:00Z",), ("2026-01-01 05:59:59",)], "at string")
    row = freshness.evaluate_freshness(freshness.collect_freshness(one, "at", now), freshness.Limit(6, "hour"), freshness.Limit(1, "day")).first()
    assert (row.age_seconds, row.status) == (21600.0, "pass")
    late = freshness.collect_freshness_query(spark, "select timestamp_ntz '2025-12-20 00:00:00'", now)
    assert freshness.evaluate_freshness(late, freshness.Limit(1, "hour"), freshness.Limit(10, "day")).first().status == "error"
    assert freshness.evaluate_freshness(late, freshness.Limit(1, "hour")).first().status == "warn"
    assert freshness.evaluate_freshness(late, freshness.Limit(30, None), freshness.Limit(100, "day")).first().status == "pass"
    none = freshness.collect_freshness(one.limit(0), "at", now)
    assert freshness.evaluate_freshness(none, freshness.Limit(1, "day")).first().status == "error_empty"
    with pytest.raises(Exception):
        freshness.evaluate_freshness(none, freshness.Limit(1, "day"), strict=True).collect()
    with pytest.raises(Exception):
        freshness.collect_freshness(spark.createDataFrame([("soon",)], "at string"), "at", now).collect()
    with pytest.raises(ValueError):
        freshness.evaluate_freshness(late, freshness.Limit(1), freshness.Limit(None, "day"))


def test_incremental_rules(spark, name):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (2, "BB"), (None, "N"), (3, "c")], "k int, v string")
    assert got(inc.delete_insert(old, new, "k")) == sorted([(1, "a"), (None, "n"), (2, "B"), (2, "BB"), (None, "N"), (3, "c")], key=repr)
    with pytest.raises(inc.DuplicateKeys):
        inc.merge_rows(old, new, "k")
    one = new.where("v <> 'BB' or v is null")
    assert got(inc.merge_rows(old, one, "k")) == sorted([(1, "a"), (2, "B"), (None, "n"), (None, "N"), (3, "c")], key=repr)
    assert got(inc.merge_rows(old, one, "k", null_safe=True)) == sorted([(1, "a"), (2, "B"), (None, "N"), (3, "c")], key=repr)
    assert got(inc.merge_rows(old, one, ["k"], predicate="target.v = 'zzz'")) == sorted([*got(old), *got(one)], key=repr)
    assert inc.merge_rows(old, new, None).count() == 7
    assert got(inc.insert_overwrite(old, one.limit(0), "k = 1")) == sorted([(2, "b"), (None, "n")], key=repr)
    for call in (lambda: inc.microbatch(old, one, None), lambda: inc.update_columns(["a"], ["a"], ["b"]), lambda: inc.apply_strategy(old, one, "delete+insert"), lambda: inc.apply_strategy(old, one, "other")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(inc.SchemaMismatch):
        inc.align(old, one.drop("v"), "ignore")
    with pytest.raises(inc.SchemaMismatch):
        inc.align(old, one.withColumn("z", F.lit(1)), "fail")
    assert inc.align(old, one.withColumn("z", F.lit(1)), "unknown rule")[1].columns == ["k", "v"]
    inc.build_incremental(spark, name, old.dropna(), key="k")
    inc.build_incremental(spark, name, one.dropna(), "merge", "k")
    assert got(spark.table(name)) == [(1, "a"), (2, "B"), (3, "c")]
    inc.build_incremental(spark, name, one.dropna(), "append")
    assert spark.table(name).count() == 5
    inc.build_incremental(spark, name, old.dropna(), "append", full_refresh=True)
    assert spark.table(name).count() == 2 and inc.is_incremental(spark, name) and not inc.is_incremental(spark, name, True)


def test_tables(spark, name):
    rows = spark.createDataFrame([(1, "it's"), (2, "b")], "k int, v string")
    spark.sql(f"CREATE VIEW {name} AS SELECT 1 AS a")
    tables.build_table(spark, name, rows)
    assert tables.relation_type(spark, name) == "table"
    tables.build_table(spark, name, spark.table(name).where("k = 1"))
    assert got(spark.table(name)) == [(1, "it's")]
    # a run that died between the two renames
    spark.sql(f"ALTER TABLE {name} RENAME TO {name + tables.OLD}")
    tables.recover(spark, name)
    assert got(spark.table(name)) == [(1, "it's")]
    tables.persist_docs(spark, name, "it's a table", {"k": "the 'key'", "none": "x"})
    assert {c.name: c.description for c in spark.catalog.listColumns(name)}["k"] == "the 'key'"
    with pytest.raises(ValueError):
        tables.append(spark, name, rows.withColumn("z", F.lit(1)))
    tables.truncate(spark, name)
    assert spark.table(name).count() == 0
    assert tables.clone_table(spark, name, name) is False and tables.clone_table(spark, name, name + "c", as_view=True) is True
    assert tables.clone_table(spark, name, name + "c") is False and tables.relation_type(spark, name + "c") == "view"
    mv = name + "m"
    assert tables.build_materialized_view(spark, mv, rows, {"a": "1"}) == "created"
    assert tables.build_materialized_view(spark, mv, rows, {"a": "1"}) == "refreshed"
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert tables.build_materialized_view(spark, mv, rows, {"a": "2"}, "continue") == "skipped"
    with pytest.raises(ValueError):
        tables.build_materialized_view(spark, mv, rows, {"a": "2"}, "fail")
    assert tables.build_materialized_view(spark, mv, rows, {"a": "2"}) == "altered"
    assert tables.build_materialized_view(spark, mv, rows, {"a": "2"}, full_refresh=True) == "rebuilt"
    assert relations.read_with_fallback(spark, name + "none", mv).count() == 2
    with pytest.raises(LookupError):
        relations.ref(spark, name + "none")
    part = tables.build_table(spark, name + "p", spark.createDataFrame([(1, "a/b"), (2, None)], "k int, v string"), partition_by=["v"])
    assert got(part) == sorted([(1, "a/b"), (2, None)], key=repr)


def test_seed(spark, name, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("id;code\n1;007\n2;\n")
    assert seeds.load_seed(spark, str(path), name, {"code": "string"}, ";") == 2
    assert got(spark.table(name)) == sorted([(1, "007"), (2, None)], key=repr)
    assert seeds.load_seed(spark, str(path), name, {"code": "string"}, ";") == 2
    tables.build_view(spark, name + "v", "SELECT 1 AS a")
    with pytest.raises(ValueError):
        seeds.load_seed(spark, str(path), name + "v")


def test_metadata(spark, name):
    a = spark.createDataFrame([], "k int, v string, d decimal(10,2)")
    b = spark.createDataFrame([], "k bigint, w string, d decimal(8,1)")
    change = metadata.schema_changes(a, b)
    assert (change["added"], change["removed"], change["retyped"]) == (["w"], ["v"], [("k", "int", "bigint")])
    assert metadata.schema_change_report(a, b).count() == 3
    with pytest.raises(TypeError):
        metadata.assert_contract(a, {"k": "int", "v": "string"})
    with pytest.raises(ValueError):
        metadata.empty_with_schema(spark, {"k": ""})
    with pytest.warns(UserWarning):
        metadata.empty_with_schema(spark, {"k": "decimal"})
    assert metadata.apply_contract(a, {"D": "decimal(10,2)", "v": "string", "k": "int"}).columns == ["D", "v", "k"]
    tables.build_table(spark, name, a)
    short = name.split(".")[1]
    assert got(metadata.relations_like(spark, "T", short.upper()[:10] + "%")) == [("t", short, "table")]
    assert [r.column for r in metadata.catalog_report(spark, [name, "t.none"]).orderBy("position").collect()] == ["k", "v", "d"]
    assert metadata.columns_of(spark, name).where("name = 'd'").first()[3:5] == (10, 2)
    assert metadata.list_relations(spark, "t").where(F.col("name") == short).count() == 1


@pytest.mark.parametrize("hard", ["ignore", "invalidate", "new_record"])
@pytest.mark.parametrize("sentinel", [None, "9999-12-31 00:00:00"])
def test_history_over_four_runs(spark, name, hard, sentinel):
    rule = scd.Scd2(["k", "j"], scd.Check(["v"]), hard, sentinel, {"valid_to": "until"})
    runs_ = [[(1, 1, "a"), (2, 1, "b")], [(1, 1, "A"), (2, 1, "b")], [(1, 1, "A")], [(1, 1, "A"), (2, 1, "b")]]
    for n, rows in enumerate(runs_):
        out = scd.snapshot_table(spark, name, spark.createDataFrame(rows, "k int, j int, v string"), rule, f"2024-01-0{n + 1} 00:00:00")
    end = None if sentinel is None else datetime(9999, 12, 31)
    day = lambda n: datetime(2024, 1, n)
    have = got(out.select("k", "v", "valid_from", "until"))
    want = [(1, "a", day(1), day(2)), (1, "A", day(2), end)]
    if hard == "ignore":
        want += [(2, "b", day(1), end)]
    elif hard == "invalidate":
        want += [(2, "b", day(1), day(3)), (2, "b", day(4), end)]
    else:
        want += [(2, "b", day(1), day(3)), (2, "b", day(3), day(4)), (2, "b", day(4), end)]
        assert sorted(r[0] for r in out.where("k = 2").select("is_deleted").collect()) == ["False", "False", "True"]
    assert have == sorted(want, key=repr)
    assert out.select("scd_id").distinct().count() == out.count()


def test_history_edges(spark):
    rule = scd.Scd2(["k"], scd.Check("all"))
    one = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    first = scd.scd2_init(one, rule, "2024-01-01 00:00:00")
    grown = scd.scd2_step(first, one.withColumn("w", F.lit(None).cast("int")), rule, "2024-01-02 00:00:00")
    assert grown.count() == 4 and "w" in grown.columns  # a new column changes every row; a null key is inserted again
    again = scd.scd2_step(first, one.where("k = 1"), rule, "2024-01-02 00:00:00")
    assert got(again) == got(first)
    stamped = scd.Scd2(["k"], scd.Timestamp("at"))
    at = spark.createDataFrame([(1, datetime(2024, 1, 1))], "k int, at timestamp_ntz")
    history = scd.scd2_init(at, stamped, "2024-02-01 00:00:00")
    assert scd.scd2_step(history, at, stamped, "2024-02-02 00:00:00").count() == 1
    assert scd.scd2_step(history, at.withColumn("at", F.lit("2024-01-03").cast("timestamp_ntz")), stamped, "2024-02-02 00:00:00").count() == 2
    with pytest.warns(UserWarning):
        scd.scd2_init(at.withColumn("at", F.col("at").cast("date")), stamped, "2024-02-01 00:00:00")
    with pytest.raises(ValueError):
        scd.Scd2(["k"], scd.Check([]))


def test_lineage_and_runs(spark, tmp_path, name):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "c")], "src string, dst string")
    seed = spark.createDataFrame([("b",)], "node string")
    assert got(lineage.reach(edges, seed, "down", 1)) == [("b", 0), ("c", 1)]
    assert got(lineage.reach(edges, seed, "down")) == [("a", 2), ("b", 0), ("c", 1), ("d", 2)]
    assert got(lineage.reach(edges, seed, "up", 2)) == [("a", 1), ("b", 0), ("c", 2)]
    assert got(lineage.neighbours(edges, seed)) == [("a",), ("b",), ("c",)]
    path = tmp_path / "r.json"
    path.write_text('{"results": [{"unique_id": "m.a", "status": "success", "execution_time": 1.5, "timing": [{"name": "x", "started_at": "1", "completed_at": "2"}]},\n {"unique_id": "m.b", "status": "error", "execution_time": -3.0, "failures": 2}]}')
    rows = runs.read_run_results(spark, str(path))
    assert got(runs.retry_set(rows)) == [("m.b",)] and runs.run_summary(rows).first() == (1, 1, 0, 2)
    assert runs.write_run_results(spark, name, rows) == 1.5 and runs.write_run_results(spark, name, rows) == 1.5
    assert spark.table(name).count() == 4


def test_functions_and_models(spark):
    with pytest.warns(UserWarning):
        udfs.create_scalar_function(spark, "add_one", [("x", "int")], "int", "x + 1", "stable")
    assert spark.sql("SELECT add_one(41)").first()[0] == 42
    with pytest.raises(TypeError):
        udfs.run_model(lambda ctx: 1, udfs.ModelContext(spark, {}))


def test_event_time(spark, name, tmp_path):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2)), (3, None)], "k int, at timestamp_ntz")
    assert got(events.event_time_window(rows, "at", "2024-01-01", "2024-01-02").select("k")) == [(1,)]
    assert events.event_time_window(rows, None, "2024-01-01", None).count() == 3
    run = lambda: events.run_microbatch(spark, lambda e: e, {"e": rows}, {"e": "at"}, "2024-01-01", "2024-01-03", name, "k")
    assert run().count() == 2 and run().count() == 2
    rows.where("k = 3").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    events.merge_stream(stream, name, "k", str(tmp_path / "cp")).awaitTermination(60)
    spark.catalog.refreshTable(name)  # the stream has a session of its own
    assert spark.table(name).count() == 3


def test_built_tables_keep_their_layout(spark, name):
    """Partitions, properties and comments outlive a merge, a new column and a full refresh that do not name them."""
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "y")], "k int, v string, p string")
    inc.build_incremental(spark, name, rows, partition_by=["p"])
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('team' = 'me')")
    tables.persist_docs(spark, name, "about it", {"v": "a value"})
    for strategy, batch, options in (
        ("merge", rows.where("k = 2").withColumn("v", F.lit("B")), {"key": "k"}),
        ("merge", rows.where("k = 3").withColumn("w", F.lit(1)), {"key": "k", "on_schema_change": "append_new_columns"}),
        ("append", rows, {"full_refresh": True}),
    ):
        inc.build_incremental(spark, name, batch, strategy, **options)
        layout = tables.layout_of(spark, name)
        assert layout.partition_by == ("p",) and layout.properties["team"] == "me" and layout.description == "about it" and layout.columns["v"] == "a value"
    assert got(spark.table(name).select("k", "v", "p")) == got(rows)
    bucketed = name + "b"
    tables.build_table(spark, bucketed, rows, cluster_by=["k"], buckets=3)
    inc.build_incremental(spark, bucketed, rows.where("k = 1"), "merge", "k")
    assert tables.layout_of(spark, bucketed).buckets == 3 and tables.layout_of(spark, bucketed).cluster_by == ("k",)


def files_of(spark, name, column):
    """The files of each partition."""
    out = {}
    for value, path in spark.table(name).select(column, "_metadata.file_path").distinct().collect():
        out.setdefault(value, set()).add(path)
    return out


def test_only_touched_partitions_are_written(spark, name):
    rows = spark.createDataFrame([(k, k % 3, f"p{k % 3}") for k in range(9)] + [(9, 9, None)], "k int, v int, p string")
    inc.build_incremental(spark, name, rows, partition_by=["p"])
    files = lambda: files_of(spark, name, "p")
    before = files()
    inc.build_incremental(spark, name, rows.where("p = 'p1'").withColumn("v", F.lit(7)), "merge", ["k", "p"])
    after = files()
    assert {p for p in before if before[p] != after[p]} == {"p1"} and spark.table(name).where("v = 7").count() == 3
    added = spark.createDataFrame([(20, 20, "p2"), (21, 21, "new"), (22, 22, None)], "k int, v int, p string")
    inc.build_incremental(spark, name, added, "insert_overwrite", predicate="p in ('p1', 'p2')")
    assert got(spark.table(name)) == sorted([(k, 0, "p0") for k in (0, 3, 6)] + [(9, 9, None), (20, 20, "p2"), (21, 21, "new"), (22, 22, None)], key=repr)
    assert files()["p0"] == before["p0"] and "p1" not in {r[0] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}


def test_a_merge_by_partition_keeps_the_null_partition(spark, name):
    rows = spark.createDataFrame([(1, "a"), (9, None), (10, None)], "k int, p string")
    for columns, merge in ((["k", "p"], lambda b: inc.build_incremental(spark, name, b, "merge", ["k", "p"])), (["k"], lambda b: inc.merge_partitions(spark, name, b, "k", "p"))):
        inc.build_incremental(spark, name, rows, full_refresh=True, partition_by=["p"])
        batch = spark.createDataFrame([(20, None), (1, "a")], "k int, p string")
        want = got(inc.merge_rows(rows, batch, columns))
        assert got(merge(batch)) == want and (9, None) in want and (10, None) in want


@pytest.mark.parametrize("seed", range(2))
def test_changed_partitions_agree_with_whole_contents(spark, name, seed):
    """Merges and delete+insert on partitioned tables: rows with and without partition columns in the key, nulls,
    rows that move, partitions that empty, and files of the others left as they are."""
    import random

    rng = random.Random(seed)
    schema = "k int, v int, p string, q date"
    day = lambda: rng.choice([None, datetime(2024, 1, 1).date(), datetime(2024, 1, 2).date()])
    part = lambda: rng.choice([None, "a/b", "c d", "e=f", "g"])
    keys = rng.sample(range(40), 24)
    old = spark.createDataFrame([(rng.choice([k, k, k, None]), 0, part(), day()) for k in keys], schema)
    for strategy, key, options in (
        [("merge", ["k"], {}), ("microbatch", ["k", "p", "q"], {}), ("delete+insert", ["q"], {"predicate": "v = 0"}), ("merge", ["k"], {"null_safe": True})],
        [("delete+insert", ["k"], {}), ("default", ["k", "q"], {}), ("merge", ["k"], {"update": ["v"]}), ("merge", ["k", "p"], {}), ("merge", ["k"], {"predicate": "target.p = batch.p"})],
    )[seed]:
        new = [(k, 1, part(), day()) for k in rng.sample(range(50), 6)] + ([] if options.get("null_safe") and rng.random() < 0.5 else [(None, 1, part(), day())])
        new = spark.createDataFrame(new, schema)
        inc.build_incremental(spark, name, old, full_refresh=True, partition_by=["p", "q"])
        where = F.struct("p", "q").cast("string")
        before = files_of(spark, name, where)
        want = inc.apply_strategy(old, new, strategy, key, **options)
        changed = inc.changed_partitions(old, new, key, ["p", "q"], options.get("null_safe", False), None)
        inc.build_incremental(spark, name, new, strategy, key, **options)
        spark.catalog.refreshTable(name)
        assert got(spark.table(name)) == got(want), (strategy, key, options)
        after, touched = files_of(spark, name, where), {r[0] for r in spark.createDataFrame(changed, "p string, q date").select(where).collect()} if changed else set()
        assert all(paths <= after[p] for p, paths in before.items() if p not in touched)
        listed = {tuple(v.values()) for v in tables.partitions_of(spark, name).values()}
        assert listed == {(r.p, r.q and str(r.q)) for r in spark.table(name).select("p", "q").distinct().collect()}


def test_too_many_partitions_rewrite_the_table(spark, name, monkeypatch):
    monkeypatch.setattr(inc, "MAX_PARTITIONS", 2)
    rows = spark.createDataFrame([(k, k % 5) for k in range(20)], "k int, p int")
    inc.build_incremental(spark, name, rows, partition_by=["p"])
    batch = spark.createDataFrame([(k, 9) for k in range(5)], "k int, p int")
    assert got(inc.build_incremental(spark, name, batch, "delete+insert", "k")) == got(inc.delete_insert(rows, batch, "k"))
    assert tables.layout_of(spark, name).partition_by == ("p",)


def test_repeated_null_keys_are_an_error_if_null_matches_null(spark):
    target, batch = spark.createDataFrame([(None, 1)], "k int, v int"), spark.createDataFrame([(None, 7), (None, 8)], "k int, v int")
    with pytest.raises(inc.DuplicateKeys):
        inc.merge_rows(target, batch, "k", null_safe=True)
    assert inc.merge_rows(target, batch, "k").count() == 3
    assert got(inc.merge_rows(target, batch.limit(1), "k", null_safe=True)) in ([(None, 7)], [(None, 8)])


def histories(spark):
    runs_ = [[(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (5, "e", "z")], [(1, "A", "x"), (3, "c", "y")], [(1, "A", "x"), (2, "b", "y"), (4, "d", None)], [(None, "n", "x"), (2, "B", "y")], []]
    return [spark.createDataFrame(r, "k int, v string, p string") for r in runs_]


@pytest.mark.parametrize("hard,sentinel,parts", [("ignore", None, []), ("invalidate", "9999-12-31 00:00:00", ["p"]), ("new_record", None, ["p"])])
def test_split_histories_agree_with_whole_ones(spark, name, hard, sentinel, parts):
    """Current and ended versions kept apart: the same history, and what has ended is never written again."""
    rule = scd.Scd2(["k"], scd.Check(["v"]), hard, sentinel)
    frames, history, ended = histories(spark), None, set()
    for n, source in enumerate(frames):
        now = f"2024-02-0{n + 1} 00:00:00"
        scd.snapshot_table(spark, name, source, rule, now, parts, split="is_open")
        step = scd.scd2_init(source, rule, now) if history is None else scd.scd2_step(history, source, rule, now)
        history = spark.createDataFrame(step.collect(), step.schema)
        table = spark.table(name)
        assert got(table.select(*history.columns)) == got(history)
        assert table.where(F.col("is_open") != scd._is_current(rule, F.col("valid_to"))).isEmpty()
        files = files_of(spark, name, "is_open").get(False, set())
        assert ended <= files
        ended = files
    assert tables.layout_of(spark, name).partition_by == ("is_open", *parts)


def test_a_step_that_was_cut_short_is_finished(spark, name, monkeypatch):
    rule = scd.Scd2(["k"], scd.Check(["v"]), "invalidate")
    first, second, *_ = histories(spark)
    scd.snapshot_table(spark, name, first, rule, "2024-02-01 00:00:00", split="is_open")
    want = got(scd.scd2_step(scd.scd2_init(first, rule, "2024-02-01 00:00:00"), second, rule, "2024-02-02 00:00:00"))
    for broken in ("overwrite_partitions", "append", "drop_relation"):
        with monkeypatch.context() as m:
            real = getattr(tables, broken)
            m.setattr(tables, broken, lambda *a: real(*a) if not a[1].endswith(tables.NEW) and broken != "append" and broken != "overwrite_partitions" else (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                scd.snapshot_table(spark, name, second, rule, "2024-02-02 00:00:00")
        scd.snapshot_table(spark, name, second, rule, "2024-02-02 00:00:00")
        assert got(spark.table(name).drop("is_open")) == want
        tables.drop_relation(spark, name)
        scd.snapshot_table(spark, name, first, rule, "2024-02-01 00:00:00", split="is_open")


def test_histories_keep_their_layout(spark, name):
    rule = scd.Scd2(["k"], scd.Check(["v"]))
    first, second, *_ = histories(spark)
    for split, parts in ((None, ("p",)), ("is_open", ("is_open", "p"))):
        scd.snapshot_table(spark, name, first, rule, "2024-02-01 00:00:00", ["p"], split=split)
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('team' = 'me')")
        tables.persist_docs(spark, name, "about it", {"v": "a value"})
        scd.snapshot_table(spark, name, second.withColumn("w", F.lit(5)), rule, "2024-02-02 00:00:00")
        layout = tables.layout_of(spark, name)
        assert layout.partition_by == parts and layout.properties["team"] == "me" and layout.description == "about it" and layout.columns["v"] == "a value"
        assert got(spark.table(name).where("k = 1").select("v", "w")) == sorted([("a", None), ("A", 5)], key=repr)
        tables.drop_relation(spark, name)


def test_materialized_views_keep_what_was_said_about_them(spark, name):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, p string")
    tables.build_table(spark, name, rows, partition_by=["p"], properties={"team": "me"})
    assert tables.build_materialized_view(spark, name, rows, {"a": "1"}) == "rebuilt"
    assert tables.build_materialized_view(spark, name, rows, {"b": "1"}) == "altered"
    assert tables.build_materialized_view(spark, name, rows, {"b": "1"}) == "refreshed"
    layout = tables.layout_of(spark, name)
    assert layout.partition_by == ("p",) and layout.properties["team"] == "me"


def test_a_small_batch_does_not_shuffle_its_target(spark):
    old = spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    new = spark.createDataFrame([(5, "b"), (None, "n"), (2000, "c")], "k long, v string")
    merged = inc.merge_rows(old, new, "k")
    assert got(merged.where("v <> 'a'")) == sorted([(5, "b"), (None, "n"), (2000, "c")], key=repr) and merged.count() == 1002
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    assert sorted(got(inc.merge_rows(old, new, "k", check=False).where("v <> 'a'")), key=repr) == got(merged.where("v <> 'a'"))


def test_checks_that_share_a_scan(spark):
    df = spark.createDataFrame([(1, "a"), (-1, None), (None, "z")], "k int, v string")
    listed = [
        checks.Check("not_null", "t", column="v", rows=df, bad="v is null", severity="warn"),
        checks.Check("positive", "t", column="k", rows=df, bad="k < 0", warn_if="> 0", error_if="> 5"),
        checks.Check("few", "t", rows=df, bad="true", limit=2, error_if="> 2"),
        checks.Check("sum", "t", column="k", rows=df, bad="k > 0", fail_calc="sum(k)", error_if="= 1"),
        checks.Check("unique", "t", checks.unique(df, "v"), "v"),
    ]
    out = checks.run_checks(listed)
    assert {(r.check, r.failures, r.status) for r in out.collect()} == {("not_null", 1, "warn"), ("positive", 1, "warn"), ("few", 2, "warn"), ("sum", 1, "error"), ("unique", 0, "pass")}
    for bad in (dict(), dict(rows=df), dict(failing=df, rows=df, bad="true")):
        with pytest.raises(ValueError):
            checks.Check("x", "t", **bad)


def test_first_of_a_group(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, "c"), (2, None)], "k int, v string")
    assert got(collections.listagg_first(df, ["k"], "v", 2)) == sorted([(1, "a,b"), (2, None)], key=repr)
    assert got(df.groupBy("k").agg(collections.listagg("v", limit=2).alias("listed"))) == sorted([(1, "a,b"), (2, None)], key=repr)


def test_history_steps_agree_with_stage_and_apply(spark):
    """One join or two: the same history, over versions that have ended, sentinels and deletions."""
    runs_ = [[(1, "a"), (2, "b"), (3, "c")], [(1, "A"), (3, "c")], [(1, "A"), (2, "b"), (4, "d")], [(None, "n"), (2, "B")]]
    for hard in scd.HARD_DELETES:
        for sentinel in (None, "9999-12-31 00:00:00"):
            rule = scd.Scd2(["k"], scd.Check(["v"]), hard, sentinel)
            frames = [spark.createDataFrame(r, "k int, v string") for r in runs_]
            history = scd.scd2_init(frames[0], rule, "2024-01-01 00:00:00")
            for n, source in enumerate(frames[1:]):
                now = f"2024-02-0{n + 1} 00:00:00"
                two = scd.scd2_apply(history, scd.scd2_stage(history, source, rule, now), rule)
                history = spark.createDataFrame(scd.scd2_step(history, source, rule, now).collect(), two.schema)
                assert got(history) == got(two)


def test_kept_steps_come_and_go(spark):
    df = session.materialize(spark.range(5), "five")
    assert df.count() == 5 and session.own_dir(spark) in df.kept_at
    session.discard(df)
    with pytest.raises(Exception):
        spark.read.schema(df.schema).parquet(df.kept_at).count()

    class Cluster:
        master = "spark://there:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Cluster()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_views_are_refreshed_from_what_changed(spark, name):
    rows = spark.createDataFrame([(k % 4, float(k), f"d/{k % 3}" if k % 5 else None) for k in range(40)], "g int, v double, day string")
    src = name + "s"
    tables.build_table(spark, src, rows, partition_by=["day"])
    measures = {"n": ("count", "*"), "some": ("count", "v"), "total": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v"), "mean": ("avg", "v"), "kinds": ("approx_distinct", "g")}
    view = views.AggregateView(src, ["g"], measures, where="v <> 7")
    right = lambda: got(spark.table(name)) == got(view.whole(spark).select(*spark.table(name).columns))
    assert views.refresh(spark, name, view) == "created" and right()
    assert views.refresh(spark, name, view) == "unchanged"
    tables.persist_docs(spark, name, "about it")
    before = files_of(spark, name + views.STATE, "part__day")
    tables.append(spark, src, spark.createDataFrame([(9, 1.5, "d/1"), (9, 2.5, "new"), (1, None, "new")], rows.schema))
    tables.drop_partition(spark, src, {"day": "d/2"})
    assert views.refresh(spark, name, view) == "refreshed" and right()
    after = files_of(spark, name + views.STATE, "part__day")
    assert {p for p in before if before[p] != after.get(p)} == {"d/1", "d/2"} and "new" in after and None in after
    inc.overwrite_where(spark, src, rows.where("day is null").withColumn("v", F.lit(1.0)), "day is null")
    assert views.refresh(spark, name, view) == "refreshed" and right()
    assert tables.layout_of(spark, name).description == "about it"
    less = views.AggregateView(src, ["g"], {"n": ("count", "*")})
    assert views.refresh(spark, name, less) == "rebuilt" and got(spark.table(name)) == got(less.whole(spark))
    tables.truncate(spark, src)
    assert views.refresh(spark, name, less) == "refreshed" and spark.table(name).count() == 0
    whole = name + "w"
    tables.build_table(spark, whole, rows)
    flat = views.AggregateView(whole, ["g"], {"n": ("count", "v")})
    assert views.refresh(spark, name + "f", flat) == "created" and views.refresh(spark, name + "f", flat) == "rebuilt"


def test_streams_in_any_order_give_one_table(spark, name, tmp_path):
    """Late and repeated keys, ties, nulls and replays: the latest version stands."""
    import random

    base = datetime(2024, 1, 1)
    rows = [(k % 7, base.replace(day=1 + (k * 5) % 20), f"v{k}") for k in range(60)] + [(3, None, "no time"), (8, None, "alone"), (1, base.replace(day=25), "tie a"), (1, base.replace(day=25), "tie b")]
    schema = "k int, at timestamp_ntz, v string"
    want = {}
    for n in range(2):
        mixed = random.Random(n).sample(rows, len(rows)) + rows[:10]
        for part in range(3):
            spark.createDataFrame(mixed[part::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in{n}"))
        events.merge_stream(stream, f"{name}{n}", "k", str(tmp_path / f"cp{n}"), "at").awaitTermination(120)
        if n:  # and all of it once more
            again = spark.readStream.schema(schema).parquet(str(tmp_path / f"in{n}"))
            events.merge_stream(again, f"{name}{n}", "k", str(tmp_path / "cp-again"), "at").awaitTermination(120)
        spark.catalog.refreshTable(f"{name}{n}")
        want[n] = got(spark.table(f"{name}{n}"))
    latest = {k: max(a for j, a, _ in rows if j == k and a) for k in range(7)}
    assert want[0] == want[1] and {r[0]: r[1] for r in want[0]} == {**latest, 8: None}


def test_streams_refuse_what_chance_would_decide(spark, name, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, v string").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="repeat within"):
        events.merge_stream(stream, name, "k", str(tmp_path / "cp")).awaitTermination(60)


def test_watermarks_bound_the_repeats_that_are_known(spark, name, tmp_path):
    rows = [(k, datetime(2024, 1, 1 + k % 3), "x") for k in range(9)]
    for part in (rows, rows, rows[:4]):
        spark.createDataFrame(part, "k int, at timestamp, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, at timestamp, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = events.merge_stream(stream, name, "k", str(tmp_path / "cp"), "at", "10 days")
    query.awaitTermination(120)
    spark.catalog.refreshTable(name)
    assert sorted(r.k for r in spark.table(name).collect()) == list(range(9))
    assert sum(p.numInputRows for p in query.recentProgress) == 22 and query.recentProgress[0].stateOperators[0].numRowsTotal == 9


def test_mergeable_aggregates(spark):
    """Null keys and values, several keys, a hot group in many tasks, and states that are handed on early."""
    rule = udfs.Mergeable("n long, low double", "struct<n:long,low:double>", lambda s, v: ((s[0] if s else 0) + int(v.notna().sum()), min([x for x in (s[1] if s else None, *v.dropna().tolist()) if x is not None], default=None)),
                          lambda a, b: (a[0] + b[0], min([x for x in (a[1], b[1]) if x is not None], default=None)), lambda s: {"n": s[0], "low": s[1]})
    rows = [(1, "a", float(k)) for k in range(400)] + [(k, None, None if k % 2 else 2.0) for k in range(50)] + [(None, "b", 7.0), (None, "b", None)]
    df = spark.createDataFrame(rows, "k int, g string, v double").repartition(8)
    want = got(df.groupBy("k", "g").agg(F.struct(F.count("v").alias("n"), F.min("v").alias("low")).alias("r")))
    assert got(udfs.aggregate_by(df, ["k", "g"], "v", rule, "r")) == want
    before, udfs.MAX_GROUPS = udfs.MAX_GROUPS, 3
    try:
        assert got(udfs.aggregate_by(df, ["k", "g"], "v", rule, "r")) == want
    finally:
        udfs.MAX_GROUPS = before
    assert udfs.aggregate_by(df.limit(0), "g", "v", rule).count() == 0


def test_bucketed_comparison(spark):
    """The same rows as the plain one; rows that differ only in where a null stands are told apart; equal tables stay where they are."""
    rows = [(k, None if k % 3 else f"v{k}", k % 2 or None) for k in range(300)]
    a = spark.createDataFrame(rows + [(None, "x", 5), (1000, "x", None)], "k int, v string, w int")
    b = spark.createDataFrame(rows + [(5, "x", None), (1000, None, 0)] + rows[:2] * 2, "k int, v string, w int")
    for left, right in ((a, b), (b, a), (a, a), (a, a.limit(0)), (a.limit(0), a.limit(0))):
        for buckets in (1, 16, 4096):
            assert got(compare.bucketed_diff(left, right, buckets=buckets)) == got(compare.multiset_diff(left, right))
    assert "Exchange" in compare.multiset_diff(a, a)._jdf.queryExecution().toString()
    assert compare.bucketed_diff(a, a)._jdf.queryExecution().optimizedPlan().toString().startswith("LocalRelation")


def test_statistics_stay_within_their_bounds(spark, name):
    """Sketches of partitions, merged: distinct values within 5 percent, quantiles within 1.5 percent of the rows, as new partitions come."""
    rows = spark.range(60_000).select((F.col("id") * 7919 % 30_011).alias("k"), F.concat(F.lit("u"), (F.col("id") % 5000).cast("string")).alias("u"), F.when(F.col("id") % 4 > 0, F.sqrt("id")).alias("x"), (F.col("id") % 6).cast("int").alias("day"))
    stats = name + "stats"
    for upto in (2, 4, 6):
        tables.build_table(spark, name, rows.where(F.col("day") < upto), partition_by=["day"]) if upto == 2 else tables.append(spark, name, rows.where((F.col("day") < upto) & (F.col("day") >= upto - 2)))
        before = files_of(spark, stats + views.STATE, "part__day") if upto > 2 else {}
        found = {r.column: r for r in views.table_statistics(spark, name, stats).collect()}
        assert all(files_of(spark, stats + views.STATE, "part__day")[p] == f for p, f in before.items())
        now = rows.where(F.col("day") < upto)
        n = now.count()
        for c in ("k", "u", "x"):
            exact = now.select(c).distinct().dropna().count()
            assert found[c].n_rows == n and found[c].n_values == now.where(f"{c} is not null").count() and abs(found[c].n_distinct - exact) <= 0.05 * exact
            low, high = now.agg(F.min(c).cast("string"), F.max(c).cast("string")).first()
            assert (found[c].low, found[c].high) == (low, high)
        for c, share, value in (("k", 0.25, found["k"].q25), ("k", 0.5, found["k"].median), ("x", 0.75, found["x"].q75)):
            assert abs(now.where(F.col(c) <= value).count() / found[c].n_values - share) <= 0.015
        assert found["u"].median is None
    assert found["day"].position == 4


def test_uniqueness_by_hash(spark, monkeypatch):
    """Exact on planted repeats, nulls and several columns, within tasks and across them; and where too much repeats."""
    df = spark.range(3000).select(F.when(F.col("id") % 10 > 0, F.concat(F.lit("key-"), (F.col("id") % 2950).cast("string"))).alias("a"), (F.col("id") % 2990).alias("b"), F.lit("same").alias("c")).repartition(6)
    for packed in (checks.PACKED, 100):
        monkeypatch.setattr(checks, "PACKED", packed)
        assert got(checks.unique(df, "a", by_hash=True)) == got(checks.unique(df, "a")) and checks.unique(df, "a").count() == 45
        assert got(checks.aggregated_unique(df, ["a", "b", "c"], by_hash=True)) == got(checks.aggregated_unique(df, ["a", "b", "c"]))
        assert checks.unique(df.where("b < 2950 and a is not null").dropDuplicates(["a"]), "a", by_hash=True).count() == 0
        assert checks.unique(df.limit(0), "a", by_hash=True).count() == 0
    monkeypatch.setattr(checks, "FEW_REPEATS", 3)
    assert got(checks.unique(df, "a", by_hash=True)) == got(checks.unique(df, "a"))


def test_unique_keys_move_as_packed_hashes(spark):
    """Of wide keys, all unique, a small share of the bytes is shuffled."""
    rows = spark.range(200_000).select(F.concat(F.sha2(F.col("id").cast("string"), 256), F.md5(F.col("id").cast("string"))).alias("k"))
    found = checks.hash_repeats(rows)
    assert found.collect() == []
    node = found._jdf.queryExecution().executedPlan().executedPlan()
    while "ShuffleQueryStage" not in node.nodeName():
        node = node.plan() if "QueryStage" in node.nodeName() else node.children().head()
    assert 0 < node.plan().metrics().apply("shuffleBytesWritten").value() < 0.12 * 200_000 * 96


def test_reach_in_leaps(spark):
    """Depths of a graph with cycles, short cuts and a chain, against a plain walk."""
    import random

    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(30)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(110)] + [(5, 5), (100, 101), (None, 3), (3, None)]
    edges = spark.createDataFrame(pairs, "src int, dst int")
    for seeds, direction, most in (([0], "down", None), ([7, 60, 999], "up", None), ([0], "down", 5), ([0], "down", 0)):
        want, front, depth = {s: 0 for s in seeds}, set(seeds), 0
        while front and (most is None or depth < most):
            depth += 1
            ends = {(b if direction == "down" else a) for a, b in pairs if (a if direction == "down" else b) in front}
            front = {e for e in ends if e is not None and e not in want}
            want |= {e: depth for e in front}
        found = lineage.reach(edges, spark.createDataFrame([(s,) for s in seeds], "node int"), direction, most)
        assert {r.node: r.depth for r in found.collect()} == want and found.count() == len(want)


def plain_walk(pairs, seeds):
    want, front, depth = {s: 0 for s in seeds}, set(seeds), 0
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    while front:
        depth += 1
        front = {b for a in front for b in out.get(a, ()) if b not in want}
        want |= {b: depth for b in front}
    return want


def test_reach_contracts_what_is_deep(spark, monkeypatch):
    """A chain of 1000, with leaves at each node, a cycle of its own, short cuts into it, and a ring at its end: exact depths in few rounds."""
    import random

    chain = [(k, k + 1) for k in range(1000)]
    leaves = [(k, 5000 + k) for k in range(0, 1000, 3)]
    cuts = [(100, 400), (350, 120), (600, 900), (600, 899)]
    ring = [(1000, 2000), *((2000 + k, 2000 + (k + 1) % 50) for k in range(50)), (3000, 3001), (3001, 3000)]
    rng = random.Random(4)
    tree = [(10_000 + rng.randrange(max(0, k - 6), k), 10_000 + k) for k in range(1, 900)]
    wild = [(k, k + 1) for k in range(40)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(100)]
    writes = []
    keep = lineage.materialize
    monkeypatch.setattr(lineage, "materialize", lambda df, label: writes.append(label) or keep(df, label))
    for pairs, seeds, most in ((chain, [0], 40), (chain + leaves + cuts + ring, [0, 3000], 70), (tree, [10_000], 110), (wild, [0], None)):
        writes.clear()
        edges = spark.createDataFrame(pairs, "src int, dst int")
        found = lineage.reach(edges, spark.createDataFrame([(s,) for s in seeds], "node int"))
        assert {r.node: r.depth for r in found.collect()} == plain_walk(pairs, seeds) and found.count() == len(plain_walk(pairs, seeds))
        assert most is None or len(writes) <= most, len(writes)
    edges = spark.createDataFrame(chain + cuts, "src int, dst int")
    some = lineage.reach(edges, spark.createDataFrame([(0,)], "node int"), "down", 150)
    assert {r.node: r.depth for r in some.collect()} == {k: d for k, d in plain_walk(chain + cuts, [0]).items() if d <= 150}

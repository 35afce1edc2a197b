"""Mixing sources to target weights with a low-discrepancy schedule (DataFrame functions only).

Every source's documents are laid end to end in a hashed order (of their ids, and of their numbers among
rows that repeat id, source and size) and cut into blocks of ``BLOCK``
words. Slot i of the mix takes the golden-ratio point u(i) = i * g mod 2**32; the source whose
span of the cumulative target weights holds u(i) fills the slot, and the k-th slot of a source
takes its block k mod (number of blocks). Slots and blocks meet in an equi-join on
(source, block), so neither a hot source nor a long document gathers in a task.

Defined results: null text has no words; documents without words are never taken; null is a
source of its own, last in order; repeated rows are separate documents; an empty table or one
without words gives targets of 0 and an empty mix; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, numbered

BLOCK = 128
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: 2**32 / golden ratio**2, rounded to odd: multiples mod 2**32 are a low-discrepancy sequence.
GOLDEN = 1_640_531_527
SPAN = 2**32
CELL = 2**20
#: Up to so many sources the source table is broadcast; beyond, it is joined by shuffle.
FEW_SOURCES = 10_000


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, size."""
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    return docs.select("doc_id", "source", F.coalesce(words, F.lit(0).cast("long")).alias("size"))


def source_targets(sizes: DataFrame, cap: int = MAX_EPOCHS, block: int = BLOCK) -> DataFrame:
    """source, source_no, source_size, target, n_blocks, slots, lo, hi: one row per source.

    Shares follow WEIGHTS in code-point order. A target above ``cap`` times its source is cut and
    the excess reshared by weight until none is above: with r = cap * size / weight ascending, the
    water level is the largest (total - capped before) / (weights from here), in closed form. A source's slots
    are its target over the mean size of its blocks, so a last block that is short costs it nothing.
    """
    everything = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("source_no", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * float(cap))
    rising = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), "source_no")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    )
    per = per.withColumn("level", level)
    per = per.withColumn("target", F.least("most", F.max("level").over(everything) * F.col("weight")))
    per = per.withColumn("n_blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    per = per.withColumn("slots", F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0))
    total = F.greatest(F.sum("slots").over(everything), F.lit(1e-300))
    upto = F.coalesce(F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return per.select(
        "source", "source_no", "source_size", "target", "n_blocks", "slots",
        F.round(upto / total * SPAN).cast("long").alias("lo"),
        F.round((upto + F.col("slots")) / total * SPAN).cast("long").alias("hi"),
    )


def schedule(spark, targets: DataFrame, n_slots: int) -> DataFrame:
    """slot, source_no, rank: the rank counts a source's slots in schedule order.

    Ranks come from runs of about sqrt(n_slots) slots: counts per (run, source) are summed up
    front, and only a run's slots are numbered together.
    """
    run = max(1024, math.isqrt(n_slots))
    cells = targets.where("hi > lo").select(
        "source_no", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {CELL}"), F.expr(f"(hi - 1) div {CELL}"))).alias("cell")
    )
    points = spark.range(n_slots).select(
        F.col("id").alias("slot"), F.expr(f"((id % {SPAN}) * {GOLDEN}) % {SPAN}").alias("point"), F.expr(f"id div {run}").alias("run")
    )
    points = points.withColumn("cell", F.expr(f"point div {CELL}"))
    taken = points.join(cells, "cell").where("point >= lo and point < hi").select("slot", "run", "source_no")
    upto = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = taken.groupBy("source_no", "run").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("source_no", "run", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first"))
    within = Window.partitionBy("source_no", "run").orderBy("slot")
    return (
        taken.withColumn("place", F.row_number().over(within) - 1)
        .join(counts, ["source_no", "run"])
        .select("slot", "source_no", (F.col("first") + F.col("place")).alias("rank"))
    )


def laid_out(sizes: DataFrame, targets: DataFrame, n_docs: int, few_sources: bool) -> DataFrame:
    """doc_id, source, size, copy, source_no, source_size, target, start: documents end to end in hashed order."""
    side = targets.select(F.col("source").alias("_source"), "source_no", "source_size", "target")
    side = F.broadcast(side) if few_sources else side
    n_runs = max(16, math.isqrt(n_docs))
    name = F.concat(F.lit("mix|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("copy").cast("string"))
    order = F.conv(F.substring(F.md5(name), 1, 12), 16, 10)
    docs = sizes.join(side, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", "copy", "source_no", "source_size", "target", order.cast("long").alias("at")
    )
    docs = docs.withColumn("run", F.expr(f"at div {2**48 // n_runs}"))
    runs = docs.groupBy("source_no", "run").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("source_no", "run", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("first"))
    within = Window.partitionBy("source_no", "run").orderBy("at", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, 0)
    return (
        docs.withColumn("start", F.sum("size").over(within) - F.col("size"))
        .join(runs, ["source_no", "run"])
        .withColumn("start", F.col("start") + F.col("first"))
        .drop("run", "first", "at")
    )


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, copy: what the mix needs of the documents, kept, so that texts are read once."""
    return materialize(numbered(word_counts(docs), ["doc_id", "source", "size"]), "word-counts")


def mix(docs: DataFrame, block: int = BLOCK, sizes: DataFrame | None = None) -> DataFrame:
    """The mix: one row per slot and piece of a document in it.

    doc_id, source, size, source_no, source_size, target, start (of the document in its source), slot,
    epoch, from_word, to_word (within the document). A document that no slot takes has one row with
    null slot. Slots beyond MAX_EPOCHS rounds of a source, at most the few by which the sequence
    deviates from its target, stay unused.
    """
    spark = docs.sparkSession
    sizes = sized(docs) if sizes is None else sizes
    targets = source_targets(sizes, block=block)
    n_docs, n_sources = sizes.agg(F.count(F.lit(1)), F.approx_count_distinct("source")).first()
    laid = laid_out(sizes, targets, n_docs, n_sources <= FEW_SOURCES)
    n_slots = round(targets.agg(F.coalesce(F.sum("slots"), F.lit(0.0))).first()[0])
    pieces = laid.withColumn(
        "block", F.explode_outer(F.when(F.col("size") > 0, F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    ).select(
        "*",
        F.greatest(F.col("block") * block - F.col("start"), F.lit(0)).alias("from_word"),
        F.least((F.col("block") + 1) * block - F.col("start"), F.col("size")).alias("to_word"),
    )
    counts = targets.select("source_no", "n_blocks")
    counts = F.broadcast(counts) if n_sources <= FEW_SOURCES else counts
    slots = schedule(spark, targets, n_slots).join(counts, "source_no").where("n_blocks > 0").select(
        "slot", "source_no", F.expr("rank % n_blocks").alias("block"), F.expr("rank div n_blocks").alias("epoch")
    )
    return pieces.join(slots.where(F.col("epoch") < MAX_EPOCHS), ["source_no", "block"], "left")


def taken_words(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, source_no."""
    words = F.sum(F.when(F.col("slot").isNotNull(), F.col("to_word") - F.col("from_word")).otherwise(0))
    return (
        mix(docs)
        .groupBy("doc_id", "size", "copy", "source_no", "source_size", "target", "start")
        .agg(words.cast("long").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken", "source_no")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of the mix as documents: one row per document and round that takes it.

    All columns of ``docs`` stay. A document that its source's share takes only in part (at most
    one per source and round) has its text cut to the words taken; n_chars, if there, follows.
    """
    sizes = sized(docs.select("doc_id", "text", "source"))
    parts = (
        mix(docs, sizes=sizes)
        .where("slot is not null")
        .groupBy("doc_id", "source", "copy", "size", "epoch")
        .agg(F.min("from_word").alias("a"), F.max("to_word").alias("b"))
        .groupBy("doc_id", "source", "copy", "size")
        .agg(F.collect_list(F.struct("epoch", "a", "b")).alias("parts"))  # MAX_EPOCHS at most
    )
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_key"), F.col("source").alias("source_key"), n.alias("n_words"))
    # rows that repeat doc_id, source and size share the parts out by their number; the others are not moved for that
    again = materialize(sizes.where("copy > 0").select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z")).distinct(), "repeated-names")
    named = F.col("doc_key").eqNullSafe(F.col("d")) & F.col("source_key").eqNullSafe(F.col("s")) & (F.col("n_words") == F.col("z"))
    if again.isEmpty():
        held = held.withColumn("nth", F.lit(0).cast("long"))
    else:
        once = held.join(again, named, "left_anti").withColumn("nth", F.lit(0).cast("long"))
        held = once.unionByName(numbered(held.join(again, named, "left_semi"), ["doc_key", "source_key", "n_words"]).withColumnRenamed("copy", "nth"))
    same = F.col("doc_key").eqNullSafe(parts["doc_id"]) & F.col("source_key").eqNullSafe(parts["source"]) & (F.col("n_words") == parts["size"]) & (F.col("nth") == parts["copy"])
    part = held.join(parts, same).select("row", "size", F.explode("parts").alias("p"))
    whole = (F.col("p.a") == 0) & (F.col("p.b") == F.col("size"))
    text = F.when(whole, F.col("row.text")).otherwise(
        F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.col("p.a") + 1, F.col("p.b") - F.col("p.a")), " ")
    )
    row = F.col("row").withField("text", text)
    out = part.select(row.alias("row")).select("row.*")
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_mixing(spark, sf_dir):
    out = taken_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH RECURSIVE d0 AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    row_number() OVER () AS id FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size ORDER BY id) - 1 AS copy FROM d0),
d AS (SELECT *, ('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy), 1, 12))::BIGINT AS pos FROM c),
p AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS source_no FROM d GROUP BY source),
w AS (SELECT *, (source_no % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS most FROM p),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (ORDER BY most / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(most, max(level) OVER () * weight) AS target FROM l),
b AS (SELECT *, (source_size + {BLOCK - 1}) // {BLOCK} AS n_blocks, CASE WHEN source_size > 0 THEN target * ((source_size + {BLOCK - 1}) // {BLOCK}) / source_size ELSE 0.0 END AS slots FROM t),
s AS (SELECT source, source_no, source_size, target, n_blocks,
  round(coalesce(sum(slots) OVER (ORDER BY source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / greatest(sum(slots) OVER (), 1e-300) * {SPAN})::BIGINT AS lo,
  round((coalesce(sum(slots) OVER (ORDER BY source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + slots) / greatest(sum(slots) OVER (), 1e-300) * {SPAN})::BIGINT AS hi FROM b),
points AS (SELECT i, ((i % {SPAN}) * {GOLDEN}) % {SPAN} AS point FROM range(0, (SELECT CAST(round(sum(slots)) AS BIGINT) FROM b)) AS g(i)),
ranked AS (SELECT source_no, n_blocks, row_number() OVER (PARTITION BY source_no ORDER BY i) - 1 AS k FROM points JOIN s ON point >= lo AND point < hi),
uses AS (SELECT source_no, k % n_blocks AS block, count(*) AS n FROM ranked WHERE k // n_blocks < {MAX_EPOCHS} GROUP BY 1, 2),
laid AS (SELECT d.id, d.doc_id, d.size, s.source_no, s.source_size, s.target,
  sum(d.size) OVER (PARTITION BY s.source_no ORDER BY pos, doc_id, d.size, copy ROWS UNBOUNDED PRECEDING) - d.size AS a FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
pieces AS (SELECT *, unnest(range(CAST(a // {BLOCK} AS BIGINT), CAST((a + size - 1) // {BLOCK} + 1 AS BIGINT))) AS block FROM laid WHERE size > 0),
took AS (SELECT id, sum(n * (least((pieces.block + 1) * {BLOCK}, a + size) - greatest(pieces.block * {BLOCK}, a))) AS taken FROM pieces JOIN uses USING (source_no, block) GROUP BY id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM laid LEFT JOIN took USING (id)"""

"""Exact deduplication over content-defined chunk recipes (DataFrame functions only).

A text is cut where its own content says so, each chunk is named by its SHA-256, and the
names are verified once against the chunk contents: a digest that two different contents
share is replaced, in every recipe, by the content itself. Documents are then equal exactly
when their ordered lists of chunk identifiers are equal, so whole texts never meet in one
place; each distinct chunk moves once and afterwards only identifiers move.

Defined results: null text counts as empty (an empty recipe, all empty texts are one group);
null doc_id is smaller than any; of repeated rows with one doc_id a single row is kept; other
columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, keep_rows, materialize, row_key

#: At least 512 characters, then up to the next white space before a word that starts like
#: this (about one place in 400), at most 8192; the tail is a chunk of its own.
CHUNK = r"(?s).{512,8191}?(?=[ \n\t][p-t][a-i][l-t])|.{1,8192}"


def chunk_texts(text: Column) -> Column:
    """The chunks of a text in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def _digest(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def clashing_digests(texts: DataFrame) -> DataFrame:
    """Digests that stand for more than one chunk content. ``texts`` has the column text.

    One shuffle moves each distinct chunk of a map task once (equal chunks of a hot group meet
    before it); a second one moves digests only.
    """
    contents = (
        texts.select(F.explode(chunk_texts(F.col("text"))).alias("chunk"))
        .select(_digest(F.col("chunk")).alias("digest"), "chunk")
        .distinct()
    )
    return contents.groupBy("digest").count().where("count > 1").select("digest")


def recipes(docs: DataFrame) -> DataFrame:
    """One row per document: row (unique), doc_id, text_sha256, recipe (verified identifiers).

    The list of clashing digests reaches the expressions as a scalar subquery. It is bounded by
    the birthday bound on SHA-256: for 10**12 chunks fewer than 10**-50 are expected.
    """
    texts = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("text"))
    clash = clashing_digests(texts).agg(F.collect_list("digest").alias("clash")).scalar()
    cut = texts.select(
        "doc_id",
        F.sha2("text", 256).alias("text_sha256"),
        chunk_texts(F.col("text")).alias("chunks"),
        clash.alias("clash"),
    ).withColumn("digests", F.transform("chunks", _digest))
    whole = F.transform(
        F.arrays_zip("chunks", "digests"),
        lambda x: F.when(
            F.array_contains("clash", x["digests"]),
            F.concat(x["digests"], F.encode(x["chunks"], "UTF-8")),
        ).otherwise(x["digests"]),
    )
    recipe = F.when(F.arrays_overlap("digests", "clash"), whole).otherwise(F.col("digests"))
    return cut.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text_sha256", recipe.alias("recipe")
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256. Texts compare with A-Z lower-cased.

    The groups are pre-aggregated before the shuffle; the join back goes through two exchanges of
    its own, so that a group with a third of all rows is split by the adaptive skew join.
    """
    listed = materialize(recipes(docs), "recipes").withColumn(
        "recipe_key", F.sha2(F.array_join(F.transform("recipe", F.hex), ","), 256)
    )
    last = F.max(F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("o"), "row")).alias("last")
    groups = listed.groupBy("recipe").agg(
        last, F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min("recipe_key").alias("recipe_key")
    )
    groups = groups.select("recipe", "recipe_key", "keep_id", "group_size", F.col("last.row").alias("keep_row"))
    return listed.join(groups, ["recipe_key", "recipe"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_duplicates(docs).where("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    return keep_rows(docs, F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256), kept)


def op1_exact_dedup(spark, sf_dir):
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t"""

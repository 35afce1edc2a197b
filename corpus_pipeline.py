"""A corpus pipeline: each stage reads the documents that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All
but the last return the columns of ``documents``; the last returns packed pieces.

Defined results: rows with null or empty text pass the toxicity stage by the prior's score, are one group in
exact dedup and one in near-dedup, are never taken into the mix as they have no words, and so are not packed.
A null doc_id is kept like any other unless a group has another row. Of repeated rows one stays. Very long
texts are taken whole, but the mix may cut one, at its words, where a source's share ends. Columns that
``documents`` does not name pass through, whatever their names. An empty table gives an empty result.
The toxicity stage learns from all labelled rows, so what it catches among them is no measure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableloom.llm import exact_dedup, mixing, near_jaccard, packing, toxicity
from tableloom.llm.common import materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash links of five-word shingles, verified at a Jaccard similarity of 0.8; pairs of that similarity whose
    fingerprints lie further apart are linked by prefix filtering (``near_jaccard``)."""
    return near_jaccard.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained scores, tokens and hashed orders have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

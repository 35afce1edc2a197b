"""Records of runs: reading, keeping and summing them up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

RESULT = (
    "unique_id string, status string, execution_time double, message string, adapter_response map<string,string>, compiled_code string, "
    "timing array<struct<name:string,started_at:string,completed_at:string>>, failures bigint"
)


def read_run_results(spark: SparkSession, path: str) -> DataFrame:
    """One row for each result in JSON documents of the form {"results": [...]}."""
    raw = spark.read.schema(f"results array<struct<{RESULT.replace(' string', ':string').replace(' double', ':double').replace(' map', ':map').replace(' array', ':array').replace(' bigint', ':bigint')}>>")
    return raw.option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")


def write_run_results(spark: SparkSession, name: str, rows: DataFrame) -> float:
    """Append results to a table; returns the summed time, a negative time counting as none."""
    if tables.relation_type(spark, name):
        tables.append(spark, name, rows)
    else:
        tables.build_table(spark, name, rows)
    return rows.agg(F.coalesce(F.sum(F.greatest("execution_time", F.lit(0.0))), F.lit(0.0))).first()[0]


def run_summary(results: DataFrame) -> DataFrame:
    """n_pass, n_error, n_skip, n_total."""
    status = F.lower("status")
    kinds = {"n_pass": ("success", "pass"), "n_error": ("error", "fail", "runtime error"), "n_skip": ("skipped", "skip")}
    return results.agg(*[F.count_if(status.isin(*v)).alias(k) for k, v in kinds.items()], F.count(F.lit(1)).alias("n_total"))


def retry_set(results: DataFrame) -> DataFrame:
    """The ids whose run did not succeed."""
    return results.where(~F.coalesce(F.col("status") == "success", F.lit(False))).select("unique_id")

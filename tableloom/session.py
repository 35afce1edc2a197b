"""The session settings that results depend on, and tables kept between steps of a job."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
#: Tables that registered queries build are in this schema.
SCRATCH = "tableloom_scratch"


def pinned(spark: SparkSession) -> SparkSession:
    """Set what is a runtime setting on a session that somebody else has made."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where none is named, a local session gets a temporary one; on a cluster that is an error, as every
    machine would see another folder.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        root = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that this application writes to."""
    return f"{shared_dir(spark)}/tableloom-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the plan ends there, its size is known to the
    optimizer, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for these frames, which nothing may read afterwards, and let Spark
    drop the shuffle files of plans that are no longer referred to: it learns of those as the driver collects
    its garbage, which in a job of many steps can come late."""
    for df in frames:
        if path := getattr(df, "kept_at", None):
            delete(df.sparkSession, path)
    if spark := SparkSession.getActiveSession():
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete all that this application has kept: materialized steps and scratch tables. For the end of a
    run, when its results have been read or written."""
    delete(spark, own_dir(spark))
    spark.sql(f"DROP SCHEMA IF EXISTS {SCRATCH} CASCADE")

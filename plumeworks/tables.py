"""Intermediate tables on the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; only a local master may leave it unset, and gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="plumeworks-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage."""
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.saved_in = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Removes materialized tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.saved_in)


def release(spark: SparkSession) -> None:
    """Removes all of this application's materialized tables. A result that still reads one of them has to be written before."""
    _delete(spark, run_folder(spark))

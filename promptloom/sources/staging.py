"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else one set here: a temporary folder on one machine, a part of the warehouse on a cluster."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        base = "file://" + tempfile.mkdtemp(prefix="promptloom-")
    else:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_promptloom"
    spark.sparkContext.setCheckpointDir(base)
    return base


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: worked out once, and not again when an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space; everything else is part of a word.
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else one set here.

    Where the setting is missing a single-machine session gets a temporary
    folder; on a cluster the warehouse folder is used, never a local one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        base = "file://" + tempfile.mkdtemp(prefix="promptloom-")
    else:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_promptloom"
    spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


# Paths of this session's staged tables, in order.
STAGED: list[str] = []


def drop_staged(since: int, keep: int = 0) -> None:
    """Delete the staged tables from number ``since`` on, but for the last ``keep``; nothing may read them any more."""
    gone = STAGED[since : len(STAGED) - keep]
    for path in gone:
        where, folder = fs.FileSystem.from_uri(path)
        where.delete_dir(folder)
    del STAGED[since : len(STAGED) - keep]


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    What reads the result later doesn't recompute ``df``, and a lost executor
    costs nothing of it.
    """
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return a Python worker's free memory to the system.

    Spark keeps workers for later stages; what one stage's words and batches
    took would stay with them.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass

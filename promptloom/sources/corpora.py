"""Folders of numbered prompts, and the constraints that annotators found in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import promptfiles

ANNOTATION = "id string, category string, source string, constraints array<struct<type:string,anchor:string>>"


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, content) of the files that lie in the folder itself; many small ones are a task."""
    promptfiles.register(spark)
    return spark.read.format("prompt_files").option("patterns", pattern).load(folder)


def read_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text) of the files named by a number, a dash and anything, as ``07-agent.md``; ids are names without the ending."""
    named = _files(spark, folder, "*.md").select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("id"), F.col("content").alias("text"))
    return named.where(F.col("id").rlike("^[0-9]+-"))


def read_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """(id, category, source, type, anchor): a row per annotated constraint of the ``*.constraints.json`` files."""
    raw = _files(spark, folder, "*.constraints.json").select(F.from_json("content", ANNOTATION).alias("a"))
    return raw.select("a.id", "a.category", "a.source", F.inline("a.constraints"))


def misplaced(prompts: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations whose prompt is missing or doesn't hold the anchor."""
    joined = annotations.join(prompts.select("id", "text"), "id", "left")
    return joined.where(~F.coalesce(F.contains("text", "anchor"), F.lit(False))).drop("text")

"""A corpus pipeline of five of the training-data operators.

Each stage takes the rows that the one before it wrote and, but for the last, returns
their columns. An empty table gives an empty one at every stage; texts of any length go
in whole; extra columns are kept, whatever their names, up to packing, whose pieces have
columns of their own. What ties and repeated rows give is said at each stage's operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.llm.common import STAGED, drop_staged, stage, table
from promptloom.llm.mixing import training_order
from promptloom.llm.packing import pack_in_order
from promptloom.llm.pii import redact
from promptloom.llm.quality import drop_rejected
from promptloom.llm.queries import public_tokenizer
from promptloom.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep. Null and blank texts fail and go; a null language is a stratum; repeated rows stay."""
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, the least id. Null and blank texts are one group; rows without an id stay."""
    return drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data in its text replaced. A null text stays null."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes, in the order of training. A null source is the last source; blank texts have size 0."""
    return training_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, in windows of the order in which the rows lie in their Parquet files. Null texts are one separator."""
    # The stage before writes its range-sorted partitions as numbered files, a partition as one or more in turn.
    name = F.col("_metadata.file_name")
    numbers = [F.coalesce(F.regexp_extract(name, p, 1).try_cast("long"), F.lit(0)) for p in ("^part-([0-9]+)", "-c([0-9]+)[^-]*$")]
    part = numbers[0] * (1 << 20) + numbers[1]
    return pack_in_order(docs, public_tokenizer(), part, F.col("_metadata.row_index"))


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("personal data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

# Learned cutoffs and fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    begun = len(STAGED)
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "pipeline")
        # What the stage was worked out from is of no use once it is written.
        drop_staged(begun, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)

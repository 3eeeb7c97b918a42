"""Prompts and workloads made from the sample tables, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows of one task at most, where a millisecond goes into each.
PER_TASK = 20_000


def tasks(rows: DataFrame, per_task: int = PER_TASK) -> int:
    """As many as use all cores and keep each task short; counting a table takes its files' footers only."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // per_task))


def spread(rows: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """Deal rows over all cores, and over as many tasks as keep each of them short.

    A scan has no more tasks with rows than its files have row groups, however many cores
    there are, so their number tells nothing.
    """
    return rows.repartition(tasks(rows, per_task))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, text): a prompt with a request frame, a limit, a date, and a JSON region for each event."""
    return of_events(spread(table(spark, sf_dir, "events")))


def of_events(events: DataFrame) -> DataFrame:
    """The prompts of events, in whatever tasks these are."""
    day = F.date_format("ts", "yyyy-MM-dd")
    text = F.concat(
        F.lit("Please process event "),
        F.col("event_id").cast("string"),
        F.lit(" in order to "),
        F.col("event_type"),
        F.lit(". Never exceed 5 retries. You must answer in JSON for user_id "),
        F.col("user_id").cast("string"),
        F.lit(".\nCurrent date: "),
        day,
        F.lit("\nSee https://example.org/e/"),
        F.col("event_id").cast("string"),
        F.lit(".\n\nUser: what about {{topic}}?\nProps: "),
        F.col("props"),
    )
    return events.select("event_id", "event_type", "user_id", "ts", text.alias("text"))


PROMPTS = """prompts AS (
  SELECT event_id, event_type, user_id, ts,
         'Please process event ' || event_id || ' in order to ' || event_type
         || '. Never exceed 5 retries. You must answer in JSON for user_id ' || user_id
         || '.' || chr(10) || 'Current date: ' || strftime(ts, '%Y-%m-%d')
         || chr(10) || 'See https://example.org/e/' || event_id
         || '.' || chr(10) || chr(10) || 'User: what about {{topic}}?' || chr(10) || 'Props: ' || props AS text
  FROM events
)"""


def workloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache workload of each customer, in all columns that the advice needs."""
    k = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select(
        "c_custkey", (500 + (k * 37) % 6000).alias("original_tokens"), (1 + (k * 13) % 500).cast("long").alias("calls_per_day")
    )
    sized = base.select(
        "*",
        F.floor(F.col("original_tokens") * 0.9).alias("compressed_tokens"),
        F.floor(F.col("original_tokens") * 0.7).alias("prefix_tokens"),
    ).withColumn("dynamic_tokens", F.col("original_tokens") - F.col("prefix_tokens"))
    return sized.select(
        "*",
        F.floor(F.col("dynamic_tokens") * 0.9).alias("compressed_dynamic_tokens"),
        F.floor(F.col("prefix_tokens") / 2).alias("cacheable_today_tokens"),
        F.when(k % 3 == 0, F.lit(None)).otherwise((k % 4000).cast("double") + 1).alias("interval_seconds"),
    )


WORKLOADS = """sized AS (
  SELECT c_custkey, 500 + (c_custkey * 37) % 6000 AS original_tokens, 1 + (c_custkey * 13) % 500 AS calls_per_day FROM customer
), parts AS (
  SELECT *, CAST(floor(original_tokens * 0.9::DOUBLE) AS BIGINT) AS compressed_tokens,
         CAST(floor(original_tokens * 0.7::DOUBLE) AS BIGINT) AS prefix_tokens FROM sized
), workloads AS (
  SELECT *, original_tokens - prefix_tokens AS dynamic_tokens,
         CAST(floor((original_tokens - prefix_tokens) * 0.9::DOUBLE) AS BIGINT) AS compressed_dynamic_tokens,
         CAST(floor(prefix_tokens / 2) AS BIGINT) AS cacheable_today_tokens,
         CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 4000 AS DOUBLE) + 1 END AS interval_seconds
  FROM parts
)"""

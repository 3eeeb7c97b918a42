"""The row operators on streams, and token spend over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import frames


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files of prompts as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def rewritten(stream: DataFrame, level: str = "balanced", text: str = "text") -> DataFrame:
    """Rewriting keeps no state, so a stream passes through it as a table does."""
    return frames.with_rewrite(stream, level, text=text)


def spend(stream: DataFrame, text: str = "text", at: str = "ts", window: str = "1 hour", late: str = "2 hours", per_mtok: float = 1.0) -> DataFrame:
    """Tokens and dollars per window of event time; rows later than ``late`` are left out."""
    counted = stream.withWatermark(at, late).withColumn("tokens", T.estimated_tokens(F.col(text)))
    summed = counted.groupBy(F.window(at, window)).agg(F.count(F.lit(1)).alias("prompts"), F.sum("tokens").alias("tokens"))
    return summed.select("window.start", "prompts", "tokens", (F.col("tokens") / 1e6 * per_mtok).alias("dollars"))


def spent(stream: DataFrame, checkpoint: str, out: str, **how: str) -> None:
    """Write ``spend`` of what has arrived to ``out`` and stop; a later call goes on where this one has ended.

    A window is written once, when the watermark has passed it. The checkpoint and the files
    belong together and must lie where all executors reach them.
    """
    query = (
        spend(stream, **how)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

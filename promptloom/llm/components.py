"""Connected components of a link table, without driver-side state.

Alternating large-star and small-star rounds: every round rewires each vertex
to the least neighbour it knows, so the links shrink to one star per component
in a number of rounds that grows with the logarithm of the longest path. The
link count never grows. A vertex with very many links is a hot key of a
partial aggregation and of a sort-merge join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def _state(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``links`` (src, dst: long) -> (id, component_id), the least id reachable.

    Null ends and self links are dropped; vertices that occur in no other link
    are not returned (they are their own component). An empty table gives an
    empty one.
    """
    shared_dir(links.sparkSession)
    edges = (
        links.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(F.greatest(src, dst).cast("long").alias("a"), F.least(src, dst).cast("long").alias("b"))
        .distinct()
        .checkpoint()
    )
    before = _state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = _small_star(_large_star(edges)).checkpoint()
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    own = edges.select(F.col("b").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(own)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to the least vertex around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.join(least, "a")
        .where((F.col("b") > F.col("a")) & (F.col("b") != F.col("m")))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()

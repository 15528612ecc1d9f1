"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import scratch

#: Parts in which the neighbours of one node are reduced before they meet.
_PARTS = 32


def _least(edges: DataFrame, neighbour: str) -> DataFrame:
    """``u`` and its smallest neighbour ``m``; the star of a large component is reduced in parts."""
    parts = edges.groupBy("u", F.pmod(F.xxhash64(neighbour), F.lit(_PARTS)).alias("part")).agg(F.min(neighbour).alias("m"))
    return parts.groupBy("u").agg(F.min("m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it knows."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, "v").select("u", F.least("m", "u").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = _least(down, "v")
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns ``u, v``; returns ``node, component`` with the smallest node reachable.

    Nodes are returned that reach a smaller one; the smallest of a component is not.  Every round is written to the shared
    folder, so that neither lineage nor memory grows with the number of rounds, and nothing but a
    count and a checksum reaches the driver.  Rounds go on until nothing changes, which takes about the
    logarithm of the longest chain.
    """
    spark = edges.sparkSession
    path, current, before = None, scratch.materialize(edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct(), "edges"), None
    while True:
        now = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now.n:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, old, earlier = now, path, scratch.made(spark)
        current = scratch.materialize(_small_star(_large_star(current)).where("u <> v").distinct(), "edges")
        path = [p for p in scratch.made(spark) if p not in earlier]
        scratch.release(spark, old or [])

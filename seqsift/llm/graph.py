"""Connected components of a graph that no single task or the driver could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace


def _star(work: Workspace, edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (those above it, or those up to it) to the smallest node it knows."""
    both = edges.union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # Written, so that Spark sees two plain tables and splits a node with very many neighbours.
    least = work.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    joined = both.join(least, "u")
    out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select("v", "m").union(least).toDF("u", "v")
    out = work.table(out.where("u != v").distinct())
    work.drop(least)
    return out


def components(work: Workspace, edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (u long, v long): component is the smallest id reachable.

    Alternates large-star and small-star until nothing moves; each turn is a few joins on node ids and is written to
    the shared folder. Neighbours are never gathered in one row.
    """
    now = work.table(edges.where("u != v").select(F.col("u").cast("long"), F.col("v").cast("long")).distinct())
    before = None
    while True:  # settles after at most as many turns as the square of the logarithm of the nodes
        wide = _star(work, now, True)
        work.drop(now)
        now = _star(work, wide, False)
        work.drop(wide)
        state = tuple(now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first())
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()

"""Connected components as DataFrame operations."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import materialize


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, low): the smallest of a node and its neighbours. Edges are (u, v) in the direction they are to be read."""
    return edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_lowest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", F.col("low").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest node that every node of an edge can reach.

    Alternates large stars and small stars until nothing changes: the depth of a component halves each round, and no round has more edges
    than the one before. The minimum per node is aggregated before the shuffle, so a hub with most of the edges is one row
    per task; joins on a hub's key can be split. Edges with a null end and loops tell nothing; an empty table gives an empty one.
    """
    now = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    seen = now.agg(mark.alias("m")).first()["m"]
    while True:
        now = materialize(_small_star(_large_star(now)))
        found = now.agg(mark.alias("m")).first()["m"]
        if found == seen:
            break
        seen = found
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())

"""Connected components of a graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_shared, write_shared


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _is_star(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("k").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return seen.filter("out > 1 or (out = 1 and in = 1)").limit(1).count() == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: two long columns, in any direction, repeats and loops allowed.

    Returns (id, component): every id that has an edge to another id, and the smallest id
    that it reaches. Each step is a join and an aggregate on a key; neighbour lists are
    never gathered, so a hub with many edges is dealt out by the skew join. The number of
    steps grows with the logarithm of the number of ids. No edges: an empty table.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = write_shared(now, "edges")
    while not _is_star(now):
        then = write_shared(_small_star(_large_star(now)), "edges")
        drop_shared(now)
        now = then
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)

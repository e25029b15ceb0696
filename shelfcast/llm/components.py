"""Connected components of a graph of any size, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the smallest neighbour of u; combined on the map side first."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``root`` (the smallest id reachable) of every id in edges (u, v).

    Each round links a node's neighbours to the smallest of them; the number of rounds grows
    with the logarithm of the longest path, and every round is written, so that a lost
    executor costs part of one round. Loops and repeated edges do no harm.
    """
    spark = edges.sparkSession
    with shared.shuffles_dropped(spark):
        now = shared.written(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        down = large.filter("u <> v").distinct()
        small = _with_least(down)
        then = small.select("u", F.col("m").alias("v")).unionByName(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        with shared.shuffles_dropped(spark):
            then = shared.written(then, "edges")
        shared.removed(spark, now)
        state = then.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if state == seen:
            nodes = then.select(F.col("u").alias("id"), F.col("v").alias("root"))
            return nodes.unionByName(nodes.select(F.col("root").alias("id"), "root").distinct())
        now, seen = then, state

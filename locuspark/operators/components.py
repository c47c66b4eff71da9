"""Connected components of an edge table: alternating large-star and small-star steps, each a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    """Tells edge tables apart: their number and sums of two hashes."""
    one, two = F.xxhash64("u", "v"), F.xxhash64("v", "u", F.lit(1))
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(one.cast("decimal(38,0)")), F.bit_xor(two)).first())


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for every node of edges (a, b): root is the smallest node that it reaches.

    Self loops, repeated edges and rows with a null end change nothing. Every step aggregates by node with map-side
    combine and joins back; nothing but a fingerprint of the edges reaches the driver.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.write(edges, "edges")
    state = _state(edges)
    while True:
        # large star: the larger neighbours of a node, and the node, meet its smallest neighbour
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # small star: the smaller neighbours of a node, and the node, meet the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = large.join(least, "u")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.write(small, "edges")
        scratch.drop(edges)
        edges, now = after, _state(after)
        if now == state:
            break
        state = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())

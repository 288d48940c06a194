"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component``: the least node reachable, for every node with an edge to another.

    Self-loops and edges with a null end say nothing.  Every step keeps the components and makes the
    trees flatter; it ends when the edges are stars around least nodes.  Hubs are only met by grouped
    minima, which combine map-side, and by plain joins, which Spark can split.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo")))
    stars, before = cut_lineage(pairs.distinct()), None
    while True:
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        before = state
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(stars.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        stars = cut_lineage(small.union(root).distinct())

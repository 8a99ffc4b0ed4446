"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import durable


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): every node of edges (a, b) with the least node it
    reaches.  Alternates large-star and small-star steps, each a grouped minimum
    and a join, so no node's neighbours are ever gathered in one place; the
    number of rounds grows with the logarithm of the largest component."""
    edges = durable(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    seen = None
    for _ in range(rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = durable(small.union(down.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()

"""Connected components by alternating large and small stars, written to shared storage between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) to one row (node, root) for each node in them, root being the component's smallest node.

    Each round is two joins and aggregations with partial sums; a node of many neighbours is a skewed join key that
    adaptive execution splits, and no neighbour list is ever gathered. Loops and repeated edges are ignored; no edges
    give no rows. Rounds grow with the logarithm of the component's size; too many raise an error.
    """
    tidy = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(tidy(edges))
    before = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        # large star: of each node, the larger neighbours join its smallest
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = tidy(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small star: of each node, it and its smaller neighbours join the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = tidy(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))))
        after = materialize(small)
        discard(now)
        now = after
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

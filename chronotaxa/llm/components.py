"""Connected components by alternating large-star and small-star steps, all in DataFrames.

Each step replaces edges by edges to smaller neighbours and keeps components. It ends when the edges form
stars around their smallest members. Every step's edges are written to the shared folder. Degrees are
unbounded: minima are pre-aggregated, and joins on a hub can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stage


def connected_components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(node, root) for the nodes of ``edges(a, b)``, root being the smallest node; nodes without edges are absent."""
    now = stage.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage.write(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        small = stage.write(small, "small")
        stage.drop(now, large)
        seen = small.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        now = small
        if seen == state:
            break
        state = seen
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return stage.write(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), "roots")

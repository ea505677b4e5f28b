"""Connected components of an undirected graph by large-star and small-star steps, every step a distributed join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm._shared import Scratch

MAX_STEPS = 60


def connected_components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """edges (a long, b long), any order, repeats allowed -> (node, component), one row per node that has an edge.

    component is the smallest node reachable. Minima are pre-aggregated before each join, so a node with very many
    edges is split by adaptive execution like any skewed join key. Nothing but one row of totals reaches the driver.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), f"{tag}-0")
    seen = None
    for step in range(1, MAX_STEPS):
        both = now.select("v", "u").union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u"))).where("u <> v").distinct()
        now = scratch.save(small, f"{tag}-{step}")
        scratch.drop(f"{tag}-{step - 1}")
        total = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if total == seen:
            break
        seen = total
    else:
        raise RuntimeError(f"components did not settle in {MAX_STEPS} steps")
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct()

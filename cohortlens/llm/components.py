"""Connected components of an edge table, by alternating star steps.

Each round points every node at the smallest node around it, first the larger
neighbours of a node, then the smaller ones, until every component is a star
around its smallest node. A round is a few grouped minima (with partial sums
before the shuffle) and joins; its edges are written to the session's
checkpoint folder, so a lost executor replays one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import ensure_checkpoint_dir


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node that has an edge to another one, with the
    smallest node it can reach. Null ends, loops and repeated edges add nothing."""
    ensure_checkpoint_dir(edges.sparkSession)
    a, b = F.col(f"`{a}`"), F.col(f"`{b}`")
    now = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
           .where(F.col("u") > F.col("v")).where(a.isNotNull() & b.isNotNull()).distinct().checkpoint())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where(F.col("u") > F.col("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = (small.select("u", F.col("m").alias("v"))
               .unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
               .where(F.col("u") > F.col("v")).distinct().checkpoint())

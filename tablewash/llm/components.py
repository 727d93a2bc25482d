"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablewash.llm.common import Scratch, release


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, component`` (its smallest reachable node) of every node with an edge.

    ``edges``: columns a, b; loops and repeated edges do no harm. Each step links
    every node's neighbours to the smallest of them, which halves long paths; it is
    written to the shared folder, and the loop ends when nothing changes any more. What
    a step leaves in the driver goes before the next one.
    No node's neighbours ever meet in one row.
    """
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       .where("a <> b").distinct(), f"{name}-0")
    step, before = 0, None
    while True:
        # large star: each node's larger neighbours go to the smallest of the node and its neighbours
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .distinct())
        # small star: each node and its smaller neighbours go to the smallest of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        step += 1
        seen = Observation()  # of the rows as they are written
        after = scratch.keep(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")),
                             f"{name}-{step}")
        state = seen.get
        scratch.drop(f"{name}-{step - 1}")
        release(scratch.spark)
        if state == before:
            return after.select(F.col("a").alias("node"), F.col("b").alias("component"))
        now, before = after, state

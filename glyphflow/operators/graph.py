"""Connected components by alternating large-star and small-star steps.

No step collects a node's neighbours: each takes a minimum per node (combined before the shuffle), writes it, and joins it back by shuffle; as both sides of the
join are plain exchanges, the engine can split a node with very many links. Each round is written to the shared folder, and the one before it deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.storage import materialise, release


def _least(links: DataFrame) -> DataFrame:
    return materialise(links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")


def components(edges: DataFrame) -> DataFrame:
    """From links (u, v) to (node, root): each node that has a link and is not the least of its component, with that least node.

    Links to itself and repeated ones don't matter; nodes may be of any type that has an order; null ends are dropped; without links there are no rows."""
    now = materialise(edges.where("u != v").distinct(), "edges")
    state = None
    while True:
        # large star: every greater neighbour is linked to the least one
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialise(large, "edges")
        release(now)
        # small star: every node and its lesser neighbours are linked to the least of these
        lesser = _least(large)
        linked = large.join(lesser.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(linked.unionByName(lesser.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for done in (least, large, lesser):
            release(done)
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen

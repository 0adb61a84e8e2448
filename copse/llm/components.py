"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from copse.session import removed, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); a component is named by its least node.

    Every round hangs the neighbours of a node below the least of them, first
    the larger ones, then the others. Neighbour minima are combined before the
    shuffle and joined back, so a node of very many edges is no single group.
    Rounds are written, and end only when a round changes nothing; their number
    grows with the logarithm of the longest path. Null ends, loops and repeated
    edges link nothing; no edges give no rows.
    """
    # (u, v) with u > v: v is nearer to the root.
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .where("u > v").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: neighbours above u go below the least neighbour of u.
        large = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(
            F.col("w").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # Small star: u and its neighbours below go below the least of those.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        after = written(after, "edges")
        removed(now)
        now = after
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().join(
            now.select(F.col("u").alias("node")).distinct(), "node", "left_anti"))

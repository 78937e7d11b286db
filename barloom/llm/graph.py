"""Connected components of an edge table, as Spark joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import discard, written


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of edges (u, v), by alternating large and small stars.

    Each round joins edges with the least neighbour of their nodes, a partial aggregation, so a hub with many edges is
    one row on the other side of a join that Spark can split. Rounds are written to the shared folder; their number
    grows with the logarithm of the longest path. Loops and repeated edges are allowed; no edges give no rows.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    loops = edges.where("u = v").select(F.col("u").alias("node"))
    state = None
    while True:
        # large star: neighbours above a node move to its least neighbour
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: a node and its neighbours below move to the least of these
        large = written(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        before, now = now, written(small.where("u <> v").distinct(), "small-star")
        discard(before, large)
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen == state:
            break
        state = seen
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = found.select(F.col("component").alias("node")).union(loops).distinct()
    return found.union(roots.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))

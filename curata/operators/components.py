"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.plans.scratch import Scratch

#: Each pair of steps at least halves the depth of a tree, so this is beyond any real graph.
MAX_ROUNDS = 60


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component) for each node of an edge table; component is the smallest node of the connected component.

    Nodes may be of any orderable type. Self-loops give a component of one node; edges with a null end are ignored;
    direction and repeats don't matter. Neighbours are only ever reduced to their minimum, never gathered, so a hub of
    any degree is one aggregate row. Each round is written to the shared folder; nothing is collected but two numbers.
    """
    work = Scratch(edges.sparkSession, "components")
    raw = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna()
    start = raw.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, mark = work.table(start, "round0"), None
    loops = e.filter(F.col("u") == F.col("v")).select(F.col("u").alias("node"), F.col("v").alias("component"))
    links = e.filter(F.col("u") != F.col("v"))
    for k in range(1, MAX_ROUNDS):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of a node is linked to the smallest of the node and its neighbours
        large = links.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        # small star: all smaller neighbours of a node, and the node, are linked to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        links = work.table(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"round{k}")
        if k > 1:
            work.drop(f"round{k - 1}")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"no components after {MAX_ROUNDS} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    return found.union(loops.join(found, "node", "left_anti"))

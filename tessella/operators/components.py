"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.runtime import cut_lineage

MOST_ROUNDS = 60


def connected_components(edges: DataFrame, source: str, target: str) -> DataFrame:
    """``node, component`` of every node of an edge; the component is its smallest node.

    Alternates large-star and small-star steps (a logarithmic number of rounds in practice). Each step is a min-aggregate, combined on the
    map side, and a join with its result, so a node with very many edges is never collected. Null ends and self-loops
    link nothing; a node whose only edge is a self-loop is its own component.
    """
    ends = edges.select(F.col(source).alias("u"), F.col(target).alias("v")).filter("u is not null and v is not null")
    alone = ends.filter("u = v").select(F.col("u").alias("node")).distinct()
    links = cut_lineage(ends.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(MOST_ROUNDS):
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u")
        links = cut_lineage(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(below.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError(f"components not settled after {MOST_ROUNDS} rounds")
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = nodes.unionAll(roots)
    return found.unionByName(alone.join(found, "node", "left_anti").withColumn("component", F.col("node")))

"""Connected components of an undirected graph given as an edge table.

Alternating large-star and small-star rounds: every round is two groupings and joins over the edge
table, the result of a round is stored in the shared folder, and the number of rounds is logarithmic
in the longest path.  The lowest neighbours of the large-star step are stored before they are joined
back: that join then has its own exchange on both sides, so Spark can split the edges of a node with
very many neighbours.  The loop ends as soon as every edge leads to a root; only that one flag per round
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has two bigint columns u, v.  Returns (node, root): every node that has an edge to a
    different node, with the smallest node reachable; self-loops and nulls are ignored."""
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        # large-star: every larger neighbour of a node moves to the lowest node of its neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: every smaller neighbour of a node, and the node itself, moves to the lowest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # stars only: no node has two parents, none is a parent and a child
        roles = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                           F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("r"))
        roles = roles.groupBy("r.node").agg(F.sum("r.up").alias("up"), F.max("r.down").alias("down"))
        if roles.where("up > 1 or (up = 1 and down = 1)").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Connected components of a table of links, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkhop.llm.common import sized, written

MOST_BROADCAST = 400_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for links (a, b) of longs: the smallest node that each node can reach.

    Each round hangs every node's larger neighbours on its smallest neighbour, then its
    smaller ones and itself; links become stars after a number of rounds that grows with
    the logarithm of the nodes.  Only minima by node are aggregated, so a node may have any
    number of links.  Nodes without links don't appear; an empty table gives an empty one.
    """
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    n = links.count()
    for _ in range(rounds):
        # large star: neighbours above a node go to the smallest around it
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = links.select(F.col("v").alias("u"), F.col("u").alias("above")).join(sized(least, n, MOST_BROADCAST), "u").select(F.col("above").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "links")
        # small star: neighbours below a node, and the node, go to the smallest of them
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(sized(below, n, MOST_BROADCAST), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(below.select("u", F.col("m").alias("v"))).distinct()
        small = written(small, "links")
        # done once no node is both a root and under one
        same = small.join(sized(small.select(F.col("u").alias("v")), n, MOST_BROADCAST), "v", "left_semi").isEmpty() and small.groupBy("u").count().where("count > 1").isEmpty()
        links = small
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

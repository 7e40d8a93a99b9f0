"""Connected components of a distributed edge table, by contraction: nothing is collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is one node of its component, the same for all of it.

    Each round hooks every node to its least neighbour if that is less than itself, follows that pointer once more,
    and goes on with the distinct edges between what is left. At least half of the nodes with edges go each round.
    """
    edges = cut(edges.where("a <> b").select("a", "b").distinct())
    nodes = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        least = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("m"))
        up = cut(least.select(F.col("a").alias("node"), F.least("a", "m").alias("up")))
        over = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        up = cut(up.join(over, "up").select("node", "top"))
        maps.append(up)
        a, b = up.select(F.col("node").alias("a"), F.col("top").alias("ta")), up.select(F.col("node").alias("b"), F.col("top").alias("tb"))
        edges = cut(edges.join(a, "a").join(b, "b").where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct())

    def follow(at: DataFrame, up: DataFrame) -> DataFrame:
        return at.join(up.select(F.col("node").alias("root"), "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))

    return reduce(follow, maps, nodes.select("node", F.col("node").alias("root")))

"""Connected components of a stored edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclink.llm.common import join_hot, materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a, b``, of one integer type); root is the smallest node reachable.

    Each round links every node to the smallest of its neighbours; the rounds needed grow with the logarithm of the longest
    path. Sums by node are combined before they are shuffled, and every round is stored in the shared folder.
    """
    now = materialize(edges.where("a <> b").select("a", "b").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A node may have very many neighbours, which then do not meet in one task.
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        large = join_hot(both.where("b > a"), least, ["a"], "m", "n")
        large = materialize(large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # Every edge now points from the larger to the smaller node.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = materialize(small.where("a <> b").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

"""Connected components of a link table, by alternating large and small stars.

Each round points nodes at smaller neighbours, in two grouped passes whose work is linear in
the links; the number of rounds grows with the logarithm of the longest chain.  A node with very
many links is met by ``min`` per task before the shuffle, and by joins that can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trajmill import scratch


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a, b``); the root is the smallest node reached.

    Links to itself, repeated links and links with a null end do no harm; without links the result is empty.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("low")).distinct()
    pairs = scratch.materialize(pairs, "links")
    while True:
        both = pairs.unionByName(pairs.select(F.col("low").alias("node"), F.col("node").alias("low")))
        # Written down, so that the join below can split a node with very many links.
        lowest = scratch.materialize(both.groupBy("node").agg(F.least(F.min("low"), F.first("node")).alias("m")), "lowest")
        large = both.filter("low > node").join(lowest, "node").select(F.col("low").alias("node"), F.col("m").alias("low")).distinct()
        large = scratch.materialize(large, "large-star")
        lowest = scratch.materialize(large.groupBy("node").agg(F.min("low").alias("m")), "lowest")
        small = large.join(lowest, "node").filter("low <> m").select(F.col("low").alias("node"), F.col("m").alias("low"))
        pairs = scratch.materialize(small.unionByName(lowest.select("node", F.col("m").alias("low"))).distinct(), "small-star")
        children = pairs.groupBy("node").agg(F.count("*").alias("n"))
        # Done when every child has one parent and no parent is a child.
        inner = pairs.select(F.col("low").alias("node")).distinct().join(children, "node", "left_semi")
        if children.filter("n > 1").select("node").unionByName(inner).isEmpty():
            break
    return pairs.select("node", F.col("low").alias("root")).unionByName(pairs.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())

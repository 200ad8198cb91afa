"""Connected components of a graph given as edges, without holding any of it on the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.staging import stage


def components(edges: DataFrame, stage: Callable[[DataFrame, str], DataFrame] = stage) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected to, for every node of an edge.

    ``edges`` has bigint columns ``a`` and ``b``. Every round hooks each node's root to the
    smallest root next to it and then halves the paths, so rounds grow with the logarithm
    of the longest path. Rounds are staged, by ``stage``, and only a count comes back.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(both.where("a <> b").distinct(), "edges")
    roots = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
                  .select("node", F.least("node", "root").alias("root")), "roots")
    while True:
        # Shorten: the root of the root.
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        short = roots.join(above, "root").select("node", F.col("upper").alias("root"))
        # Hook: the smallest root among a node's neighbours, offered to its own root.
        seen = both.join(short.select(F.col("node").alias("b"), F.col("root").alias("offer")), "b")
        best = seen.groupBy(F.col("a").alias("node")).agg(F.min("offer").alias("offer"))
        offered = short.join(best, "node").select("node", "root", F.least("root", "offer").alias("offer"))
        hooks = offered.groupBy(F.col("root").alias("node")).agg(F.min("offer").alias("hook"))
        merged = offered.join(hooks, "node", "left").select(
            "node", F.least("offer", F.coalesce("hook", "offer")).alias("root")
        )
        following = stage(merged, "roots")
        changed = following.join(roots.withColumnRenamed("root", "old"), "node").where("root <> old")
        if changed.isEmpty():
            return following
        roots = following

"""Connected components of links between 64-bit keys, by rounds of hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislerank.session import cut


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, root): every node that has a link and one key that its whole component shares.

    A round hooks each key to its smallest neighbour, jumps along these trees to their roots and replaces both ends of
    every link by its root. The number of open links falls by a constant factor, so rounds grow with the logarithm of
    the longest chain. Nothing but a row count reaches the driver; what a round reads is checkpointed.
    """
    links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots: DataFrame | None = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("a").alias("b"), F.col("b").alias("a")))
        tree = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up")))
        while True:
            above = tree.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = cut(tree.join(above, "up").select("node", "up", "top"))
            open_ends = not jumped.where("top <> up").isEmpty()
            tree = cut(jumped.select("node", F.col("top").alias("up"))) if open_ends else tree
            if not open_ends:
                break
        a = tree.select(F.col("node").alias("a"), F.col("up").alias("x"))
        b = tree.select(F.col("node").alias("b"), F.col("up").alias("y"))
        if roots is None:
            roots = tree.select("node", F.col("up").alias("root"))
        else:  # roots of earlier rounds that were hooked in this one
            roots = cut(roots.join(tree.select(F.col("node").alias("root"), "up"), "root", "left")
                        .select("node", F.coalesce("up", "root").alias("root")))
        links = cut(links.join(a, "a").join(b, "b").where("x <> y")
                    .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots

"""Connected components of a link table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelhouse.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the node's smallest neighbour (itself included)."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, link to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``links (a, b)``; root is the component's smallest node.

    A round joins links to one row a node; as that row comes from an aggregate,
    all links of a node meet in one task.  Each round is written to the shared
    folder; the number of rounds grows with the logarithm of the longest path.
    """
    now = written(links.where(F.col("a") != F.col("b")).distinct(), "links")
    before = None
    while True:
        now = written(_small_star(_large_star(now)).where(F.col("a") != F.col("b")).distinct(), "links")
        mark = now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if before is not None and tuple(mark) == tuple(before):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select("b", "b").distinct())
        before = mark

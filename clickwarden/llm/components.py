"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickwarden.llm.common import delete_folders, noted, saved


def components(links: DataFrame) -> DataFrame:
    """(node, root) from links (a, b): the smallest node that each node reaches. Roots themselves have no row.

    Each round hangs every node below the smallest neighbour, seen first from its larger neighbours and then from its smaller
    ones, until nothing changes; the rounds grow with the logarithm of the longest path. Minima are taken before the
    shuffle, so a node with many links costs no more than others; the joins are ones that Spark can split.
    """
    with noted() as folders:
        edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = (0, None, None)
    while (state := _state(edges)) != before:
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old = folders
        with noted() as folders:
            edges = saved(small.union(lower.select("a", F.col("m").alias("b"))).distinct())
        delete_folders(old, edges)
    return edges.toDF("node", "root")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
                    F.sum(F.col("b").cast("decimal(38,0)")).alias("s")).first()
    return tuple(row)

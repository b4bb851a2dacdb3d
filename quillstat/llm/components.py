"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import cut


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, comp) of every node of ``edges`` (columns a, b): comp is the least node it reaches.

    Alternates the large-star and small-star steps: each node links its larger
    neighbours, then its smaller ones, to the least of its neighbourhood, until
    all links are stars.  The tables stay the size of the edges.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = cut(large.distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        new = cut(small.distinct())
        # stars: no node is both a leaf and a centre, and no leaf has two centres
        roots = new.select(F.col("v").alias("u")).distinct()
        same = new.join(roots, "u", "left_semi").isEmpty() and new.count() == new.select("u").distinct().count()
        now = new
        if same:
            break
    else:
        raise ValueError(f"the components are not found after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())

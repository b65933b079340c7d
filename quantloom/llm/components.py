"""Connected components of a table of links, by alternating star operations on Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import store


def _large(links: DataFrame) -> DataFrame:
    """Each node points its larger neighbours at the least of its neighbourhood."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Each node points itself and its smaller neighbours at the least of them."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node that is not its own root; root is the least node reachable. Input: columns a, b of one ordered type.

    Neighbourhood minima are aggregates and joins, so a hub with a third of the links is combined before it is shuffled. Every round is written to the
    shared folder; the rounds grow with the logarithm of the longest chain. Links of a node to itself and repeated links change nothing.
    """
    seen, current = None, store.stored(_small(links.select("a", "b").filter("a != b")), "links")
    while True:
        now = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == seen or not now["n"]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, last, current = now, current, store.stored(_small(_large(current)), "links")
        store.drop(last)

"""Connected components by alternating stars; no node's links are ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketladder.session import stored


def _links(df: DataFrame) -> DataFrame:
    """Distinct links from the larger to the smaller node."""
    return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of every node are linked to its smallest neighbour (itself included)."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _links(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node, are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return _links(links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of links (a, b): the smallest node it is joined with.

    Each round is written to the shared folder; rounds end when nothing changes.
    Loops and repeated links don't matter; no links give an empty result.
    """
    links, before = stored(_links(links)), None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if state == before:
            break
        links, before = stored(_small_star(_large_star(links))), state
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(links.select(F.col("b"), F.col("b")).distinct())

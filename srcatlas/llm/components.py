"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): every node of ``links`` (a, b) with the smallest node that it reaches.

    Each round hangs all neighbours of a node, and the node itself, below the
    smallest of them (large star, then small star), until nothing changes; the
    rounds grow with the logarithm of the longest path. Minima are combined
    before the shuffle, so a node with very many links is no hot key there; the
    join back to its links is split by adaptive execution. The links of a round
    are written to shared storage, and only a count and a sum come to the driver.
    """
    edges = stored(_directed(links), "links")
    mark = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "links")
        facts = edges.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if tuple(facts) == mark:
            break
        mark = tuple(facts)
    # every node but the smallest now has one link, to the smallest
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _directed(links: DataFrame) -> DataFrame:
    """Larger node first, without loops and repeats."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """For each node: its larger neighbours go below the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
    larger = both.where("b > a")
    return _directed(larger.join(smallest, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """For each node: it and its smaller neighbours go below the smallest of them."""
    smallest = edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    hung = edges.join(smallest, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _directed(hung.unionByName(smallest.select(F.col("n").alias("a"), F.col("m").alias("b"))))

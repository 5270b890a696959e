"""Connected components of links, by rounds of star operations on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.llm.common import stored


def _hung(edges: DataFrame) -> DataFrame:
    """Every edge both ways beside the least node of the start's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.join(least, "a")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (its component's least node) of every node with a link.

    Links are rows of two different numbers ``a`` and ``b``. A round hangs the greater neighbours
    of each node on its least neighbour, then the lesser ones; it ends when every node hangs on
    its component's least. Minima are pre-aggregated, and the node on which a large component
    hangs meets its neighbours in a join of two plain exchanges, which Spark splits.
    """
    edges = stored(links.select("a", "b").distinct(), "edges")
    for _ in range(rounds):
        large = stored(
            _hung(edges).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large"
        )
        # from each node to its lesser neighbours: the least of them takes the others and the node
        least = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "small")
        if least.filter("n > 1").isEmpty():
            roots = least.select("a", "m")
            above = least.select(F.col("a").alias("m"), F.col("m").alias("top"))
            if roots.join(above, "m", "left_semi").isEmpty():
                nodes = roots.select(F.col("a").alias("node"), F.col("m").alias("root"))
                tops = roots.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct()
                return nodes.unionByName(tops)
        joined = large.join(least.select("a", "m"), "a")
        edges = stored(
            joined.filter("b > m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct(),
            "edges",
        )
    raise RuntimeError(f"components need more than {rounds} rounds")

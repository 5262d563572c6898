"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, unshuffled


def _settled(links: DataFrame) -> bool:
    """Whether all are stars: each u has one v, and no v is a u of another."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(links.select(F.col("v").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    return ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("high").alias("high")).filter("low > 1 or low > 0 and high > 0").isEmpty()


def _large_star(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The step's links, and the table that they read."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct(), least


def _small_star(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.put(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    hung = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct(), least


def components(edges: DataFrame, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """Rows (node, component) for every node of edges(a, b); component is its least node.

    Alternating large-star and small-star steps (Kiveris et al., "Connected
    Components in MapReduce and Beyond"): each is a minimum per node, which
    Spark combines before the exchange and writes, and a join back, which AQE
    splits where one node has very many links: both of its sides are exchanges
    of their own. A table in the shared folder ends
    each round, and rounds end once all parts are stars. Loops and repeated links are ignored.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now = scratch.put(now, "links")
    for _ in range(rounds):
        with unshuffled(scratch.spark):
            if _settled(now):
                break
        links, one = _large_star(now, scratch)
        large = scratch.put(links, "large")
        links, two = _small_star(large, scratch)
        was, now = now, scratch.put(links, "stars")
        scratch.drop(was, one, large, two)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

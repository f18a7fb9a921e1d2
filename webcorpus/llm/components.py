"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.session import Scratch


def _small(edges: DataFrame) -> DataFrame:
    """Edges as (larger, smaller) without loops or repeats."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every node has one root and no root hangs below another; one aggregation over counts of nodes."""
    nodes = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("root")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    use = nodes.groupBy("node").agg(F.sum("below").alias("below"), F.max("root").alias("root"))
    bad = F.col("below") + F.col("root") > 1
    return use.where((F.col("below") > 0) & bad).limit(1).count() == 0


def _towards_minimum(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Each node links its neighbours (all larger ones, or itself and its smaller ones) to the least of them."""
    sides = edges.union(edges.select("b", "a")) if both_ways else edges
    least = sides.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    met = sides.join(least, "a")
    if both_ways:
        return _small(met.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")))
    return _small(
        met.select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
    )


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)`` that isn't the least of its component.

    Each round is written, so the plan stays flat and a lost executor costs a re-read. A node with very many neighbours is
    reduced before the shuffle, and its rows in the join can be split. Ends when every component is one star.
    """
    found = scratch.write(_small(edges))
    while not _is_forest_of_stars(found):
        found = scratch.write(_towards_minimum(_towards_minimum(found, both_ways=True), both_ways=False))
    return found.select(F.col("a").alias("node"), F.col("b").alias("root"))

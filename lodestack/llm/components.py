"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import materialize


def _towards_minimum(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's (large: greater; else: not greater) neighbours are linked with the smallest of its neighbourhood.

    The minimum is aggregated before it is joined, so that a node with very many links is split like any skewed join key.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(low, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link to another; the component is its smallest node.

    ``links`` has two columns of one integer type; order, repeats and self links do not matter; rows with nulls are void.
    Each round is written to the shared folder, so a round is the most that a lost executor costs. The number of rounds
    grows with the logarithm of the longest chain.
    """
    x, y = links.columns
    edges = materialize(links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a <> b").distinct(), "links")
    seen = None
    while True:
        edges = materialize(_towards_minimum(_towards_minimum(edges, True), False), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = now

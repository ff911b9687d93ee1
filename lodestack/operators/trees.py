"""Trees of any depth in the order in which they are read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.rounds import settled

#: Bounds on the nodes that a chart shows.
FEWEST, MOST = 10, 200


def preorder(nodes: DataFrame, roots: DataFrame, shown: int) -> DataFrame:
    """(root, place, id, depth, total, truncated): the first ``shown`` nodes (10 to 200) of each root's tree, a node before its
    children, children by id; ``total`` counts all nodes of the tree.

    ``nodes`` has id and parent, ``roots`` has root. Roots that are no nodes have no rows; a node that is met again on its own path, in a
    cycle, is not. One round for each level; only the nodes of a level are looked at in it. What is sorted for a root is bounded by
    ``shown``, as each task keeps so many of a root at most.
    """
    shown = min(max(shown, FEWEST), MOST)
    children = nodes.where("parent is not null").select(F.col("parent").alias("_parent"), F.col("id").alias("_child")).distinct()
    start = roots.distinct().join(nodes.select("id").distinct(), F.col("root") == F.col("id"))
    level = settled(start.select("root", "id", F.array("id").alias("path")), "level")
    levels = []
    while not level.isEmpty():
        levels.append(level)
        below = level.join(children, F.col("id") == F.col("_parent")).where(~F.array_contains("path", F.col("_child")))
        level = settled(below.select("root", F.col("_child").alias("id"), F.concat("path", F.array("_child")).alias("path")), "level")
    if not levels:
        return level.select("root", F.lit(0).cast("long").alias("place"), "id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("total"), F.lit(False).alias("truncated"))
    every = reduce(DataFrame.unionByName, levels)
    totals = every.groupBy("root").agg(F.count("*").alias("total"))
    placed = every.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("path"))).where(F.col("place") <= shown)
    joined = placed.join(totals, "root")
    return joined.select("root", F.col("place").cast("long").alias("place"), "id", (F.size("path") - 1).cast("long").alias("depth"), "total", (F.col("total") > shown).alias("truncated"))

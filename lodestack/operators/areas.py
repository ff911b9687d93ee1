"""A page cut into areas, one for each of its boxes, in the order in which they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.rounds import settled, spread

#: Boxes of a page: below, there is nothing to cut; beyond, a page is taken for misread.
FEWEST, MOST = 2, 16
AXES = ("y", "x")


def _cut(open_: DataFrame, key: str) -> DataFrame:
    """One round: every area is cut at all its gaps from top to bottom, or else at its first from left to right, as what is right
    of that may have gaps from top to bottom again; ``axis`` is null if there is no gap."""
    area = Window.partitionBy(key, "path")
    for a in AXES:
        order = area.orderBy(f"{a}0", "box")
        gap = F.coalesce((F.max(f"{a}1").over(order.rowsBetween(Window.unboundedPreceding, -1)) <= F.col(f"{a}0")).cast("int"), F.lit(0))
        open_ = open_.withColumn("gap", gap).withColumn(f"{a}_band", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    chosen = open_.withColumn("axis", F.when(F.max("y_band").over(area) > 0, "y").when(F.max("x_band").over(area) > 0, "x"))
    pick = lambda c: F.when(F.col("axis") == "y", F.col(c.format("y"))).otherwise(F.col(c.format("x")))
    chosen = chosen.withColumns({"band": F.when(F.col("axis") == "y", F.col("y_band")).otherwise(F.least("x_band", F.lit(1))).cast("int"), "from": pick("{}0"), "to": pick("{}1")})
    bands = area.orderBy("band")
    before = F.max("to").over(bands.rangeBetween(Window.unboundedPreceding, -1))
    after = F.min("from").over(bands.rangeBetween(1, Window.unboundedFollowing))
    band = Window.partitionBy(key, "path", "band")
    chosen = chosen.withColumns({"low": (before + F.min("from").over(band)) / 2, "high": (F.max("to").over(band) + after) / 2})

    def side(a: str, i: int, cut: str) -> Column:
        return F.when(F.col("axis") == a, F.coalesce(cut, f"area_{a}{i}")).otherwise(F.col(f"area_{a}{i}"))

    sides = {f"area_{a}{i}": side(a, i, cut) for a in AXES for i, cut in ((0, "low"), (1, "high"))}
    return chosen.withColumns(sides).withColumn("path", F.when(F.col("axis").isNull(), F.col("path")).otherwise(F.concat("path", F.array("band")))).drop("gap", "y_band", "x_band", "band", "from", "to", "low", "high")


def reading_areas(boxes: DataFrame, key: str) -> DataFrame:
    """(key, place, box, area_x0, area_y0, area_x1, area_y1): each box's area and its place (from 1) on its page.

    ``boxes`` has the key, a number ``box`` and corners x0, y0, x1, y1 as shares of the page. A page is cut between groups of
    boxes that lie above each other, at the middle of the gap (boxes that only touch have a gap of nothing), each such group
    between those side by side, and so on until every area holds one box. Pages where boxes remain that no straight cut parts,
    with under FEWEST or over MOST boxes, or with a box of null, endless, empty or outlying corners, have no rows.
    """
    corners = [F.col(f"{a}{i}") for a in ("x", "y") for i in (0, 1)]
    good = F.coalesce((corners[0] >= 0) & (corners[0] < corners[1]) & (corners[1] <= 1) & (corners[2] >= 0) & (corners[2] < corners[3]) & (corners[3] <= 1), F.lit(False))
    pages = boxes.groupBy(key).agg(F.count("*").alias("n"), F.bool_and(good).alias("good")).where(F.col("good") & F.col("n").between(FEWEST, MOST)).select(key)
    start = {"path": F.array().cast("array<int>")} | {f"area_{a}{i}": F.lit(float(i)) for a in AXES for i in (0, 1)}
    open_ = settled(boxes.join(pages, key).select(key, "box", "x0", "y0", "x1", "y1").withColumns(start), "open")
    done, stuck = [], []
    while not open_.isEmpty():
        cut = settled(_cut(spread(open_, key, open_.count()), key), "cut")
        stuck.append(cut.where("axis is null").select(key).distinct())
        sized = cut.where("axis is not null").drop("axis").withColumn("n", F.count("*").over(Window.partitionBy(key, "path")))
        done.append(sized.where("n = 1"))
        open_ = settled(sized.where("n > 1").drop("n"), "open")
    if not done:
        return open_.select(key, F.lit(0).cast("long").alias("place"), "box", *[f"area_{a}{i}" for i in (0, 1) for a in ("x", "y")])
    alone, bad = done[0], stuck[0]
    for d in done[1:]:
        alone = alone.unionByName(d)
    for s in stuck[1:]:
        bad = bad.unionByName(s)
    whole = alone.join(bad.distinct(), key, "left_anti")
    place = F.row_number().over(Window.partitionBy(key).orderBy("path")).cast("long")
    return whole.select(key, place.alias("place"), "box", *[f"area_{a}{i}" for i in (0, 1) for a in ("x", "y")])

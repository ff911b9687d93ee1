"""Rows of a ledger: intervals cut into bands, guarded saves, bounded dispatch, lookups by the beginning of a name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bands(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``rows`` with ``band`` (long, from 1 in each key): intervals that touch or overlap share one, and gaps part them.

    Ties in ``start`` go by ``end``. Rows with a null bound are left out.
    """
    w = Window.partitionBy(key).orderBy(start, end)
    until = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("band", F.coalesce((F.col(start) > until).cast("long"), F.lit(1)))
    return cut.withColumn("band", F.sum("band").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))


def guarded_saves(events: DataFrame, key: str, task: str, begins: str, at: str, order: str, days: int = 1) -> DataFrame:
    """The saves (rows with ``begins`` false) with ``accepted``: the last begin of the key before them names their task, and is at most ``days`` days old.

    Begins are copied to the days on which they can count, so that a key is handled day by day, however long its history is.
    """
    day = F.datediff(F.col(at), F.lit("1970-01-01"))
    placed = events.withColumn("_day", F.explode(F.when(F.col(begins), F.sequence(day, day + days)).otherwise(F.array(day))))
    w = Window.partitionBy(key, "_day").orderBy(at, order).rowsBetween(Window.unboundedPreceding, -1)
    held = F.last(F.when(F.col(begins), F.struct(F.col(task).alias("task"), F.col(at).alias("at"))), ignorenulls=True).over(w)
    seen = placed.withColumn("_held", held).where(~F.col(begins))
    fresh = F.col(at) <= F.col("_held.at") + F.expr(f"interval {days} days")
    return seen.withColumn("accepted", F.coalesce(F.col("_held.task").eqNullSafe(F.col(task)) & fresh, F.lit(False))).drop("_day", "_held")


def dispatch(queue: DataFrame, key: str, active: str, ready: str, order: list[str], workers: int) -> DataFrame:
    """The ready rows of each key that the workers can take who are not busy with active ones, in order, with their ``place``.

    The bound is a constant, so Spark keeps ``workers`` rows a key and task before it sorts a key in one place.
    """
    busy = queue.groupBy(key).agg(F.count_if(F.col(active)).alias("_busy"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")
    first = queue.where(F.col(ready)).withColumn("place", place).where(F.col("place") <= workers)
    return first.join(busy, key).where(F.col("place") + F.col("_busy") <= workers).drop("_busy")


def by_beginning(names: DataFrame, catalogue: DataFrame, name: str, entry: str, position: str) -> DataFrame:
    """``names`` with the ``entry`` that equals them, else the first by position that starts with their part before the first dash, else null; and ``exact``.

    All beginnings of the catalogue's entries are laid out with the first entry of each, so that both tiers are equi-joins.
    """
    begin = F.substring_index(name, "-", 1)
    lengths = F.sequence(F.lit(0), F.length(entry))
    starts = catalogue.select(F.explode(F.transform(lengths, lambda n: F.substring(F.col(entry), F.lit(1), n))).alias("_begin"), entry, position)
    starts = starts.groupBy("_begin").agg(F.min_by(entry, position).alias("_first"))
    same = catalogue.select(F.col(entry).alias("_same")).distinct()
    met = names.withColumn("_start", begin).join(same, F.col(name) == F.col("_same"), "left").join(starts, F.col("_start") == F.col("_begin"), "left")
    return met.withColumn(entry, F.coalesce("_same", "_first")).withColumn("exact", F.col("_same").isNotNull()).drop("_same", "_start", "_begin", "_first")

"""Places of names in texts, and pairs of names that stand close to each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How far two names that belong together may be apart, in characters; how much around them is looked at; and
# words that say that they do not belong together.
NEAR, BEFORE, AFTER = 200, 40, 80
APART = ["not ", "different", "versus", "compared", "instead", "exclude", "不属于", "并非", "不同", "对比", "区别", "排除"]
_PART = "[a-z0-9._-]"


def places(texts: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, name, start, end): where the names of ``names`` (key, name) stand in the text of their key, start from 0.

    Case does not matter; a name that is part of a longer identifier does not count. ``texts`` has key, which is unique, and
    text; nulls and empty names have no places. A text is split at the name and the lengths of the pieces are summed, as rows.
    """
    wanted = names.where(F.length("name") > 0).select(key, F.lower("name").alias("name")).distinct()
    quoted = F.replace(F.col("name"), F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    pattern = F.concat(F.lit(rf"(?<!{_PART})\Q"), quoted, F.lit(rf"\E(?!{_PART})"))
    pieces = texts.select(key, F.lower("text").alias("text")).join(wanted, key).select(key, "name", F.posexplode(F.transform(F.split("text", pattern, -1), F.length)).alias("i", "n"))
    w = Window.partitionBy(key, "name").orderBy("i")
    size = F.length("name")
    start = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("i") * size
    summed = pieces.withColumns({"start": start, "more": F.lead("i").over(w).isNotNull()}).where("more")
    return summed.select(key, "name", F.col("start").cast("int").alias("start"), (F.col("start") + size).cast("int").alias("end"))


def near_pairs(left: DataFrame, right: DataFrame, key: str, near: int = NEAR) -> DataFrame:
    """(key, start, end): from the beginning of one place to the end of the other, for all pairs of a left and a right place of a
    key that span ``near`` characters at most. Places meet in stretches of that length and the next ones, so none is paired in vain with all others.
    """
    stretch = F.floor(F.col("start") / near)
    a = left.select(key, F.col("start").alias("a0"), F.col("end").alias("a1"), stretch.alias("at"))
    b = right.select(key, F.col("start").alias("b0"), F.col("end").alias("b1"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("at"))
    span = a.join(b, [key, "at"]).select(key, F.least("a0", "b0").alias("start"), F.greatest("a1", "b1").alias("end"))
    return span.where(F.col("end") - F.col("start") <= near)


def relations(texts: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, verdict, n_pairs, start, end) for every row of ``pairs`` (key, a, b), a key each.

    ``found`` if the two names stand near each other and no such place speaks of a difference (then start and end are the
    first place's), ``ambiguous`` if one does, ``none`` without a place. Names that are equal, or of under three characters for b, have none.
    """
    asked = pairs.where((F.lower("a") != F.lower("b")) & (F.length("b") >= 3))
    one = lambda c: places(texts, asked.select(key, F.col(c).alias("name")), key)
    met = near_pairs(one("a"), one("b"), key).groupBy(key).agg(F.collect_list(F.struct("start", "end")).alias("met"))  # of one text

    def doubtful(p):
        begin = F.greatest(p["start"] - BEFORE, F.lit(0))
        around = F.array(F.substring("low", begin + 1, p["end"] + AFTER - begin))  # made once for all words
        return F.exists(around, lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(t)) for t in APART]))

    seen = texts.select(key, F.lower("text").alias("low")).join(met, key).select(key, F.exists("met", doubtful).alias("doubt"), F.size("met").cast("long").alias("n"), F.array_min("met").alias("first"))
    joined = pairs.select(key).join(seen, key, "left")
    verdict = F.when(F.col("n").isNull(), "none").when(F.col("doubt"), "ambiguous").otherwise("found")
    place = lambda c: F.when(F.col("verdict") == "found", F.col(f"first.{c}"))
    return joined.withColumn("verdict", verdict).select(key, "verdict", F.coalesce("n", F.lit(0)).alias("n_pairs"), place("start").alias("start"), place("end").alias("end"))

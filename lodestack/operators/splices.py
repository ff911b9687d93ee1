"""Insertions and removals at places of texts, made in one go; and tables put back below the lines that announce them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spliced(texts: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """(key, text, n_applied, n_outside, n_overlapping) of ``texts`` (key, which is unique, and text) with their ``edits``.

    An edit (key, start, end, with, no) puts ``with`` in place of the characters from start (from 0) to end; nothing is taken out if
    both are equal. Places are those of the text that is given, so edits do not shift each other. They are made in the order of
    start, end, no: insertions at one place one after the other, those at the beginning of what is taken out before it, at its
    end after it. An edit that reaches outside of the text, or ends before it begins, or has a null place, is left out, and so is one
    that begins within what an edit before it has taken out. A null text has no places; a null ``with`` is empty.
    """
    given = edits.join(texts.select(key, F.length("text").alias("_n")), key)
    inside = F.coalesce((F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("_n")), F.lit(False))
    edit = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "no", F.coalesce("with", F.lit("")).alias("with"))
    listed = given.groupBy(key).agg(F.array_sort(F.collect_list(F.when(inside, edit))).alias("_edits"), F.count_if(~inside).alias("n_outside"))  # of one text
    whole = texts.select(key, "text").join(listed, key, "left")
    text, none = F.col("text"), F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("at"), none.alias("pieces"), F.lit(0).alias("made"))

    def step(acc, e):
        fits = e["start"] >= acc["at"]
        kept = F.substring(text, acc["at"] + 1, e["start"] - acc["at"])
        return F.when(fits, F.named_struct(F.lit("at"), e["end"], F.lit("pieces"), F.concat(acc["pieces"], F.array(kept, e["with"])), F.lit("made"), acc["made"] + 1)).otherwise(acc)

    done = F.aggregate("_edits", start, step, lambda acc: F.named_struct(F.lit("text"), F.concat(F.array_join(acc["pieces"], ""), F.substring(text, acc["at"] + 1, F.length(text))), F.lit("made"), acc["made"]))
    out = whole.withColumn("_done", F.when(F.col("_edits").isNotNull(), done))
    made = F.coalesce(F.col("_done.made"), F.lit(0))
    return out.select(key, F.coalesce("_done.text", "text").alias("text"), made.cast("long").alias("n_applied"), F.coalesce("n_outside", F.lit(0)).cast("long").alias("n_outside"), (F.coalesce(F.size("_edits"), F.lit(0)) - made).cast("long").alias("n_overlapping"))


def trimmed(line: Column) -> Column:
    """Without the spaces of any kind (Zs, such as no-break spaces) at both ends; tabs stay."""
    return F.regexp_replace(line, r"^\p{Zs}+|\p{Zs}++\z", "")


def below_anchors(texts: DataFrame, tables: DataFrame, key: str) -> DataFrame:
    """Edits (for ``spliced``) that set each table of ``tables`` (key, no, anchor, table) below the first line that, trimmed, is its anchor.

    Tables without an anchor, or with one that no line is, go to the text's end, in order of ``no``. Blank lines stand around each.
    """
    lines = texts.select(key, F.posexplode(F.split("text", "\n")).alias("i", "line"))
    ends = F.sum(F.length("line") + 1).over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    firsts = lines.withColumns({"end": ends, "anchor": trimmed(F.col("line"))}).where("anchor <> ''").groupBy(key, "anchor").agg(F.min("end").alias("at"))
    placed = tables.withColumn("anchor", trimmed(F.col("anchor"))).join(firsts, [key, "anchor"], "left").join(texts.select(key, F.length("text").alias("_n")), key)
    at = F.coalesce("at", "_n")
    return placed.select(key, at.alias("start"), at.alias("end"), F.concat(F.lit("\n\n"), "table", F.lit("\n")).alias("with"), "no")

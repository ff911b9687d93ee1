"""Calculation texts as sections and items with exact offsets, and texts tidied up with a map back to where they come from.

A text becomes rows of lines with their offsets; sections, items and notes follow from windows over the lines of a text. So one text is
what is sorted together, and only that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import spans as S
from lodestack.operators.rounds import settled

# How notes to a formula begin, what a definition looks like, what a label never holds and how long it may be.
NOTE = r"(?i)^(?:(?:Exception|Note)\s*:|Except\b|Unless\b|注[:：]|例外[:：])"
DEFINITION = r"^[^\s=—–:]{1,80}\s*[—–:]\s+\S"
NO_LABEL = r"[$\\=<>。.!?;；]"
LABEL_LENGTH = 160
HEADING = r"^#{1,6}\s+\S"


def _offsets(key: str) -> Column:
    """Where a line begins, from the lengths ``n`` of the lines before it."""
    before = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return (F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("i")).cast("int")


def _inside(at: Column) -> Column:
    return F.exists("spans", lambda s: (s["start"] <= at) & (at < s["end"]))


def text_lines(texts: DataFrame, key: str) -> DataFrame:
    """(key, start, end, value, spans): the lines of ``texts`` (key, text) that are not blank, without white space at their ends.

    A line break within a formula does not end a line. ``spans`` are the formulas of the line, by offsets of the text.
    """
    marked = texts.select(key, S.math_spans(F.col("text")).alias("spans"), F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("n", F.length("line"))
    placed = marked.withColumn("at", _offsets(key))
    broken = placed.withColumn("ends", (~_inside(F.col("at") + F.col("n"))).cast("int"))
    number = F.coalesce(F.sum("ends").over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = broken.withColumn("no", number).groupBy(key, "no").agg(F.min("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("line"), F.first("spans").alias("spans"))
    value = S.strip(F.col("line"))
    start = F.col("at") + F.length("line") - F.length(F.regexp_replace("line", r"^\s+", ""))
    rows = whole.withColumns({"value": value, "start": start}).where("value <> ''").withColumn("end", F.col("start") + F.length("value"))
    return rows.select(key, "start", "end", "value", F.filter("spans", lambda s: (s["start"] >= F.col("start")) & (s["start"] < F.col("end"))).alias("spans"))


def sections(texts: DataFrame, key: str) -> DataFrame:
    """(key, section, title, item, start, end, text, formulas): the items of ``texts`` (key, which is unique, and text).

    Sections begin at headings of number signs or, if a text has none, at lines that look like a label before a formula or a
    definition. A line is an item; one of formulas alone, side by side, is one for each. Notes after an item with a formula
    belong to it. ``start`` and ``end`` count characters of the text, and cut from it exactly ``text``. A section's items are
    numbered from 1; a section without items has one row with item 0 and its title's offsets. Nulls and blank texts have none.
    """
    lines = settled(text_lines(texts, key), "lines")  # read several times below
    ordered = Window.partitionBy(key).orderBy("start")
    whole = Window.partitionBy(key)
    following, after = F.lead("value").over(ordered), F.lead("spans").over(ordered)
    marked = F.regexp_like("value", F.lit(HEADING))
    leads = F.coalesce(F.get(after, F.lit(0))["start"] == F.lead("start").over(ordered), F.lit(False)) | F.coalesce(F.regexp_like(following, F.lit(DEFINITION)), F.lit(False))
    label = leads & (F.length("value") <= LABEL_LENGTH) & ~F.exists("spans", lambda s: s["complete"]) & ~F.regexp_like("value", F.lit(NO_LABEL)) & F.regexp_like("value", F.lit(r"^\p{Lu}|[\x{4e00}-\x{9fff}]"))
    said = lines.withColumns({"marked": marked, "label": label}).withColumn("explicit", F.max("marked").over(whole))
    said = said.withColumn("heading", F.col("marked") | (~F.col("explicit") & F.col("label")))
    said = said.withColumn("section", F.sum(F.col("heading").cast("int")).over(ordered) + F.when(F.first("heading").over(ordered), 0).otherwise(1))
    titles = said.where("heading").select(key, "section", F.regexp_replace("value", r"^#{1,6}\s+", "").alias("title"), F.col("start").alias("title_start"), F.col("end").alias("title_end"))

    # pieces of lines: formulas side by side are items of their own
    formulas = F.filter("spans", lambda s: s["complete"])
    gap = lambda x, y: F.substring(F.col("value"), x["end"] - F.col("start") + 1, y["start"] - x["end"])
    apart = F.forall(F.zip_with(F.slice("formulas", F.lit(1), F.greatest(F.size("formulas") - 1, F.lit(0))), F.slice("formulas", F.lit(2), F.greatest(F.size("formulas") - 1, F.lit(0))), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: S.strip(gap(p["x"], p["y"])) == "")
    body = said.where("not heading").withColumn("formulas", formulas)
    alone = (F.size("formulas") > 0) & (F.get("formulas", F.lit(0))["start"] == F.col("start")) & apart
    starts = F.when(alone, F.transform("formulas", lambda s: s["start"])).otherwise(F.array("start"))
    cuts = F.zip_with(starts, F.slice(F.concat(starts, F.array("end")), F.lit(2), F.size(starts)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pieces = body.select(key, "section", "value", "start", "spans", F.explode(cuts).alias("cut"))
    text = F.regexp_replace(F.substring(F.col("value"), F.col("cut.a") - F.col("start") + 1, F.col("cut.b") - F.col("cut.a")), r"\s+$", "")
    pieces = pieces.select(key, "section", F.col("cut.a").alias("start"), text.alias("text"), F.exists("spans", lambda s: (s["start"] >= F.col("cut.a")) & (s["start"] < F.col("cut.b"))).alias("math")).withColumn("end", F.col("start") + F.length("text"))

    # notes: one belongs to what stands before it if that, or a note before it there, has a formula
    note = F.regexp_like("text", F.lit(NOTE))
    within = Window.partitionBy(key, "section").orderBy("start")
    grouped = pieces.withColumn("note", note).withColumn("run", F.sum((~F.col("note")).cast("int")).over(within))
    before = Window.partitionBy(key, "section", "run").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    grouped = grouped.withColumn("joins", F.col("note") & F.coalesce(F.max("math").over(before), F.lit(False)))
    numbered = grouped.withColumn("item", F.sum((~F.col("joins")).cast("int")).over(within))
    items = numbered.groupBy(key, "section", "item").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    found = titles.join(items, [key, "section"], "full")
    placed = found.select(key, "section", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("item", F.lit(0)).alias("item"), F.coalesce("start", "title_start").alias("start"), F.coalesce("end", "title_end").alias("end"))
    cut = F.substring(F.col("whole"), F.col("start") + 1, F.col("end") - F.col("start"))
    out = placed.join(texts.select(key, F.col("text").alias("whole")), key).withColumn("text", cut)
    return out.select(key, F.col("section").cast("long").alias("section"), "title", F.col("item").cast("long").alias("item"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text", S.math_contents(F.col("text"), S.math_spans(F.col("text"))).alias("formulas"))


def tidied(texts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(tidy, map) of ``texts`` (key, text): white space at the ends of lines, and blank lines, taken out, but for lines that formulas touch.

    ``tidy`` has the key and text. ``map`` has the key, place, source and length of each run that was kept, and its text: ``length`` characters
    from ``place`` of the tidy text are those from ``source`` of the given one, in which a break of two characters counts as one.
    """
    plain = texts.select(key, F.regexp_replace("text", "\r\n?", "\n").alias("text"))
    marked = plain.select(key, S.math_spans(F.col("text")).alias("spans"), F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("n", F.length("line"))
    placed = marked.withColumn("at", _offsets(key))
    touched = F.exists("spans", lambda s: (s["start"] <= F.col("at") + F.col("n")) & (s["end"] > F.col("at")))
    kept = placed.withColumn("touched", touched).withColumn("kept", F.when(F.col("touched"), F.col("line")).otherwise(S.strip(F.col("line"))))
    kept = kept.where("touched or kept <> ''").withColumn("source", F.col("at") + F.when(F.col("touched"), 0).otherwise(F.col("n") - F.length(F.regexp_replace("line", r"^\s+", ""))))
    w = Window.partitionBy(key).orderBy("i")
    runs = settled(kept.withColumn("place", F.sum(F.length("kept") + 1).over(w) - F.length("kept") - 1).select(key, "i", "kept", "source", "place"), "runs")  # read twice below
    joined = runs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "kept"))), lambda x: x["kept"]), "\n").alias("joined"))
    ends = joined.select(key, S.strip(F.col("joined")).alias("text"), (F.length("joined") - F.length(F.regexp_replace("joined", r"^\s+", ""))).alias("lead"))
    tidy = plain.select(key).join(ends, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))
    # what is cut off at the text's own ends leaves the runs there shorter
    at = F.col("place") - F.col("lead")
    begin, end = F.greatest(at, F.lit(0)), F.least(at + F.length("kept"), F.col("n"))
    mapped = runs.join(ends.select(key, "lead", F.length("text").alias("n")), key).select(key, begin.alias("place"), (F.col("source") + begin - at).cast("int").alias("source"), (end - begin).alias("length"), F.substring(F.col("kept"), (begin - at + 1).cast("int"), (end - begin).cast("int")).alias("text"))
    return tidy, mapped.where("length > 0").select(key, F.col("place").cast("int").alias("place"), "source", F.col("length").cast("int").alias("length"), "text")

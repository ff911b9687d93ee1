"""Edge cases of the ledger operators and of marks in read pages."""

import datetime as dt

from pyspark.sql import functions as F

from lodestack.functions import marks as M
from lodestack.operators import ledger


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def texts(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_codes_and_marks(spark):
    assert texts(spark, M.language_code, " ZH-CN ", "English", "de", "", None) == ["zh", "en", "unknown", "unknown", "unknown"]
    assert texts(spark, M.is_unreadable, " N.A. ", "？", "", None, "nay") == [True, True, False, False, False]
    assert one(spark, M.first_text(F.lit(None).cast("string"), F.lit(" "), F.lit(" a "), F.lit("b"))) == "a"
    assert one(spark, M.first_text(F.lit(" "))) == ""


def test_formulas_and_tables(spark):
    assert texts(spark, M.formula_compact, "a \\, b\\ c", "\\mathrm{~h} = 1", "", None) == ["abc", "\\mathrm{h}=1", "", None]
    assert texts(spark, M.html_table_open, "<TABLE\nx>", "<table></table\n>", "</table><table>", "<tablet>", "") == [True, False, True, False, False]
    assert texts(spark, M.plain_markdown, "**a** $b$\n\n\n\nc ", "**", "") == ["a b\n\nc", "**", ""]
    cells = F.array(F.lit(" kW "), F.lit("x" * 25), F.lit("12.5 %"), F.lit("L"), F.lit("{a}"), F.lit(None).cast("string"), F.lit("kW"))
    assert one(spark, M.header_names(cells)) == ["kW"]
    assert one(spark, M.is_header(F.array(F.lit(""), F.lit("")))) is False
    assert one(spark, M.is_header(F.array(F.lit("1"), F.lit("")))) is True
    assert one(spark, M.is_header(F.array(F.lit("1"), F.lit("2"), F.lit("a")))) is False


def test_garbage(spark):
    lines = ["", "#$%", "ab$%", "ab$", "中文$$$$$", "中文..", "$$$$$$$$", "AAAA$$$$$$$$", "word $$$$$$$$$", "x" * 100000]
    assert texts(spark, M.is_garbage, *lines) == [False, True, False, False, False, False, True, True, False, False]


def test_anchor(spark):
    assert texts(spark, M.anchor_text, "Table 3 x", "## Head", "prose", "| a |", " ", None, "# " + "y" * 200) == ["Table 3 x", "Head", None, None, None, None, "y" * 120]


def test_bands_of_ties_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 5, 6), (1, 7, 9), (1, 7, 9), (1, 7, 8), (1, None, 3), (2, 0, 100), (2, 3, 4), (2, 50, 60), (2, 101, 101)], "k int, s int, e int")
    got = sorted((r.k, r.s, r.e, r.band) for r in ledger.bands(rows, "k", "s", "e").collect())
    assert got == [(1, 0, 5, 1), (1, 5, 6, 1), (1, 7, 8, 2), (1, 7, 9, 2), (1, 7, 9, 2), (2, 0, 100, 1), (2, 3, 4, 1), (2, 50, 60, 1), (2, 101, 101, 2)]
    assert ledger.bands(rows.where("k > 9"), "k", "s", "e").count() == 0


def test_saves_at_the_end_of_the_day_and_the_lease(spark):
    t = lambda day, hour: dt.datetime(2024, 1, day, hour)
    events = [(1, "a", 7, True, t(1, 23)), (2, "a", 7, False, t(2, 1)), (3, "a", 7, False, t(2, 23)), (4, "a", 7, False, t(3, 0)), (5, "a", 8, True, t(3, 1)), (6, "a", 7, False, t(3, 2)), (7, "b", 8, False, t(3, 2)), (8, "a", 8, False, t(3, 2)), (9, "a", None, True, t(3, 3)), (10, "a", None, False, t(3, 4))]
    rows = spark.createDataFrame(events, "id int, k string, task int, begins boolean, at timestamp")
    got = {r.id: r.accepted for r in ledger.guarded_saves(rows, "k", "task", "begins", "at", "id").collect()}
    assert got == {2: True, 3: True, 4: False, 6: False, 7: False, 8: True, 10: True}


def test_dispatch_with_busy_workers(spark):
    rows = spark.createDataFrame([(i, "q" if i < 8 else "r", i < 2, i >= 2) for i in range(10)], "id int, q string, active boolean, ready boolean")
    got = sorted((r.q, r.id, r.place) for r in ledger.dispatch(rows, "q", "active", "ready", ["id"], 4).collect())
    assert got == [("q", 2, 1), ("q", 3, 2), ("r", 8, 1), ("r", 9, 2)]
    assert ledger.dispatch(rows, "q", "active", "ready", ["id"], 2).where("q = 'q'").count() == 0


def test_by_beginning(spark):
    catalogue = spark.createDataFrame([("gpt-b", 2), ("gpt-a", 1), ("x", 0)], "entry string, at int")
    names = spark.createDataFrame([("gpt-b",), ("gpt-c",), ("y-1",), ("-1",), ("",), (None,)], "name string")
    got = {r.name: (r.entry, r.exact) for r in ledger.by_beginning(names, catalogue, "name", "entry", "at").collect()}
    assert got == {"gpt-b": ("gpt-b", True), "gpt-c": ("gpt-a", False), "y-1": (None, False), "-1": ("x", False), "": ("x", False), None: (None, False)}


def test_planning_words(spark):
    none = F.lit(None).cast("string")
    assert one(spark, M.needs_members(none, F.lit(None).cast("array<string>"), none)) is False
    assert one(spark, M.needs_members(F.lit("x"), F.array(none, F.lit("Membership")), none)) is True
    assert one(spark, M.needs_members(F.lit("listOrgs"), F.array(none), none)) is True
    assert texts(spark, M.asks_form, "A FORM", "请假表单", "flow", "", None) == [True, True, False, False, False]

"""Goals, descriptions and formulas in prose, case by case."""

import pytest
from pyspark.sql import functions as F

from lodestack.functions import prose as P


def each(spark, f, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    return [r.x for r in df.select("i", f(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]


def test_modes(spark):
    rows = [("Create a list", None), ("list all", None), ("the tool does", "other"), ("create", "mcp"), (None, None), ("", "cmdengine"), ("an address", None)]
    assert each(spark, P.task_mode, rows) == ["cmdengine", "mcp", "mcp", "mcp", "cmdengine", "cmdengine", "cmdengine"]
    assert each(spark, lambda a, b: P.asks_chart(a), [("Show the ORG chart", None), ("机构关系", None), (None, None), ("chart", None)]) == [True, True, False, False]


MISMATCH = [
    ("This is a longer English sentence.", "zh", True), ("这是一个中文句子。", "en", True), ("这是一个中文句子。", "zh", False), ("名称：This is hidden English prose! 这是一个中文句子", "zh", True), ("ab", "zh", False),
    ("This is a longer English sentence.", "de", False), (None, "zh", False), ("$$This is only a formula$$", "zh", False), ("<b>这是</b>中文", "en", True), ("This is a longer English sentence.", "English", False),
]


def test_mismatch(spark):
    assert each(spark, P.language_mismatch, [m[:2] for m in MISMATCH]) == [m[2] for m in MISMATCH]


VALID = [
    ("Equation (2.1)", None, ""), ("IV.", "", ""), ("Shear stress.", "shear stress", ""), ("Shear stress: 2-1", "shear stress", ""), ("Gives the stress. It contains 3 rows. At 2.5 MPa!", "x", "Gives the stress. At 2.5 MPa!"),
    ("语义缺失；说明应力。", None, "说明应力。"), (None, "x", ""), ("  words \n\n more ", None, "words   more"), ("see the source document", None, ""),
]


def test_descriptions(spark):
    got = each(spark, P.valid_description, [v[:2] for v in VALID])
    assert [" ".join(g.split()) for g in got] == [" ".join(v[2].split()) for v in VALID]


def test_blocks_and_variables(spark):
    df = spark.createDataFrame([(1, "a $$x$$ b $$y\nz$$"), (2, "none"), (3, None), (4, "$$$$")], "i int, t string")
    got = {r.i: None if r.b is None else [tuple(x) for x in r.b] for r in df.select("i", P.formula_blocks(F.col("t")).alias("b")).collect()}
    assert got == {1: [("a ", "$$x$$", " b "), (" b ", "$$y\nz$$", "")], 2: None, 3: None, 4: [("", "$$$$", "")]}
    after = [("式中：a 为 1\n\n\nb 为 2\n## Next\nc", None), ("no", None), ("x 式中:d\n2.1 more", None), ("式中：e\n $$f$$", None), (None, None), ("式中：" + "g" * 3000, None)]
    got = each(spark, lambda a, b: P.formula_variables(a), after)
    assert got[:5] == ["式中：a 为 1\nb 为 2", "", "式中:d", "式中：e", ""] and len(got[5]) == 1200


@pytest.mark.parametrize(("text", "layout", "want"), [("F = ma", "", False), ("x", "Inline_Formula", True), ("$MPa$", "", True), ("where a is b", "", True), (r"\(\Delta p_{1}\)", "", True), ("σ — stress", "", True), ("p 表示 压力", "", True), (r"\mathrm{mm}", None, True), ("", "", False), (None, None, False), (r"\int f", "", False)])
def test_formula_bodies(spark, text, layout, want):
    assert each(spark, P.is_formula_body, [(text, layout)]) == [want]

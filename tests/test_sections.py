"""Formulas, sections and maps of texts: offsets that cut exactly, nothing lost, and small texts by hand."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack import registry
from lodestack.functions import spans as S
from lodestack.operators import sections

SF = "/root/testdata/sf0.001"
SPANS = {
    "a $x$ b $$y$$": [(2, 5, True), (8, 13, True)],
    r"\$5 and $6": [(8, 10, False)],
    r"\begin{a}\begin{b}$\end{b}\end{a} z": [(0, 33, True)],
    r"\[ \begin{m} \] \end{m} \]": [(0, 26, True)],
    r"\( a $ b \) $": [(0, 11, True), (12, 13, False)],
    r"$ \begin{a} $ \end{a} $": [(0, 23, True)],
    r"\end{a} \] x": [],
    "$$ $ $$": [(0, 7, True)],
    "": [],
    None: [],
}


def test_math_spans(spark):
    rows = spark.createDataFrame(list(enumerate(SPANS)), "i int, t string")
    got = {r.t: [tuple(s) for s in r.s] for r in rows.select("t", S.math_spans(F.col("t")).alias("s")).collect()}
    assert got == SPANS
    row = rows.where("i = 0").select(S.math_contents(F.col("t"), S.math_spans(F.col("t")))).first()
    assert row[0] == ["x", "y"]


def cut(spark, text):
    rows = sections.sections(spark.createDataFrame([(1, text)], "k int, text string"), "k").orderBy("section", "item").collect()
    assert all(text[r.start : r.end] == r.text for r in rows)
    return [(r.section, r.title, r.item, r.text) for r in rows]


def test_sections_by_hand(spark):
    assert cut(spark, "intro\n# One\n$a$ $b$\n  Note: so\nUnless c\nplain\nNote: own\n# Two\n") == [
        (1, "", 1, "intro"), (2, "One", 1, "$a$"), (2, "One", 2, "$b$\n  Note: so\nUnless c"), (2, "One", 3, "plain"), (2, "One", 4, "Note: own"), (3, "Two", 0, "# Two"),
    ]
    assert cut(spark, "Stress\n$$s =\n f$$\nlower\nRatio — a part\nwords") == [(1, "Stress", 1, "$$s =\n f$$"), (1, "Stress", 2, "lower"), (1, "Stress", 3, "Ratio — a part"), (1, "Stress", 4, "words")]
    assert cut(spark, "Label\nRatio — a part") == [(1, "Label", 1, "Ratio — a part")]
    assert cut(spark, "$a$ b $c$ tail\n$open") == [(1, "", 1, "$a$ b $c$ tail"), (1, "", 2, "$open")]
    assert cut(spark, "Note: $n$\nNote: after") == [(1, "", 1, "Note: $n$\nNote: after")]
    assert cut(spark, " \n\n") == []


def squeezed(text):
    return "".join(text.split())


def check_whole(rows, texts):
    """Every span cuts its text, and together they hold all of the text but white space, in order."""
    by_key = {}
    for r in rows:
        assert texts[r[0]][r.start : r.end] == r.text
        by_key.setdefault(r[0], []).append(r)
    for k, text in texts.items():
        parts = []
        for r in sorted(by_key.get(k, ()), key=lambda r: (r.section, r.item)):
            if r.item <= 1 and r.title:
                parts.append(("#" if squeezed(text).count("#") else "") and "")
            parts.append(r.text if r.item else "")
        body = squeezed("".join(parts))
        missing = squeezed(text)
        for piece in [squeezed(p) for p in parts if p]:
            at = missing.find(piece)
            assert at >= 0
            missing = missing[:at] + missing[at + len(piece) :]
        titles = sum(len(squeezed(r.title)) for r in {(r.section, r.title): r for r in by_key.get(k, ())}.values())
        assert len(missing) - missing.count("#") <= titles and len(body) <= len(squeezed(text))


def test_random_texts_lose_nothing(spark):
    made = random.Random(51)
    lines = ["# Head", "## é 1", "$a$", "$$b$$ $c$", "  words here ", "", "Note: n", "Except this", r"\begin{x}", r"\end{x}", "Term — meaning", "Label", "$open", r"\$ 5", "\t"]
    texts = {i: "\n".join(made.choices(lines, k=made.randint(0, 12))) for i in range(150)}
    rows = sections.sections(spark.createDataFrame(list(texts.items()), "k int, text string"), "k").collect()
    check_whole(rows, texts)


def test_whole_table_is_cut_exactly(spark):
    rows = registry.QUERIES["calculation_items"](spark, SF)
    seen = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.size("formulas") > 0).alias("f"), F.count_if(F.col("end") - F.col("start") != F.length("text")).alias("bad")).collect()
    assert len(seen) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(r.f for r in seen) > 100 and sum(r.bad for r in seen) == 0


@pytest.mark.parametrize("text", ["  a \r\n\r\n b\t\r $x\n  y$ \n\n c ", "", "\n\n", None, "a", " $$\n \n", "x\n" * 500])
def test_tidied_maps_back(spark, text):
    tidy, mapped = sections.tidied(spark.createDataFrame([(1, text)], "k int, text string"), "k")
    out, plain = tidy.first().text, (text or "").replace("\r\n", "\n").replace("\r", "\n")
    runs = sorted((r.place, r.source, r.length) for r in mapped.collect())
    assert all(out[p : p + n] == plain[s : s + n] for p, s, n in runs)
    assert squeezed(out) == squeezed(plain)
    assert "".join(out[p : p + n] for p, _, n in runs) == out.replace("\n", "") or "$" in out

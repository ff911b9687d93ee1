"""Objects, quotations and names in texts against plain Python, and their edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestack.functions import spans
from lodestack.functions.labels import json_payload
from lodestack.operators import mentions


def first_object(text):
    """Character by character."""
    begin = text.find("{")
    depth, quoted, skip = 0, False, False
    for i in range(begin, len(text)) if begin >= 0 else ():
        c = text[i]
        if skip or c == "\\":
            skip = not skip
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[begin : i + 1]
    return None


def test_objects_equal_a_scan(spark):
    made = random.Random(21)
    texts = ["".join(made.choices(["{", "}", '"', "\\", "a", "\n", "é", '"k": 1'], k=made.randint(0, 25))) for _ in range(3000)] + ["", "{", "}{", "{}", "x" * 50_000 + "{" * 300 + "}" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.o for r in rows.select("i", spans.balanced_object(F.col("t")).alias("o")).collect()}
    assert [got[i] for i in range(len(texts))] == [first_object(t) for t in texts]
    assert spark.createDataFrame([(None,)], "t string").select(spans.balanced_object(F.col("t"))).first()[0] is None


def test_payload_is_no_part_of_a_broken_object(spark):
    texts = ['say {"a": {"b": 1}} now', 'say {"a": {"b": 1} now', '{"a": 1}', '```json\n{"a": {"b": 2}}\n```', "none", '{a} {"b": 1}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.o for r in rows.select("i", json_payload(F.col("t")).alias("o")).collect()}
    assert got == {0: '{"a": {"b": 1}}', 1: None, 2: '{"a": 1}', 3: '{"a": {"b": 2}}', 4: None, 5: None}


BODY = "The first anchor here. " + "filler " * 20 + "And the last anchor there. twice told tale, twice told tale"
QUOTES = [
    ("The first anchor ... last anchor there", "restored"), ("The first anchor…last anchor there", "restored"), ("last anchor there ... The first anchor", "none"), ("The first ... last anchor there", "none"),
    ("The first anchor ... twice told tale", "several"), ("The first anchor ... absent from text", "none"), ("The first anchor ... here ... last anchor there", "none"), ("The first anchor", "exact"), ("", "none"), (None, "none"),
]


def test_quotations(spark):
    rows = spark.createDataFrame([(i, BODY, q) for i, (q, _) in enumerate(QUOTES)] + [(90, None, "x"), (91, "x" * 20 + "-" * 5000 + "y" * 20, "x" * 20 + "..." + "y" * 20), (92, "aaaaaaaaaaaaaaaaaaaaaaaa end of it all", "aaaaaaaaaaaa...end of it all")], "i int, t string, q string")
    got = {r.i: r for r in rows.select("i", "t", spans.quotation(F.col("t"), F.col("q")).alias("q")).collect()}
    assert [got[i].q.state for i in range(len(QUOTES))] == [s for _, s in QUOTES]
    assert got[0].t[got[0].q.start :][: got[0].q.length].endswith("last anchor there") and got[0].q.start == 0
    assert [got[i].q.state for i in (90, 91, 92)] == ["none", "none", "several"]


def by_hand(text, a, b):
    text, a, b = (x.lower() for x in (text, a, b))
    at = lambda x: [m.span() for m in re.finditer(rf"(?<![a-z0-9._-]){re.escape(x)}(?![a-z0-9._-])", text)]
    met = sorted((min(p[0], q[0]), max(p[1], q[1])) for p in at(a) for q in at(b) if a != b and len(b) >= 3)
    met = [m for m in met if m[1] - m[0] <= 200]
    doubt = any(w in text[max(0, s - 40) : e + 80] for s, e in met for w in mentions.APART)
    verdict = "none" if not met else "ambiguous" if doubt else "found"
    return (verdict, len(met), *(met[0] if verdict == "found" else (None, None)))


def test_relations_equal_all_pairs(spark):
    made = random.Random(22)
    rows = []
    for i in range(150):
        words = made.choices(["glm-4", "GLM-4", "glm-4.6", "family", "Family", "x", "not ", "different", "pad" * 20, "(glm-4)", "\\Q", "é"], [4, 2, 2, 3, 1, 9, made.choice([0, 1]), 0.2, 6, 1, 1, 1], k=made.randint(0, 120))
        rows.append((i, " ".join(words), *made.choice([("glm-4", "family"), ("GLM-4", "FAMILY"), ("family", "Family"), ("glm-4", "x"), ("\\Q", "family"), ("glm-4.6", "pad" * 20)])))
    df = spark.createDataFrame(rows, "k int, text string, a string, b string")
    got = {r.k: (r.verdict, r.n_pairs, r.start, r.end) for r in mentions.relations(df.select("k", "text"), df.select("k", "a", "b"), "k").collect()}
    assert got == {k: by_hand(t, a, b) for k, t, a, b in rows}
    assert {v[0] for v in got.values()} == {"none", "ambiguous", "found"}


@pytest.mark.parametrize("text", [None, ""])
def test_relations_of_nothing(spark, text):
    df = spark.createDataFrame([(1, text, "abc", "def")], "k int, text string, a string, b string")
    assert mentions.relations(df.select("k", "text"), df.select("k", "a", "b"), "k").collect()[0][:3] == (1, "none", 0)

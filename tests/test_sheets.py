"""Projection, alignment and areas against brute force on random input, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import alignment, areas, projection

HEAD = "<tr><th>a</th><th>b</th></tr>"
SHAPES = {
    "good": (f"<table>{HEAD}<tr><td>1</td><td>&lt; 2</td></tr></table>", "complete", []),
    "thead": ("<table><thead><tr><td>a</td></tr></thead><tbody><tr><td>1</td></tr></tbody></table>", "complete", []),
    "none": (None, "unavailable", ["source_html_required"]),
    "blank": ("  ", "unavailable", ["source_html_required"]),
    "two": ("<table></table><table></table>", "unavailable", ["single_table_required"]),
    "empty": ("<table></table>", "unavailable", ["table_structure_unavailable"]),
    "span": (f'<table>{HEAD}<tr><td rowspan="101">1</td></tr></table>', "unavailable", ["input_budget_exceeded"]),
    "beyond": (f'<table>{HEAD}<tr><td rowspan="3">1</td><td>2</td></tr></table>', "unavailable", ["table_structure_unavailable"]),
    "cells": ("<table>" + "<tr><td>1</td></tr>" * 2001 + "</table>", "unavailable", ["input_budget_exceeded"]),
    "long": (f"<table>{HEAD}<tr><td>{'x' * 200_000}</td><td>1</td></tr></table>", "unavailable", ["input_budget_exceeded"]),
    "overlap": ('<table><tr><th>a</th><th rowspan="2">b</th></tr><tr><td colspan="2">1</td></tr></table>', "unavailable", ["overlapping_source_cells"]),
    "heads": (f"<table>{HEAD}{HEAD}</table>", "unavailable", ["ambiguous_header"]),
    "later": (f"<table><tr><td>1</td><td>2</td></tr>{HEAD}</table>", "unavailable", ["ambiguous_header"]),
    "caption": (f"<table><caption>see below</caption>{HEAD}<tr><td>1</td><td>2</td></tr></table>", "unavailable", ["conditional_source_requires_review"]),
    "loose": (f"<table>{HEAD}<tr><td>1</td><td>3 ~ 4</td></tr></table>", "unavailable", ["unsupported_condition"]),
    "both": (f"<table>{HEAD}<tr><td>~ 3</td></tr></table>", "unavailable", ["ragged_table_rows", "unsupported_condition"]),
}


def test_projection_shapes(spark):
    tables = spark.createDataFrame([(k, v[0]) for k, v in SHAPES.items()], "t string, html string")
    verdicts, records = projection.project(projection.source_cells(tables, "t", "html"), "t")
    assert {r.t: (r.status, r.reasons) for r in verdicts.collect()} == {k: v[1:] for k, v in SHAPES.items()}
    rows = {(r.t, r.row, r.col): (r.path, r.value, r.kind, r.published) for r in records.collect()}
    assert rows["good", 1, 1] == (["b"], "< 2", "interval", True)
    assert rows["loose", 1, 1] == (["b"], "3 ~ 4", "text", False)
    assert {k[0] for k in rows} == {"good", "thead", "loose"}


def test_projection_of_no_tables(spark):
    verdicts, records = projection.project(projection.source_cells(spark.createDataFrame([], "t long, html string"), "t", "html"), "t")
    assert verdicts.count() == records.count() == 0


def test_formulas_are_bound_with_their_label(spark):
    html = r"<table><tr><td>$a$ and $a$, $$b (2.1)$$</td><td>\(c \tag{7}\)</td></tr></table>"
    found = projection.cell_formulas(projection.source_cells(spark.createDataFrame([(1, html), (2, html)], "t int, html string"), "t", "html"), "t")
    asked = [(1, "r0c0", "$a$"), (1, "r0c0", "$$b (2.1)$$"), (1, "r0c1", r"\(c \tag{7}\)"), (1, "r0c1", "$a$"), (2, "r0c0", "$$b (2.1)$$"), (3, "r0c0", "$a$"), (None, "r0c0", "$a$")]
    named = spark.createDataFrame([(*x, i) for i, x in enumerate(asked)], "t int, source string, latex string, i int")
    got = {r.i: (r.verdict, r.source_ref, r.label) for r in projection.bound(found, named, "t").collect()}
    none = ("none", None, None)
    assert got == {0: ("several", None, None), 1: ("found", "1:r0c0:13:24", "2.1"), 2: ("found", "1:r0c1:0:13", "7"), 3: none, 4: ("found", "2:r0c0:13:24", "2.1"), 5: none, 6: none}


def align(rows, kinds):
    """All ways to leave columns out at both ends, one row after the other."""
    width, out, before = len(rows[0]), [], None
    columns = [[kinds["head", rows[0][j]]] + [kinds["cell", r[j]] for r in rows[1:] if len(r) == width] for j in range(width)]
    counts = [{k: c.count(k) for k in c if k != "blank"} for c in columns]

    def fit(v, n):
        kind = kinds["cell", v]
        if kind in ("blank", "unreadable"):
            return -50 if kind == "blank" else 0
        s = 300 + min(200, 40 * n[kind]) if kind in n else 0
        s += 150 * (kind in alignment.NUMBERS and any(k in n for k in alignment.NUMBERS))
        s -= 100 * (kind == "ratio" and ("integer" in n or "temperature" in n)) + 150 * (kind == "integer" and "ratio" in n) + 75 * (kind == "decimal" and "ratio" in n)
        s += 100 * (kind in ("material", "model", "text") and ("material" in n or "model" in n)) + 100 * (kind == "status" and "status" in n)
        return -100 if s == 0 and n else s

    for i, r in enumerate(rows):
        missing = width - len(r)
        if missing <= 0:
            out.append(("cut" if missing else "complete", None, r[:width], None))
        else:
            ways = []
            for left in range(missing + 1) if before and i else ():
                cells = before[1][:left] + r + before[1][left + len(r) :]
                score = sum(fit(v, counts[left + j]) for j, v in enumerate(r)) + sum(35 for j, v in enumerate(cells) if v and not left <= j < left + len(r))
                ways.append((-score, left, cells))
            ways.sort(key=lambda w: w[:2])
            if ways and -ways[0][0] >= 100 and ways[1][0] - ways[0][0] >= 200:
                out.append(("repaired", ways[0][1], ways[0][2], before[0]))
            else:
                out.append(("padded", None, r + [""] * missing, None))
        if i and missing == 0:
            before = (i, r)
    return out


@pytest.mark.parametrize("block", [4096, 2])
def test_alignment_equals_trying_all_ways(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    made = random.Random(11)
    cells = ["", "?", "5 %", "20 °C", "3 ~ 4", "1:2", "7", "7,5", "m#1", "steel rod", "plated", "word", "N/A"]
    heads = ["材料", "状态", "Size mm", "系数", "MPa", "word", "", "5 %"]
    tables = []
    for _ in range(40):
        width = made.randint(1, 5)
        typical = made.choices(cells, k=width)
        rows = [made.choices(heads, k=width)]
        for _ in range(made.randint(0, 9)):
            r = [v if made.random() < 0.7 else made.choice(cells) for v in typical]
            a, b = made.choice([(0, 0), (0, 0), (1, 0), (0, 1), (1, 1), (2, 0)])
            rows.append(r[a : len(r) - b] if a + b < width else r + ["more"])
        tables.append(rows)
    df = spark.createDataFrame([(t, i, r) for t, rows in enumerate(tables) for i, r in enumerate(rows)], "t int, row int, cells array<string>")
    values = spark.createDataFrame([(v,) for v in {*cells, *heads, "more"}], "v string")
    kinds = {}
    for r in values.select("v", alignment.cell_kind(F.col("v")).alias("c"), alignment.header_kind(F.col("v")).alias("h")).collect():
        kinds["cell", r.v], kinds["head", r.v] = r.c, r.h
    got = {(r.t, r.row): (r.state, r.skipped, r.cells, r.source_row) for r in alignment.aligned(df, "t").collect()}
    want = {(t, i): w for t, rows in enumerate(tables) for i, w in enumerate(align(rows, kinds))}
    assert got == want
    assert {w[0] for w in want.values()} == {"complete", "cut", "repaired", "padded"}


def cuts(boxes, area):
    """The reading order by recursion: one cut at a time, rows before columns; None if stuck."""
    if len(boxes) == 1:
        return [(boxes[0][0], area)]
    for axis in (1, 0):
        order = sorted(boxes, key=lambda b: b[1][axis])
        end = order[0][1][axis + 2]
        for i in range(1, len(order)):
            if end <= order[i][1][axis]:
                at = (end + order[i][1][axis]) / 2
                first, second = list(area), list(area)
                first[axis + 2] = second[axis] = at
                a, b = cuts(order[:i], first), cuts(order[i:], second)
                return a + b if a and b else None
            end = max(end, order[i][1][axis + 2])
    return None


def test_areas_equal_recursion(spark):
    made = random.Random(12)
    pages = {}
    for p in range(300):
        boxes = []
        for b in range(made.randint(1, 17)):
            x, y = made.randrange(12) / 12, made.randrange(12) / 12
            boxes.append((b, [x, y, x + made.choice([1, 1, 2, 5]) / 12, y + made.choice([1, 1, 2, 4]) / 12]))
        pages[p] = boxes
    pages[1000] = [(i, [0.0, i / 16, 1.0, (i + 1) / 16]) for i in range(16)]  # touching, as deep as it gets
    pages[1001] = [(0, [0.0, 0.0, 0.5, 1.0]), (1, [0.5, 0.0, 1.0, 0.0])]  # an empty box
    df = spark.createDataFrame([(p, b, *c) for p, boxes in pages.items() for b, c in boxes], "page int, box int, x0 double, y0 double, x1 double, y1 double")
    want = {}
    for p, boxes in pages.items():
        fine = all(0 <= c[0] < c[2] <= 1 and 0 <= c[1] < c[3] <= 1 for _, c in boxes) and 2 <= len(boxes) <= 16
        for place, (b, area) in enumerate((cuts(boxes, [0.0, 0.0, 1.0, 1.0]) or []) if fine else [], 1):
            want[p, place] = (b, *area)
    got = {(r.page, r.place): (r.box, r.area_x0, r.area_y0, r.area_x1, r.area_y1) for r in areas.reading_areas(df, "page").collect()}
    assert got.keys() == want.keys() and len({p for p, _ in got}) > 20
    assert [(k, g, want[k]) for k, g in got.items() if g[0] != want[k][0] or g[1:] != pytest.approx(want[k][1:])] == []


def test_areas_of_nothing(spark):
    schema = "page int, box int, x0 double, y0 double, x1 double, y1 double"
    rows = [(1, 1, 0.0, 0.0, 1.0, 1.0), (2, 1, None, 0.0, 1.0, 1.0), (2, 2, 0.0, 0.0, 1.0, 1.0), (3, 1, 0.0, 0.0, float("nan"), 1.0), (3, 2, 0.0, 0.0, 1.0, 1.0), (4, 1, 0.0, 0.0, 1.0, 1.0), (4, 1, 0.0, 0.0, 1.0, 1.0)]
    assert areas.reading_areas(spark.createDataFrame(rows, schema), "page").collect() == []
    assert areas.reading_areas(spark.createDataFrame([], schema), "page").collect() == []

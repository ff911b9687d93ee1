"""Executor patterns case by case, and trees against a walk."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import executors, trees

THERE = [(1, "role", "R"), (1, "role", "R"), (1, "member", "7"), (1, "member", "Ann"), (1, "tool", "T"), (1, "form_field", "F"), (2, "department", "D"), (1, "department", None)]
CASES = [
    (1, "static", {"type": "role", "value": "R"}, "valid"),
    (1, "static", {"type": "member", "value": "7"}, "valid"),
    (1, "static", {"type": "member", "value": "Bob"}, "not_found"),
    (1, "static", {"type": "department", "value": "D"}, "none_given"),
    (2, "static", {"type": "department", "value": "D"}, "valid"),
    (1, "static", {"value": "R"}, "missing_type"),
    (1, "static", {"type": "role", "value": ""}, "missing_value"),
    (1, "static", {"type": "robot", "value": "R"}, "unknown_type"),
    (1, "form_driven", {"form_field": "F"}, "valid"),
    (1, "form_driven", {}, "missing_form_field"),
    (2, "form_driven", {"form_field": "F"}, "none_given"),
    (1, "dynamic", {"mcp_tool": "U"}, "not_found"),
    (1, "dynamic", None, "missing_mcp_tool"),
    (1, "queue_claim", {"claim_group": "role", "group_name": "R"}, "valid"),
    (1, "queue_claim", {"claim_group": "member", "group_name": "Ann"}, "unknown_claim_group"),
    (1, "queue_claim", {"claim_group": "role"}, "missing_group_name"),
    (1, "automation", {"automation_type": "mcp_tool", "mcp_tool_name": "T"}, "valid"),
    (1, "automation", {"automation_type": "mcp_tool"}, "missing_mcp_tool_name"),
    (1, "automation", {"automation_type": "virtual_member", "virtual_member_name": "V"}, "valid"),
    (1, "automation", {"automation_type": "virtual_member"}, "missing_virtual_member_name"),
    (1, "automation", {"automation_type": "x"}, "unknown_automation_type"),
    (1, "automation", {}, "missing_automation_type"),
    (1, "other", {}, "unknown_pattern"),
    (1, None, {}, "unknown_pattern"),
    (None, "static", {"type": "role", "value": "R"}, "none_given"),
]


def test_patterns(spark):
    there = spark.createDataFrame(THERE, "tenant int, kind string, name string")
    tasks = spark.createDataFrame([(t, p, c, i) for i, (t, p, c, _) in enumerate(CASES)], "tenant int, pattern string, config map<string,string>, i int")
    out = executors.checked(tasks, there, "tenant")
    assert out.columns == ["tenant", "pattern", "config", "i", "verdict"]
    assert {r.i: r.verdict for r in out.collect()} == {i: c[3] for i, c in enumerate(CASES)}


def test_suggestions(spark):
    rows = spark.createDataFrame([(1, "CHOOSE if any"), (2, ""), (3, None), (4, "Validate " + "x" * 50_000)], "i int, t string")
    got = {r.i: [tuple(x) for x in r.s] for r in rows.select("i", executors.suggested(F.col("t")).alias("s")).collect()}
    assert got == {1: [("form_driven", 0.8), ("dynamic", 0.85), ("queue_claim", 0.75), ("static", 0.5)], 2: [("static", 0.5)], 3: [("static", 0.5)], 4: [("automation", 0.7), ("static", 0.5)]}


def walk(children, node, depth=0, seen=()):
    yield node, depth
    for c in sorted(children.get(node, ())):
        if c not in seen and c != node:
            yield from walk(children, c, depth + 1, (*seen, node))


@pytest.mark.parametrize("shown", [10, 25, 5000])
def test_preorder_equals_a_walk(spark, shown):
    made = random.Random(61)
    links = [(i, made.choice([None, made.randrange(120), i + 1, max(0, i - 1)])) for i in range(120)] + [(200, 201), (201, 202), (202, 200), (300, 300), (5, 7), (5, 7)]
    nodes = spark.createDataFrame(links, "id int, parent int")
    children = {}
    for i, p in links:
        if p is not None:
            children.setdefault(p, set()).add(i)
    roots = sorted({i for i, p in links if p is None}) + [200, 300, 999]
    got = {}
    for r in trees.preorder(nodes, spark.createDataFrame([(x,) for x in [*roots, roots[0]]], "root int"), shown).collect():
        got.setdefault(r.root, []).append((r.place, r.id, r.depth, r.total, r.truncated))
    bound = min(max(shown, 10), 200)
    for root in roots:
        path = list(walk(children, root)) if root != 999 else []
        assert sorted(got.get(root, [])) == [(k, i, d, len(path), len(path) > bound) for k, (i, d) in enumerate(path[:bound], 1)]


def test_no_trees(spark):
    assert trees.preorder(spark.createDataFrame([], "id int, parent int"), spark.createDataFrame([], "root int"), 10).collect() == []

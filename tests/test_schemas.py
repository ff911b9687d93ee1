"""Nodes, references, properties and fields of random nested JSON against walks in Python."""

import json
import random

from lodestack.operators import schemas


def made_json(made, depth=0):
    kind = made.random()
    if depth > 4 or kind < 0.25:
        return made.choice([1, 2.5, "text", True, None, "", "é"])
    if kind < 0.4:
        return [made_json(made, depth + 1) for _ in range(made.randint(0, 3))]
    if kind < 0.6:
        return {"$ref": made.choice(["#/", "#/a", "#/b", "#/a/b", "#/b/a", "#/c/0", "#/none", "other#/a", "#", "#/a/c"])}
    return {k: made_json(made, depth + 1) for k in made.sample(["a", "b", "c", "d"], made.randint(0, 3))}


def walk(value, path=""):
    yield path, value
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from walk(v, f"{path}/{k}")


def follow(at, holder):
    seen, hops, to = [holder], 0, at[holder]["$ref"]
    while True:
        hops += 1
        if not to.startswith("#/"):
            return to, "outside", hops
        target = to[1:]
        if target in seen:
            return target, "cycle", hops
        value = at.get(target)
        if not isinstance(value, dict):
            return target, "missing", hops
        if not isinstance(value.get("$ref"), str):
            return target, "found", hops
        seen.append(target)
        to = value["$ref"]


def test_nodes_and_references_equal_a_walk(spark):
    made = random.Random(41)
    docs = [(i, json.dumps({k: made_json(made) for k in "abc"}, ensure_ascii=False)) for i in range(250)]
    docs += [(900, None), (901, "{"), (902, ""), (903, '{"a":{"$ref":"#/a"}}'), (904, json.dumps({f"s{i}": {"$ref": f"#/s{i + 1}"} for i in range(12)} | {"s12": {}}))]
    values = schemas.nodes(spark.createDataFrame(docs, "k int, j string"), "k", "j")
    whole = {k: dict(walk(json.loads(j))) for k, j in docs if j and j != "{"}
    kind = lambda v: "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "scalar"
    assert {(r.k, r.path): r.kind for r in values.collect()} == {(k, p): kind(v) for k, at in whole.items() for p, v in at.items()}
    want = {(k, p): follow(at, p) for k, at in whole.items() for p, v in at.items() if isinstance(v, dict) and isinstance(v.get("$ref"), str)}
    got = {(r.k, r.path): (r.target, r.verdict, r.hops) for r in schemas.references(values, "k").collect()}
    assert got == want
    assert {v[1] for v in want.values()} == {"found", "missing", "cycle", "outside"} and want[904, "/s0"] == ("/s12", "found", 12)


def test_nothing_to_follow(spark):
    values = schemas.nodes(spark.createDataFrame([(1, "3"), (2, None)], "k int, j string"), "k", "j")
    assert [tuple(r) for r in values.collect()] == [(1, "", "scalar", "3")]
    assert schemas.references(values, "k").collect() == []
    assert schemas.properties(values, "k").collect() == []


def test_properties_through_objects_and_arrays(spark):
    spec = {"x": {"properties": {"a": {"type": "array", "items": {"required": ["b"], "properties": {"b": {"properties": {"c": {"type": "string"}}}}}}, "type": {"type": "number"}}, "required": ["type"]}}
    values = schemas.nodes(spark.createDataFrame([(1, json.dumps(spec))], "k int, j string"), "k", "j")
    got = {(r.field, r.type, r.required) for r in schemas.properties(values, "k", "/x").collect()}
    assert got == {("a", "array", False), ("a.b", "object", True), ("a.b.c", "string", False), ("type", "number", True)}


def field_walk(fields, above=""):
    for i, f in enumerate(fields):
        place = f"{above}/{i}" if above else str(i)
        f = f if isinstance(f, dict) else {}
        name, kind = f.get("id") or f.get("field_id"), f.get("type") or f.get("field_type")
        say = lambda issue: (place, name or "unknown", issue)  # noqa: B023, E731
        if not name or name == "unknown":
            yield say("missing_id")
        if kind not in schemas.LAYOUT_TYPES + schemas.PLAIN_TYPES:
            yield say("invalid_type")
            continue
        if not (f.get("label") or f.get("field_name")):
            yield say("missing_label")
        if f.get("width") and f["width"] not in schemas.WIDTHS:
            yield say("invalid_width")
        for rule in f.get("props", {}).get("validation", []):
            if not isinstance(rule, dict) or "type" not in rule:
                yield say("invalid_validation_rule")
        if kind in schemas.LAYOUT_TYPES:
            if not f.get("children"):
                yield say("empty_container")
            yield from field_walk(f.get("children", []), place)


def test_field_issues_equal_a_walk(spark):
    made = random.Random(42)

    def field(depth):
        f = {made.choice(["id", "field_id"]): made.choice(["a", "b", "unknown", ""]), made.choice(["type", "field_type"]): made.choice([*schemas.LAYOUT_TYPES, "text", "date", "odd"]), "label": made.choice(["L", ""]), "width": made.choice(["full", "wide"])}
        f = {k: v for k, v in f.items() if made.random() < 0.8}
        if made.random() < 0.3:
            f["props"] = {"validation": made.choices([{}, {"type": "min"}, 3, "x"], k=made.randint(0, 3))}
        if depth < 4 and made.random() < 0.7:
            f["children"] = [field(depth + 1) for _ in range(made.randint(0, 3))]
        return f

    forms = [(i, [field(0) for _ in range(made.randint(0, 3))]) for i in range(80)]
    df = spark.createDataFrame([(i, json.dumps(f)) for i, f in forms] + [(900, None), (901, "{}"), (902, "[")], "k int, f string")
    got = sorted(tuple(r) for r in schemas.field_issues(df, "k", "f", strict=True).collect())
    assert got == sorted((i, *issue) for i, f in forms for issue in field_walk(f))


def test_chains_within_one_round_are_followed_without_another(spark, monkeypatch):
    names, settled = [], schemas.settled
    monkeypatch.setattr(schemas, "settled", lambda df, name: names.append(name) or settled(df, name))
    chain = {f"s{i}": {"$ref": f"#/s{i + 1}"} for i in range(schemas.HOPS - 1)} | {f"s{schemas.HOPS - 1}": {}}
    values = schemas.nodes(spark.createDataFrame([(1, json.dumps(chain))], "k int, j string"), "k", "j")
    names.clear()
    got = {r.path: (r.target, r.verdict, r.hops) for r in schemas.references(values, "k").collect()}
    assert got == {f"/s{i}": (f"/s{schemas.HOPS - 1}", "found", schemas.HOPS - 1 - i) for i in range(schemas.HOPS - 1)}
    assert names == ["references", "met"]


def test_fields_are_written_without_what_they_were_taken_from(spark, monkeypatch):
    written, settled = [], schemas.settled
    monkeypatch.setattr(schemas, "settled", lambda df, name: written.append(df.columns) or settled(df, name))
    forms = [(1, '[{"id":"g","type":"group","label":"G","children":[{"id":"a","type":"blob"}]}]')]
    assert [tuple(r) for r in schemas.field_issues(spark.createDataFrame(forms, "k int, f string"), "k", "f").collect()] == [(1, "0/0", "a", "invalid_type")]
    assert written and not any("v" in columns for columns in written)

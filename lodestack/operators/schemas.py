"""JSON schemas and forms as rows: references followed to their end, properties and fields of any depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.rounds import settled, spread

# Types of fields that hold others, and those that do not; widths.
LAYOUT_TYPES = ["group", "tabs", "grid", "card"]
PLAIN_TYPES = ["text", "number", "date", "select", "checkbox"]
WIDTHS = ["full", "half", "third"]
#: References of a chain that are followed in one round.
HOPS = 8


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def nodes(documents: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, kind, text): every value within the JSON objects of ``documents``, under its path (``/a/b/0``; the whole: empty).

    ``kind`` is object, array or scalar; ``text`` the scalar as text, null for the others. Values that are no JSON, and nulls, have none.
    One round for each level of the deepest object; only what is nested goes on to the next.
    """
    level = documents.select(key, F.lit("").alias("path"), F.try_parse_json(json).alias("v")).where("v is not null")
    parts = []
    while True:
        kind = F.when(F.try_variant_get("v", "$", "map<string,variant>").isNotNull(), "object").when(F.try_variant_get("v", "$", "array<variant>").isNotNull(), "array").otherwise("scalar")
        scalar = F.col("kind") == "scalar"
        level = level.withColumn("kind", kind).select(key, "path", "kind", F.when(scalar, F.try_variant_get("v", "$", "string")).alias("text"), F.when(~scalar, F.col("v")).alias("v"))
        level = settled(level, "level")
        parts.append(level.select(key, "path", "kind", "text"))
        nested = level.where("kind <> 'scalar'")
        if nested.isEmpty():
            return _all(parts)
        spark = documents.sparkSession
        child = spark.sql(f"select t.`{key}`, t.path, c.pos, c.key as name, c.value as v from {{t}} t, lateral variant_explode(t.v) c", t=nested)
        step = F.coalesce("name", F.col("pos").cast("string"))
        level = child.select(key, F.concat("path", F.lit("/"), step).alias("path"), "v")


def references(values: DataFrame, key: str) -> DataFrame:
    """(key, path, target, verdict, hops) of every ``$ref`` among ``nodes``: ``path`` is that of what holds it.

    References are followed while what they point to holds one itself. The last target counts: ``found`` if it is an object, ``missing``
    if there is nothing or no object, ``outside`` if the reference does not begin with ``#/``, ``cycle`` if a target comes again (then
    ``target`` is that one). ``hops`` is the number of references followed.

    What each reference points to is joined to it once. Chains are followed within their document, up to HOPS links at once; a
    round for each further HOPS links of the longest chain takes what is still open.
    """
    refs = settled(values.where(F.endswith("path", F.lit("/$ref")) & (F.col("kind") == "scalar")).select(key, F.expr("substring(path, 1, length(path) - 5)").alias("holder"), F.col("text").alias("to")), "references")
    objects = values.where("kind = 'object'").select(key, F.col("path").alias("target"), F.lit(True).alias("there"))
    inner = F.when(F.startswith("to", F.lit("#/")), F.expr("substring(to, 2, length(to))"))
    links = refs.withColumn("target", inner).join(objects, [key, "target"], "left")
    link = F.struct(F.coalesce("target", "to").alias("target"), F.when(F.col("target").isNull(), "outside").when(F.col("there").isNull(), "missing").alias("end"))
    documents = spread(links, key, refs.count()).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("holder", link))).alias("links"))

    def start(holder: Column) -> Column:
        return F.struct(holder.alias("path"), holder.alias("target"), F.array(holder).alias("seen"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("verdict"))

    def onward(s: Column) -> Column:
        """The state after one more reference; one that has a verdict stays."""
        met = F.try_element_at("links", s["target"])
        moved = lambda m: F.struct(s["path"].alias("path"), m["target"].alias("target"), F.concat(s["seen"], F.array(m["target"])).alias("seen"), (s["hops"] + 1).alias("hops"), F.when((F.coalesce(m["end"], F.lit("")) != "outside") & F.array_contains(s["seen"], m["target"]), "cycle").otherwise(m["end"]).alias("verdict"))
        last = F.struct(s["path"].alias("path"), s["target"].alias("target"), s["seen"].alias("seen"), s["hops"].alias("hops"), F.lit("found").alias("verdict"))
        return F.when(s["verdict"].isNotNull(), s).otherwise(F.transform(F.array(met), lambda m: F.when(m.isNull(), last).otherwise(moved(m)))[0])

    followed = lambda states: F.transform(states, lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(HOPS)), s, lambda acc, _: onward(acc)))
    open_ = documents.select(key, "links", F.transform(F.map_keys("links"), start).alias("states"))
    done = []
    while True:
        met = settled(open_.select(key, "links", followed(F.col("states")).alias("states")), "met")
        ended = met.select(key, F.explode(F.filter("states", lambda s: s["verdict"].isNotNull())).alias("s"))
        done.append(ended.select(key, "s.path", "s.target", "s.verdict", F.col("s.hops").cast("long").alias("hops")))
        open_ = met.select(key, "links", F.filter("states", lambda s: s["verdict"].isNull()).alias("states")).where(F.size("states") > 0)
        if open_.isEmpty():
            return _all(done)


def properties(values: DataFrame, key: str, root: str = "") -> DataFrame:
    """(key, field, type, required): a row for each property below ``root``, nested ones with dots between the names.

    A property is required if the object that it belongs to names it among its ``required``. A missing type is ``object`` for what has
    properties and ``any`` else. Array items count as their array's properties.
    """
    step = r"(?:/items)*/properties/[^/]+"
    own = values.where("kind = 'object'").where(F.regexp_like("path", F.lit(rf"^\Q{root}\E(?:{step})+$")))
    parent = F.regexp_replace("path", r"/properties/[^/]+$", "")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = own.select(key, "path", parent.alias("parent"), name.alias("name"))
    types = values.where(F.endswith("path", F.lit("/type")) & (F.col("kind") == "scalar")).select(key, F.expr("substring(path, 1, length(path) - 5)").alias("path"), F.col("text").alias("type"))
    holds = values.where(F.endswith("path", F.lit("/properties")) & (F.col("kind") == "object")).select(key, F.expr("substring(path, 1, length(path) - 11)").alias("path"), F.lit("object").alias("implied"))
    needed = values.where(F.regexp_like("path", F.lit(r"/required/\d+$"))).select(key, F.regexp_replace("path", r"/required/\d+$", "").alias("parent"), F.col("text").alias("name"), F.lit(True).alias("required")).distinct()
    joined = rows.join(types, [key, "path"], "left").join(holds, [key, "path"], "left").join(needed, [key, "parent", "name"], "left")
    inner = F.expr(f"substring(path, {len(root) + 1}, length(path))")
    field = F.array_join(F.filter(F.split(F.regexp_replace(F.regexp_replace(inner, "/items(?=/)", ""), "/properties/", "\0"), "\0"), lambda x: x != ""), ".")
    return joined.select(key, field.alias("field"), F.coalesce("type", "implied", F.lit("any")).alias("type"), F.coalesce("required", F.lit(False)).alias("required"))


def field_issues(forms: DataFrame, key: str, fields: str, strict: bool = False) -> DataFrame:
    """(key, place, field, issue): what is wrong with a form's fields and, to any depth, with those within them.

    ``fields`` is a JSON array; ``place`` numbers each field among its siblings (``0/2/1``). Issues: missing_id, invalid_type (then nothing
    else of the field is looked at but its id, nor are its children), missing_label, invalid_width, empty_container (if ``strict``),
    invalid_validation_rule (once for each rule without a type). Old names (field_id, field_type, field_name) count.
    """
    text = lambda *names: F.coalesce(*[F.nullif(F.try_variant_get("v", f"$.{n}", "string"), F.lit("")) for n in names])
    level = forms.select(key, F.lit("").alias("above"), F.try_variant_get(F.try_parse_json(fields), "$", "array<variant>").alias("children"))
    parts = []
    while True:
        each = level.select(key, "above", F.posexplode("children").alias("i", "v"))
        place = F.concat("above", F.when(F.col("above") == "", "").otherwise("/"), F.col("i").cast("string"))
        rules = F.coalesce(F.try_variant_get("v", "$.props.validation", "array<variant>"), F.array().cast("array<variant>"))
        named = each.select(key, place.alias("place"), text("id", "field_id").alias("id"), F.coalesce(text("type", "field_type"), F.lit("")).alias("type"), text("label", "field_name").alias("label"), text("width").alias("width"), F.size(F.filter(rules, lambda r: F.try_variant_get(r, "$.type", "string").isNull())).alias("bad"), F.coalesce(F.try_variant_get("v", "$.children", "array<variant>"), F.array().cast("array<variant>")).alias("children"))
        named = settled(named, "fields")
        if named.isEmpty():
            break
        known = F.col("type").isin(LAYOUT_TYPES + PLAIN_TYPES)
        holds = F.col("type").isin(LAYOUT_TYPES)
        found = [F.array(F.when(F.col("id").isNull() | (F.col("id") == "unknown"), "missing_id"), F.when(~known, "invalid_type"), F.when(known & F.col("label").isNull(), "missing_label"), F.when(known & ~F.col("width").isin(WIDTHS), "invalid_width"), F.when(known & holds & (F.size("children") == 0) & F.lit(strict), "empty_container")), F.when(known, F.array_repeat(F.lit("invalid_validation_rule"), F.col("bad"))).otherwise(F.array().cast("array<string>"))]
        parts.append(named.select(key, "place", F.coalesce("id", F.lit("unknown")).alias("field"), F.explode(F.array_compact(F.concat(*found))).alias("issue")))
        level = named.where(known & holds & (F.size("children") > 0)).select(key, F.col("place").alias("above"), "children")
    return _all(parts) if parts else named.select(key, "place", F.col("id").alias("field"), F.lit("").alias("issue"))

"""Queries on JSON schemas and forms of any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.operators import executors, lookup, schemas, trees
from lodestack.registry import query, table

_NUMBERED = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with ``i``, their number within the order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return table(spark, sf, "lineitem").withColumn("i", F.row_number().over(w))


def _joined(x: str) -> Column:
    """The texts of an order's items, by number, with commas."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", x))), lambda s: s[x]), ",")


@query(f"""
with recursive l as (select l_orderkey as o, {_NUMBERED} as i, case when l_suppkey % 4 = 0 then 'object' when l_suppkey % 13 = 1 then 'text' when l_suppkey % 17 = 2 then 'outside' else 'ref' end as kind, (l_partkey % 6 + 1)::bigint as t from lineitem),
w(o, start, target, seen, hops, verdict) as (
  select o, i, case when kind = 'outside' then 0 else t end, [i], 1, case when kind = 'outside' then 'outside' end from l where kind in ('ref', 'outside')
  union all
  select w.o, w.start, case when l.kind = 'ref' and not list_contains(seen, w.target) then l.t when l.kind = 'outside' and not list_contains(seen, w.target) then 0 else w.target end, list_append(seen, w.target),
    case when list_contains(seen, w.target) or coalesce(l.kind, 'text') in ('text', 'object') then hops else hops + 1 end,
    case when list_contains(seen, w.target) then 'cycle' when coalesce(l.kind, 'text') = 'text' then 'missing' when l.kind = 'object' then 'found' when l.kind = 'outside' then 'outside' end
  from w left join l on l.o = w.o and l.i = w.target where w.verdict is null)
select o as l_orderkey, '/components/schemas/S' || start as path, case when target = 0 then 'other.json' else '/components/schemas/S' || target end as target, verdict, hops::bigint as hops from w where verdict is not null""")
def schema_references(spark: SparkSession, sf: str) -> DataFrame:
    """Where the references of each specification lead: chains to their end, with cycles, missing targets and other files told apart."""
    s = F.col("l_suppkey")
    value = (
        F.when(s % 4 == 0, '{"type":"object"}').when(s % 13 == 1, '"text"').when(s % 17 == 2, '{"$ref":"other.json"}')
        .otherwise(F.concat(F.lit('{"$ref":"#/components/schemas/S'), (F.col("l_partkey") % 6 + 1).cast("string"), F.lit('"}')))
    )
    entry = F.concat(F.lit('"S'), F.col("i").cast("string"), F.lit('":'), value)
    specs = _lines(spark, sf).withColumn("entry", entry).groupBy("l_orderkey").agg(F.concat(F.lit('{"components":{"schemas":{'), _joined("entry"), F.lit("}}}")).alias("spec"))
    return schemas.references(schemas.nodes(specs, "l_orderkey", "spec"), "l_orderkey")


@query("""
with recursive p as (select p_partkey, p_partkey % 5 as d, p_size, p_brand from part),
n as (select p_partkey, d, p_size, p_brand, 0 as depth, 'n0' as field from p union all select p_partkey, d, p_size, p_brand, depth + 1, field || '.n' || (depth + 1) from n where depth < d)
select p_partkey, field, case when depth < d then case when p_size % 2 = 0 then 'object' else 'array' end when p_size % 3 = 0 then 'any' else 'string' end as type, (p_size + depth) % 3 = 0 as required from n
union all select p_partkey, 'note', 'number', p_size % 3 = 0 from p""")
def schema_properties(spark: SparkSession, sf: str) -> DataFrame:
    """A schema's properties with dotted names, through objects and arrays of objects, to any depth."""
    size, d = F.col("p_size"), (F.col("p_partkey") % 5).cast("int")
    needs = lambda depth: F.when((size + depth) % 3 == 0, F.concat(F.lit('"required":["n'), depth.cast("string"), F.when(depth == 0, '","note"],').otherwise('"],'))).otherwise("")
    leaf = F.when(size % 3 == 0, "{}").otherwise('{"type":"string"}')

    def wrap(inner, k):
        """The property around ``inner``, of depth d - k: an object, or an array of objects."""
        depth = d - k + 1
        body = F.concat(needs(depth), F.lit('"properties":{"n'), depth.cast("string"), F.lit('":'), inner, F.lit("}"))
        return F.when(size % 2 == 0, F.concat(F.lit('{"type":"object",'), body, F.lit("}"))).otherwise(F.concat(F.lit('{"type":"array","items":{'), body, F.lit("}}")))

    steps = F.when(d > 0, F.sequence(F.lit(1), d)).otherwise(F.array().cast("array<int>"))
    tree = F.aggregate(steps, leaf, wrap)
    spec = F.concat(F.lit("{"), needs(F.lit(0)), F.lit('"properties":{"n0":'), tree, F.lit(',"note":{"type":"number"}}}'))
    return schemas.properties(schemas.nodes(table(spark, sf, "part").select("p_partkey", spec.alias("spec")), "p_partkey", "spec"), "p_partkey")


@query(f"""
with l as (select l_orderkey as o, {_NUMBERED} - 1 as i, l_partkey as p, l_suppkey as s from lineitem),
g as (select o, o % 11 = 0 as bad_group, o % 5 = 0 as bare, count(*) filter (where i > 0) as n from l group by o),
f as (select o, '0/0/' || (i - 1) as place, i, p, s from l join g using (o) where not bad_group and i > 0 union all select o, '1', i, p, s from l where i = 0),
e as (select *, case when p % 9 = 0 then 'unknown' else 'f' || i end as field, ['text', 'number', 'grid', 'date', 'blob', 'select', 'card'][p % 7 + 1] as type from f),
issues as (
  select o, place, field, 'missing_id' as issue from e where p % 9 = 0
  union all select o, place, field, 'invalid_type' from e where type = 'blob'
  union all select o, place, field, 'missing_label' from e where type <> 'blob' and s % 6 = 0
  union all select o, place, field, 'invalid_width' from e where type <> 'blob' and s % 5 = 1
  union all select o, place, field, 'empty_container' from e where type in ('grid', 'card')
  union all select o, place, field, 'invalid_validation_rule' from e, range(2) r(k) where type <> 'blob' and k < s % 3
  union all select o, '0', 'g', 'invalid_type' from g where bad_group
  union all select o, '0/0', 't', 'missing_label' from g where bare and not bad_group
  union all select o, '0/0', 't', 'empty_container' from g where n = 0 and not bad_group)
select o as l_orderkey, place, field, issue, count(*) as n from issues group by all""")
def form_field_issues(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with the fields of forms, those within groups and tabs included; a field of an unknown type hides what it holds."""
    p, s, o = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    kinds = F.array(*[F.lit(x) for x in ("text", "number", "grid", "date", "blob", "select", "card")])
    none = F.lit("")
    name = F.when(p % 9 == 0, none).otherwise(F.concat(F.when(p % 2 == 0, '"id":"f').otherwise('"field_id":"f'), (F.col("i") - 1).cast("string"), F.lit('",')))
    label = F.when(s % 6 == 0, none).otherwise('"label":"L",')
    width = F.when(s % 5 == 1, '"width":"wide",').when(s % 5 == 2, '"width":"half",').otherwise(none)
    rules = F.concat(F.lit('"props":{"validation":[{"type":"min"}'), F.repeat(F.lit(',{"max":1}'), (s % 3).cast("int")), F.lit("]}"))
    field = F.concat(F.lit("{"), name, F.lit('"type":"'), F.get(kinds, (p % 7).cast("int")), F.lit('",'), label, width, rules, F.lit("}"))
    lines = _lines(spark, sf).withColumn("field", field)
    first = F.max(F.when(F.col("i") == 1, F.col("field")))
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("i") > 1, F.struct("i", "field")))), lambda x: x["field"]), ",")
    forms = lines.groupBy("l_orderkey").agg(first.alias("first"), inner.alias("inner"))
    group = F.when(o % 11 == 0, "pane").otherwise("group")
    tab = F.concat(F.lit('{"id":"t","type":"tabs",'), F.when(o % 5 == 0, none).otherwise('"label":"T",'), F.lit('"children":['), F.col("inner"), F.lit("]}"))
    form = F.concat(F.lit('[{"id":"g","type":"'), group, F.lit('","label":"G","children":['), tab, F.lit("]},"), F.col("first"), F.lit("]"))
    found = schemas.field_issues(forms.select("l_orderkey", form.alias("form")), "l_orderkey", "form", strict=True)
    return found.groupBy("l_orderkey", "place", "field", "issue").agg(F.count("*").alias("n"))


@query("""
with t as (select c_custkey as task, c_nationkey as n, ['static', 'form_driven', 'dynamic', 'queue_claim', 'automation', 'other', 'static'][c_custkey % 7 + 1] as p, c_custkey // 7 as k, c_mktsegment as segment, c_name as name from customer),
s as (select s_nationkey as n, s_suppkey, s_name from supplier),
a as (select n, 'role' as kind, 'R' || s_suppkey % 4 as name from s union select n, 'member', s_name from s union select n, 'member', cast(s_suppkey as varchar) from s union select n, 'tool', 'T' || s_suppkey % 3 from s where s_suppkey % 2 = 0 union select n_nationkey, 'department', r_name from nation join region on r_regionkey = n_regionkey where n_nationkey % 5 <> 0 union select n, 'form_field', 'F' || s_suppkey % 5 from s where s_suppkey % 3 = 0),
c as (select *, ['role', 'department', 'member', 'robot', ''][k % 5 + 1] as type, 'R' || k % 6 as role, (select r_name from nation join region on r_regionkey = n_regionkey where n_nationkey = k % 25) as dept, case when k % 2 = 0 then cast(k % 120 as varchar) else 'Supplier#' || lpad(cast(k % 120 as varchar), 9, '0') end as member from t),
d as (select *, case p
    when 'static' then case when type = '' then ['missing_type'] when k % 11 = 0 then ['missing_value'] when type = 'robot' then ['unknown_type'] when type = 'role' then [null, 'role', role] when type = 'department' then [null, 'department', dept] else [null, 'member', member] end
    when 'form_driven' then case when k % 9 = 0 then ['missing_form_field'] else [null, 'form_field', 'F' || k % 7] end
    when 'dynamic' then case when k % 9 = 0 then ['missing_mcp_tool'] else [null, 'tool', 'T' || k % 4] end
    when 'queue_claim' then case when type = '' then ['missing_claim_group'] when k % 11 = 0 then ['missing_group_name'] when type = 'role' then [null, 'role', role] when type = 'department' then [null, 'department', dept] else ['unknown_claim_group'] end
    when 'automation' then case when k % 8 = 0 then ['missing_automation_type'] when k % 8 = 1 then ['unknown_automation_type'] when k % 8 in (2, 3, 4) then case when k % 9 = 0 then ['missing_mcp_tool_name'] else [null, 'tool', 'T' || k % 4] end else case when k % 9 = 0 then ['missing_virtual_member_name'] else ['valid'] end end
    else ['unknown_pattern'] end as w from c)
select task, p as pattern, case when w[1] is not null then w[1] when exists (select 1 from a where a.n = d.n and a.kind = w[2] and a.name = w[3]) then 'valid' when exists (select 1 from a where a.n = d.n and a.kind = w[2]) then 'not_found' else 'none_given' end as verdict from d""")
def executor_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Whether what the tasks' executor configurations name is there, for all five patterns, and what is wrong with those where it is not."""
    customer, supplier, nation, region = (table(spark, sf, t) for t in ("customer", "supplier", "nation", "region"))
    key = F.col("c_custkey")
    k = F.floor(key / 7)
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    named = lambda letter, n: F.concat(F.lit(letter), (k % n).cast("string"))
    areas = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("n"), F.col("r_name").alias("area"))
    number = (k % 120).cast("string")
    kind = pick(["role", "department", "member", "robot", ""], k % 5)
    what = F.when(kind == "role", named("R", 6)).when(kind == "department", F.col("area")).otherwise(F.when(k % 2 == 0, number).otherwise(F.concat(F.lit("Supplier#"), F.lpad(number, 9, "0"))))
    auto = pick(["", "x", "mcp_tool", "mcp_tool", "mcp_tool", "virtual_member", "virtual_member", "virtual_member"], k % 8)
    unless = lambda n, value: F.when(k % n == 0, "").otherwise(value)
    fields = {"type": kind, "value": unless(11, what), "form_field": unless(9, named("F", 7)), "mcp_tool": unless(9, named("T", 4)), "claim_group": kind, "group_name": unless(11, what), "automation_type": auto, "mcp_tool_name": unless(9, named("T", 4)), "virtual_member_name": unless(9, F.lit("V"))}
    config = F.create_map(*[x for name, value in fields.items() for x in (F.lit(name), value)])
    tasks = customer.join(areas.withColumnRenamed("n", "area_of"), k % 25 == F.col("area_of")).select("c_nationkey", key.alias("task"), pick([*executors.PATTERNS, "other", "static"], key % 7).alias("pattern"), config.alias("config"))
    s = F.col("s_suppkey")
    entry = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    some = lambda cond, kind, name: entry(kind, F.when(cond, name))
    text = lambda letter, n: F.concat(F.lit(letter), (s % n).cast("string"))
    entries = F.array(entry("role", text("R", 4)), entry("member", F.col("s_name")), entry("member", s.cast("string")), some(s % 2 == 0, "tool", text("T", 3)), some(s % 3 == 0, "form_field", text("F", 5)))
    there = supplier.select(F.col("s_nationkey").alias("c_nationkey"), F.inline(entries)).unionByName(areas.where("n % 5 <> 0").select(F.col("n").alias("c_nationkey"), F.lit("department").alias("kind"), F.col("area").alias("name")))
    return executors.checked(tasks, there, "c_nationkey").select("task", "pattern", "verdict")


@query("""
with d as (select conv_id, turn, lower(text || case (conv_id + turn) % 6 when 0 then ' Choose a reviewer' when 1 then ' Route BASED ON amount' when 2 then ' first available' when 3 then ' validate the sum' else '' end) as t from conversations)
select conv_id, turn, pattern, confidence from d, (values ('form_driven', 0.8::double, 'select|choose|user|decide'), ('dynamic', 0.85, 'route|based on|if|condition'), ('queue_claim', 0.75, 'team|any|available|first'), ('automation', 0.7, 'automatic|check|validate|compute'), ('static', 0.5, '')) s(pattern, confidence, words) where regexp_matches(t, words)""")
def executor_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """The patterns that the words of each turn suggest, and how sure that is."""
    k = (F.col("conv_id") + F.col("turn")) % 6
    more = F.when(k == 0, " Choose a reviewer").when(k == 1, " Route BASED ON amount").when(k == 2, " first available").when(k == 3, " validate the sum").otherwise("")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.inline(executors.suggested(F.concat("text", more))))


@query("""
with recursive n as (select c_custkey as id, case when c_custkey >= 5 then c_custkey // 3 end as parent from customer),
w(root, id, path) as (select id, id, [id] from n where id < 5 union all select root, n.id, list_append(path, n.id) from w join n on n.parent = w.id where not list_contains(path, n.id)),
p as (select *, row_number() over (partition by root order by path) as place, count(*) over (partition by root) as total from w)
select root, place, id, (len(path) - 1)::bigint as depth, total, total > 60 as truncated from p where place <= 60""")
def org_charts(spark: SparkSession, sf: str) -> DataFrame:
    """The first 60 nodes of charts of any depth, each before its children, and whether there are more."""
    key = F.col("c_custkey")
    nodes = table(spark, sf, "customer").select(key.alias("id"), F.when(key >= 5, F.floor(key / 3)).alias("parent"))
    return trees.preorder(nodes, nodes.where("id < 5").select(F.col("id").alias("root")), 60)


@query("""
with e as (select p_partkey as id, p_type as kind, [p_name || ' ' || p_partkey % 50, p_brand, 'code-' || p_partkey] as texts from part),
q as (select c_custkey as k, case when c_custkey % 6 = 0 then (c_custkey * 7)::bigint end as wanted, case c_custkey % 8 when 1 then ' CODE-' || c_custkey when 2 then 'Brand#' || c_custkey % 30 when 3 then 'code-' || c_custkey % 9 when 4 then 'blue' when 5 then '' when 7 then 'g ' || c_custkey % 50 else 'ode-1' || c_custkey % 100 || ' ' end as query,
  case when c_custkey % 3 = 1 then ['SMALL', 'PROMO', 'LARGE'][c_custkey % 2 + 1] end as kind from customer),
t as (select id, kind, lower(trim(unnest(texts))) as t from e),
w as (select k, lower(trim(query)) as q, kind from q where wanted is null and trim(query) <> ''),
s as (select distinct k, id from w join t on t = q and (w.kind is null or w.kind = t.kind)),
c as (select distinct k, id from w join t on contains(t, q) and (w.kind is null or w.kind = t.kind) where k not in (select k from s)),
m as (select k, count(*) as n, min(id) as id, list(id order by id)[1:10] as ids from (select * from s union all select * from c) group by k)
select q.k as c_custkey, case when wanted is not null then case when wanted in (select id from e) then 'unique' else 'unknown_id' end when trim(query) = '' then 'no_query' when n is null then 'none' when n > 1 then 'several' else 'unique' end as verdict,
  case when wanted is not null then case when wanted in (select id from e) then wanted end when n = 1 then m.id end as id, case when wanted is not null then (wanted in (select id from e))::int::bigint else coalesce(n, 0) end as n,
  case when wanted is not null then case when wanted in (select id from e) then wanted::varchar else '' end else coalesce(array_to_string(ids, ','), '') end as candidates from q left join m on m.k = q.k""")
def resource_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """The one resource that an id or a part of its name, code or brand means; none and several are told apart, several with their first ids."""
    key, text = F.col("c_custkey"), lambda c: c.cast("string")
    part = table(spark, sf, "part")
    number = F.col("p_partkey")
    entities = part.select(number.alias("id"), F.col("p_type").alias("kind"), F.array(F.concat("p_name", F.lit(" "), text(number % 50)), "p_brand", F.concat(F.lit("code-"), text(number))).alias("texts"))
    at = lambda n: key % 8 == n
    words = (
        F.when(at(1), F.concat(F.lit(" CODE-"), text(key))).when(at(2), F.concat(F.lit("Brand#"), text(key % 30))).when(at(3), F.concat(F.lit("code-"), text(key % 9)))
        .when(at(4), "blue").when(at(5), "").when(at(7), F.concat(F.lit("g "), text(key % 50))).otherwise(F.concat(F.lit("ode-1"), text(key % 100), F.lit(" ")))
    )
    kinds = F.array(F.lit("SMALL"), F.lit("PROMO"), F.lit("LARGE"))
    queries = table(spark, sf, "customer").select("c_custkey", F.when(key % 6 == 0, key * 7).alias("wanted"), words.alias("query"), F.when(key % 3 == 1, F.get(kinds, (key % 2).cast("int"))).alias("kind"))
    return lookup.resolve(queries, entities, "c_custkey").withColumn("candidates", F.array_join(F.transform("candidates", lambda x: x.cast("string")), ","))

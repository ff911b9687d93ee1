"""Queries on rules over single rows: labels, formulas, payloads, projections, verdicts, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import labels as L
from lodestack.functions import text as T
from lodestack.operators import versions
from lodestack.operators import tables as grids
from lodestack.registry import query, table
from lodestack.sources import tables as sinks


@query(r"""
with p as (select p_partkey, p_brand || ' / "' || p_name || '"' || chr(10) || ' x' as raw, case when p_partkey % 9 = 0 then '//' else p_type || ' (' || p_size || ')' end as role from part)
select p_partkey, regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug,
  case when role = '//' then 'ROLE' else regexp_replace(regexp_replace(upper(role), '[^A-Z0-9]+', '_', 'g'), '^_|_$', '', 'g') end as code,
  trim(regexp_replace(replace(raw, '"', ''''), '\s+', ' ', 'g')) as label, lower(trim(p_brand)) as lookup_key from part join p using (p_partkey)""")
def name_codes(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat("p_brand", F.lit(' / "'), "p_name", F.lit('"\n x'))
    role = F.when(F.col("p_partkey") % 9 == 0, "//").otherwise(F.concat("p_type", F.lit(" ("), "p_size", F.lit(")")))
    return table(spark, sf, "part").select("p_partkey", T.slug(raw).alias("slug"), L.role_code(role).alias("code"), L.chart_label(raw).alias("label"), L.lookup_key(F.col("p_brand")).alias("lookup_key"))


@query("""
with c as (select p_partkey, p_type as base, replace(upper(p_brand), '#', '_') as org, row_number() over (partition by p_type order by p_partkey) as n, row_number() over (partition by p_type, p_brand order by p_partkey) as m from part)
select p_partkey, substr(case when n = 1 then base when m = 1 then base || '_' || org else base || '_' || org || '_' || m end, 1, 64) as code from c""")
def unique_codes(spark: SparkSession, sf: str) -> DataFrame:
    """The base code for the first that wants it, then with the organisation, then with a number; cut to 64 characters."""
    of = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("p_partkey"))
    c = table(spark, sf, "part").select("p_partkey", "p_type", L.role_code(F.col("p_type")).alias("base"), L.role_code(F.col("p_brand")).alias("org"), of("p_type").alias("n"), of("p_type", "p_brand").alias("m"))
    code = F.when(F.col("n") == 1, F.col("base")).when(F.col("m") == 1, F.concat_ws("_", "base", "org")).otherwise(F.concat_ws("_", "base", "org", "m"))
    return c.select("p_partkey", F.substring(code, 1, 64).alias("code"))


@query(r"""
with p as (select p_partkey, case p_partkey % 4 when 0 then 'see Table ' || p_size || '.1 and Table ' || p_size || '.1' when 1 then p_size || ' (%)' when 2 then 'Table 1 and Table 2' else p_name end as t from part)
select p_partkey, regexp_matches(t, '[0-9]') and regexp_full_match(t, '[0-9 .,;:%()+-]+') as number_only, case when len(list_distinct(regexp_extract_all(t, 'Table ([0-9]+(?:[.-][0-9]+)*)', 1))) = 1 then regexp_extract(t, 'Table ([0-9]+(?:[.-][0-9]+)*)', 1) end as table_no from p""")
def number_labels(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    t = F.when(k == 0, F.concat(F.lit("see Table "), size, F.lit(".1 and Table "), size, F.lit(".1"))).when(k == 1, F.concat(size, F.lit(" (%)"))).when(k == 2, "Table 1 and Table 2").otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", L.is_number_only(t).alias("number_only"), L.table_number(t).alias("table_no"))


@query(r"""
with f as (select p_partkey, unnest(['a_{1} = b + ' || p_size, ' a_{1}=b +' || p_size || ' ', 'c = ' || p_size || 'x']) as key_text, unnest(['7', null, cast(p_partkey % 5 as varchar)]) as label, unnest([1, 2, 3]) as n from part)
select regexp_replace(key_text, '\s+', '', 'g') as formula_key, cast(count(*) as bigint) as n, cast(count(label) as bigint) as labelled, min(label) as first_label, cast(count(distinct p_partkey) as bigint) as parts from f group by 1""")
def formula_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Display formulas of a text with their labels, by what they say."""
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("See $$a_{1} = b + "), size, F.lit(r" \tag{7}$$, $$ a_{1}=b +"), size, F.lit(r" $$ and \[c = "), size, F.lit("x ("), (F.col("p_partkey") % 5).cast("string"), F.lit(r") \]."))
    f = table(spark, sf, "part").select("p_partkey", F.explode(L.formulas(text)).alias("f"))
    return f.select("p_partkey", L.formula_key(F.col("f")).alias("formula_key"), L.formula_label(F.col("f")).alias("label")).groupBy("formula_key").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.min("label").alias("first_label"), F.countDistinct("p_partkey").alias("parts"))


@query("""
with e as (select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events)
select event_id, case event_id % 5 when 4 then null else k end as k, event_id % 5 <> 4 as parsed from e""")
def json_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """The object in a reply: bare, fenced, within prose, or none."""
    n, p = F.col("event_id") % 5, F.col("props")
    reply = F.when(n == 0, p).when(n == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(n == 2, F.concat(F.lit("```\n"), p, F.lit("\n``` so"))).when(n == 3, F.concat(F.lit("Result: "), p, F.lit(" {done"))).otherwise("none {here")
    return table(spark, sf, "events").select("event_id", L.json_payload(reply).alias("x")).select("event_id", F.get_json_object("x", "$.k").cast("bigint").alias("k"), F.col("x").isNotNull().alias("parsed"))


@query("""
with o as (select o_orderkey, cast(o_custkey as varchar) as body_id, o_orderstatus, case when o_orderkey % 3 = 0 then 'q' || o_orderkey end as query_id, case when o_orderkey % 5 = 0 then 'p' || o_orderkey end as path_id, cast(o_totalprice as varchar) as price from orders)
select o_orderkey, coalesce(path_id, query_id, body_id) as id, coalesce(path_id, query_id, body_id) as member_id, try_cast(coalesce(path_id, query_id, body_id) as bigint) as id_number,
  case when query_id is null and path_id is null then 'price,status,id' else 'price,status,id' end as names from o""")
def param_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Body, query and path parameters as one map, path first; an alias is filled, values coerced, only declared names kept."""
    text, none = "map<string,string>", F.create_map().cast("map<string,string>")
    body = F.create_map(F.lit("price"), F.col("o_totalprice").cast("string"), F.lit("status"), F.col("o_orderstatus"), F.lit("id"), F.col("o_custkey").cast("string"), F.lit("debug"), F.lit("1")).cast(text)
    asked = F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("id"), F.concat(F.lit("q"), "o_orderkey"))).otherwise(none)
    path = F.when(F.col("o_orderkey") % 5 == 0, F.create_map(F.lit("id"), F.concat(F.lit("p"), "o_orderkey"))).otherwise(none)
    declared = F.map_filter(L.flat_params(body, asked, path), lambda k, _: k.isin("price", "status", "id", "member_id"))
    o = table(spark, sf, "orders").select("o_orderkey", declared.alias("m"))
    of = lambda k: F.try_element_at("m", F.lit(k))
    return o.select("o_orderkey", of("id").alias("id"), F.coalesce(of("member_id"), of("id")).alias("member_id"), of("id").try_cast("bigint").alias("id_number"), F.array_join(F.map_keys("m"), ",").alias("names"))


@query("""
select p_partkey, unnest(['size', 'name']) as field, unnest(['integer', 'string']) as type, unnest(['Size ' || p_size, 'name']) as title, unnest([true, false]) as required from part""")
def schema_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of a form's JSON schema as rows; a missing type is a string, a missing title the name."""
    schema = F.concat(F.lit('{"properties":{"size":{"type":"integer","title":"Size '), "p_size", F.lit('"},"name":{}},"required":["size"]}'))
    rows = table(spark, sf, "part").select("p_partkey", F.explode(versions.schema_fields(schema)).alias("f"))
    return rows.select("p_partkey", F.col("f.name").alias("field"), "f.type", "f.title", "f.required")


@query("""
select p_partkey, case p_partkey % 4 when 0 then 'array' when 1 then 'wrapped_array' when 2 then 'wrapped_object' else 'object' end as shape from part""")
def response_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """What a response schema describes: an array, an array or object under data, or an object."""
    made = [F.lit('{"type":"array"}'), F.lit('{"type":"object","properties":{"data":{"type":"array"}}}'), F.lit('{"type":"object","properties":{"data":{"type":"object"}}}'), F.lit('{"type":"object","properties":{"x":{"type":"array"}}}')]
    s = F.get(F.array(*made), (F.col("p_partkey") % 4).cast("int"))
    kind, data = F.get_json_object(s, "$.type"), F.get_json_object(s, "$.properties.data.type")
    return table(spark, sf, "part").select("p_partkey", F.when(kind == "array", "array").when(data == "array", "wrapped_array").when(data == "object", "wrapped_object").otherwise("object").alias("shape"))


@query("""
with q as (select distinct substr(n_name, 1, 2) as asked from nation union select cast(n_nationkey as varchar) from nation),
h as (select asked, n_nationkey from q join nation on cast(n_nationkey as varchar) = asked or starts_with(n_name, asked)),
v as (select asked, count(*) as n, min(n_nationkey) as org from h group by asked)
select asked, case when n = 1 then org end as org, case when n = 1 then 'resolved' else 'ambiguous' end as verdict, cast(case when n = 1 then coalesce(s.members, 0) end as bigint) as members
from v left join (select s_nationkey, count(*) as members from supplier group by 1) s on s_nationkey = org""")
def subject_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Organisations by id or by the beginning of their name, which has to be unique; then those that belong to them."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    keys = n.select("n_nationkey", F.explode(F.array(F.col("n_nationkey").cast("string"), F.substring("n_name", 1, 2))).alias("asked"))
    v = keys.groupBy("asked").agg(F.countDistinct("n_nationkey").alias("n"), F.min("n_nationkey").alias("org"))
    members = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("org")).agg(F.count("*").alias("m"))
    one = F.col("n") == 1
    return v.join(members, "org", "left").select("asked", F.when(one, F.col("org")).alias("org"), F.when(one, "resolved").otherwise("ambiguous").alias("verdict"), F.when(one, F.coalesce("m", F.lit(0))).cast("bigint").alias("members"))


@query("""
with n as (select 0 as depth, r_regionkey as r, -1 as n, -1 as s, r_name as name from region union all select 1, n_regionkey, n_nationkey, -1, n_name from nation union all select 2, n_regionkey, n_nationkey, s_suppkey, s_name from supplier join nation on s_nationkey = n_nationkey)
select cast(row_number() over (order by r, n, s) as bigint) as place, cast(depth as bigint) as depth, name, (select count(*) from n) > 60 as truncated from n order by r, n, s limit 60""")
def org_chart(spark: SparkSession, sf: str) -> DataFrame:
    """A chart's first 60 nodes in depth-first order, children by id, and whether there are more: a top-k sort, no walk."""
    region, nation, supplier = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    none = F.lit(-1)
    top = region.select(F.lit(0).alias("depth"), F.col("r_regionkey").alias("r"), none.alias("n"), none.cast("bigint").alias("s"), F.col("r_name").alias("name"))
    mid = nation.select(F.lit(1).alias("depth"), F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n"), none.cast("bigint").alias("s"), F.col("n_name").alias("name"))
    low = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit(2).alias("depth"), F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n"), F.col("s_suppkey").alias("s"), F.col("s_name").alias("name"))
    nodes = top.unionByName(mid).unionByName(low)
    first = nodes.orderBy("r", "n", "s").limit(61)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy("r", "n", "s")).cast("bigint"))  # of 61 rows
    more = F.broadcast(placed.agg((F.max("place") > 60).alias("truncated")))  # one row
    return placed.where("place <= 60").join(more, F.lit(True)).select("place", F.col("depth").cast("bigint").alias("depth"), "name", "truncated")


_HTML = '<table><tr><th colspan="2">A &amp; B</th><th>C</th></tr><tr><td rowspan="2">{0}</td><td>{1}<br>x</td><td>{2}</td></tr><tr><td>?</td><td> </td></tr></table>'


@query("""
with c(i, j, si, sj, status) as (values (0, 0, 0, 0, 'recognized'), (0, 1, 0, 0, 'spanned'), (0, 2, 0, 2, 'recognized'), (1, 0, 1, 0, 'recognized'), (1, 1, 1, 1, 'recognized'), (1, 2, 1, 2, 'recognized'), (2, 0, 1, 0, 'spanned'), (2, 1, 2, 1, 'recognized'), (2, 2, 2, 2, 'blank'))
select p_partkey, i as row, j as col, si as source_row, sj as source_col, status, case when i = 0 and j < 2 then 'A & B' when i = 0 then 'C' when j = 0 then cast(p_size as varchar) when i = 1 and j = 1 then p_name || chr(10) || 'x' when i = 1 then p_brand when j = 1 then '?' else '' end as text from part, c""")
def table_grid(spark: SparkSession, sf: str) -> DataFrame:
    """HTML tables as grids: spans expanded, each position with the cell it comes from and that cell's status."""
    a, b, c, d = _HTML.replace("{0}", "\0").replace("{1}", "\0").replace("{2}", "\0").split("\0")
    html = F.concat(F.lit(a), F.col("p_size").cast("string"), F.lit(b), "p_name", F.lit(c), "p_brand", F.lit(d))
    return grids.html_cells(table(spark, sf, "part").select("p_partkey", html.alias("html")), "p_partkey", "html")


@query("""
select p_partkey, case when p_partkey % 3 = 0 then true else false end as synthetic, [3, 3] as widths, 'x | y' as escaped, case when p_size >= 10 then 1 else 1 end as header_rows, p_partkey % 2 = 0 as compacted from part""")
def markdown_grid(spark: SparkSession, sf: str) -> DataFrame:
    """A markdown table's shape: widths of its rows, a header of invented names, rows before the separator, numbers run together."""
    head = F.when(F.col("p_partkey") % 3 == 0, "| Col1 | Col2 | z |").otherwise("| a | b | Col1 |")
    many = F.when(F.col("p_partkey") % 2 == 0, "1 2 3 4 5 6 7 8").otherwise("1 2 3")
    lines = F.array(head, F.lit("|---|:--:|---|"), F.concat(F.lit(r"| x \| y | "), F.col("p_size").cast("string"), F.lit(" | "), many, F.lit(" |")))
    cells = F.transform(lines, grids.markdown_cells)
    rows = F.filter(cells, lambda r: r.isNotNull())
    named = lambda r, i: F.regexp_like(F.get(r, F.lit(i)), F.lit("^Col[0-9]+$"))
    first = F.get(rows, F.lit(0))
    return table(spark, sf, "part").select(
        "p_partkey", (named(first, 0) & named(first, 1) | named(first, 1) & named(first, 2)).alias("synthetic"), F.transform(rows, F.size).alias("widths"), F.get(F.get(rows, F.lit(1)), F.lit(0)).alias("escaped"),
        (F.array_position(F.transform(cells, lambda r: r.isNull()), True) - 1).cast("int").alias("header_rows"), F.exists(F.get(rows, F.lit(1)), lambda c: F.size(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))) >= 8).alias("compacted"),
    )


@query("""
select p_partkey, p_type || ' a,' || p_type || ',' || p_brand || ' c' as header, p_brand || ',' || p_brand || ',' || p_type || ',' || p_type as filled from part""")
def header_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two header rows as one, blanks carried on; and blank cells filled from before, leading ones from after."""
    blank = F.lit("")
    header = versions.merged_header(F.array("p_type", blank, F.col("p_brand")), F.array(F.lit("a"), F.lit(" "), F.lit("c")))
    filled = versions.filled(F.array(blank, F.col("p_brand"), F.col("p_type"), F.lit(" ")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(header, ",").alias("header"), F.array_join(filled, ",").alias("filled"))


@query("""
select p_partkey, case when p_partkey % 2 = 0 then chr(34) || p_name || ', ' || repeat(chr(34), 2) || 'x' || repeat(chr(34), 3) else p_name end || ',' || p_brand as csv, '| ' || case when p_partkey % 2 = 0 then p_name || ', "x"' else p_name end || ' | a\\|b |' as markdown from part""")
def export_rows(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(', "x"'))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", sinks.delimited(F.array(name, F.col("p_brand"))).alias("csv"), sinks.markdown_row(F.array(name, F.lit("a|b"))).alias("markdown"))


_STATE = "case o_orderstatus when 'O' then 'QUEUED' when 'F' then 'RUNNING' else 'PAUSED_AUTH_REQUIRED' end"
_ACTION = "case o_orderkey % 4 when 0 then 'cancel' when 1 then 'complete' when 2 then 'resume' else 'retry' end"


@query(f"""
with t as (select o_orderkey, {_STATE} as state, {_ACTION} as action, o_custkey % 2 = 0 as flagged from orders)
select o_orderkey, case when action = 'cancel' and state = 'QUEUED' then 'CANCELLED' when action = 'complete' and state = 'RUNNING' then case when flagged then 'CANCELLED' else 'COMPLETED' end
  when action = 'resume' and state = 'PAUSED_AUTH_REQUIRED' then 'QUEUED' else state end as state, action = 'cancel' and state = 'RUNNING' or flagged as cancel_requested,
  (action = 'cancel' and state in ('QUEUED', 'RUNNING')) or (action = 'complete' and state = 'RUNNING') or (action = 'resume' and state = 'PAUSED_AUTH_REQUIRED') as accepted from t""")
def task_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """What an action makes of a task: the queued are cancelled at once, the running get a flag that completion respects, only the paused resume."""
    t = table(spark, sf, "orders").select("o_orderkey", F.expr(_STATE).alias("state"), F.expr(_ACTION).alias("action"), (F.col("o_custkey") % 2 == 0).alias("flagged"))
    does = lambda action, *states: (F.col("action") == action) & F.col("state").isin(*states)
    after = F.when(does("cancel", "QUEUED"), "CANCELLED").when(does("complete", "RUNNING"), F.when(F.col("flagged"), "CANCELLED").otherwise("COMPLETED")).when(does("resume", "PAUSED_AUTH_REQUIRED"), "QUEUED").otherwise(F.col("state"))
    accepted = does("cancel", "QUEUED", "RUNNING") | does("complete", "RUNNING") | does("resume", "PAUSED_AUTH_REQUIRED")
    return t.select("o_orderkey", after.alias("state"), (does("cancel", "RUNNING") | F.col("flagged")).alias("cancel_requested"), accepted.alias("accepted"))


@query("""
with e as (select c_custkey, case c_custkey % 4 when 0 then 'user:' || c_custkey when 1 then 'role:' || c_mktsegment when 2 then 'dept:' || c_nationkey else 'anyone' end as executor from customer)
select c_custkey, executor, case when c_custkey % 4 = 3 then 'bad_pattern' when c_custkey % 4 = 2 and not exists (select 1 from supplier where 'dept:' || s_nationkey = executor) then 'unknown' else 'ok' end as verdict from e""")
def executor_check(spark: SparkSession, sf: str) -> DataFrame:
    """Executors by pattern, then whether a static one exists: all kinds in one join by key."""
    c = table(spark, sf, "customer").select("c_custkey", F.expr("case c_custkey % 4 when 0 then 'user:' || c_custkey when 1 then 'role:' || c_mktsegment when 2 then 'dept:' || c_nationkey else 'anyone' end").alias("executor"))
    users = table(spark, sf, "customer").select(F.concat(F.lit("user:"), "c_custkey").alias("executor"))
    roles = table(spark, sf, "customer").select(F.concat(F.lit("role:"), "c_mktsegment").alias("executor")).distinct()
    depts = table(spark, sf, "supplier").select(F.concat(F.lit("dept:"), "s_nationkey").alias("executor")).distinct()
    known = users.unionByName(roles).unionByName(depts).distinct().withColumn("known", F.lit(True))
    good = F.regexp_like("executor", F.lit("^(user|dept):[0-9]+$|^role:[A-Z]+$"))
    return c.join(known, "executor", "left").select("c_custkey", "executor", F.when(~good, "bad_pattern").when(F.col("known").isNull(), "unknown").otherwise("ok").alias("verdict"))


@query(r"""
select p_partkey, regexp_matches('uses ' || p_brand || ', once', '(^|[^A-Za-z0-9_#])Brand#1($|[^A-Za-z0-9_#])') as has_identifier,
  case when contains(goal, 'tool ') then 'direct' when contains(goal, 'plan') then 'complex' when contains(goal, 'add') then 'simple' else 'complex' end as mode, regexp_matches(goal, 'org chart|hierarchy') as chart_wanted
from (select *, case p_partkey % 4 when 0 then 'tool x plan' when 1 then 'plan the address' when 2 then 'address' else 'draw the org chart' end as goal from part)""")
def goal_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Whole identifiers in a text; the mode of a goal by ordered keywords, which also match within words."""
    goal = F.expr("case p_partkey % 4 when 0 then 'tool x plan' when 1 then 'plan the address' when 2 then 'address' else 'draw the org chart' end")
    has = lambda w: F.contains(goal, F.lit(w))
    mode = F.when(has("tool "), "direct").when(has("plan"), "complex").when(has("add"), "simple").otherwise("complex")
    return table(spark, sf, "part").select("p_partkey", L.has_identifier(F.concat(F.lit("uses "), "p_brand", F.lit(", once")), F.lit("Brand#1")).alias("has_identifier"), mode.alias("mode"), (has("org chart") | has("hierarchy")).alias("chart_wanted"))


@query("""
select p_partkey, array_to_string(list_sort(list_distinct([p_brand, p_type, p_name])), ',') as sources, cast(len(list_distinct([p_brand, p_type, p_name])) as bigint) as n_sources, p_partkey % 2 = 0 as supplemented from part""")
def source_union(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct sources of several result lists without blanks, and whether a helper that is missing was added."""
    lists = F.array(F.array("p_brand", "p_type"), F.array(F.col("p_type"), F.lit(" ")), F.array("p_name", "p_brand"))
    found = F.array_distinct(F.filter(F.flatten(lists), lambda s: F.trim(s) != ""))
    have = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("helper")))
    added = F.size(F.array_except(F.array(F.lit("helper")), have)) > 0
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(found), ",").alias("sources"), F.size(found).cast("bigint").alias("n_sources"), added.alias("supplemented"))


@query("""
with c as (select c_custkey, lower(c_mktsegment) as status, c_acctbal > 0 as flag from customer)
select c_custkey, case when status in ('furniture', 'building') then true else flag end as active, case when c_acctbal < 0 and c_custkey % 2 = 0 then 'retry' when c_acctbal < 0 then 'failed' else 'kept' end as page from c join customer using (c_custkey)""")
def active_and_retry(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a row counts as active, by its status, else its flag; and the failed pages among those that a retry asks for."""
    c = table(spark, sf, "customer")
    asked = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit(True).alias("asked"))
    status = F.lower("c_mktsegment")
    page = F.when((F.col("c_acctbal") < 0) & F.col("asked"), "retry").when(F.col("c_acctbal") < 0, "failed").otherwise("kept")
    return c.join(asked, "c_custkey", "left").select("c_custkey", F.when(status.isin("furniture", "building"), True).otherwise(F.col("c_acctbal") > 0).alias("active"), page.alias("page"))


@query("""
select cast(w as timestamp) as start, cast(count(*) as bigint) as n, cast(count(distinct user_id) as bigint) as users from (
  select user_id, unnest([time_bucket(interval 30 minute, ts), time_bucket(interval 30 minute, ts) - interval 30 minute]) as w from events) group by 1""")
def event_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of an hour every half hour."""
    e = table(spark, sf, "events")
    g = e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "users")


@query("""
with f as (select p_partkey, case p_partkey % 3 when 0 then 'Figure 2-' || p_size || ' Flow chart of P1 and V-12' when 1 then 'Fig. ' || p_size || ' photo' else p_name end as c from part)
select p_partkey, case when contains(lower(c), 'flow') then 'flowchart' when contains(lower(c), 'photo') then 'photo' else 'other' end as kind, array_to_string(list_slice(regexp_extract_all(c, '\\b[A-Z]-?[0-9]+\\b'), 1, 12), ',') as labels,
  array_to_string(list_filter([case when contains(lower(p_name), 'small') then 'compact' end, case when contains(lower(p_type), 'large') then 'long' end, 'text'], lambda x: x is not null), ',') as capabilities from f join part using (p_partkey)""")
def figure_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A figure's kind by its caption, the labels in it (12 at most), and what a model can by its name."""
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    c = F.when(k == 0, F.concat(F.lit("Figure 2-"), size, F.lit(" Flow chart of P1 and V-12"))).when(k == 1, F.concat(F.lit("Fig. "), size, F.lit(" photo"))).otherwise(F.col("p_name"))
    has = lambda x, w: F.contains(F.lower(x), F.lit(w))
    able = F.array_compact(F.array(F.when(has("p_name", "small"), "compact"), F.when(has("p_type", "large"), "long"), F.lit("text")))
    kind = F.when(has(c, "flow"), "flowchart").when(has(c, "photo"), "photo").otherwise("other")
    return table(spark, sf, "part").select("p_partkey", kind.alias("kind"), F.array_join(F.slice(F.regexp_extract_all(c, F.lit(r"\b[A-Z]-?[0-9]+\b"), F.lit(0)), 1, 12), ",").alias("labels"), F.array_join(able, ",").alias("capabilities"))

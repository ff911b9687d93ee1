"""Queries on page ledgers, builds, candidates and forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import marks as M
from lodestack.operators import ledger
from lodestack.operators.rounds import spread
from lodestack.registry import query, table


@query("""
with v as (select doc_id, case doc_id % 5 when 0 then ' ' || upper(lang) || ' ' when 1 then lang || '-US' when 2 then 'Chinese' when 3 then 'ZH_Hans' end as named, case doc_id % 4 when 0 then ' N/A ' when 1 then 'Unreadable' when 2 then lang else '？' end as cell from documents)
select doc_id, case when lower(trim(coalesce(named, ''))) in ('zh', 'zh-cn', 'zh_hans', 'chinese') then 'zh' when lower(trim(coalesce(named, ''))) in ('en', 'en-us', 'english') then 'en' else 'unknown' end as code,
  lower(trim(coalesce(cell, ''))) in ('n/a', 'na', 'n.a.', '?', '？', '无法识别', '看不清', 'unreadable') as unreadable from v""")
def language_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Languages under their many names, and cells that nobody could read."""
    n = F.col("doc_id") % 5
    named = F.when(n == 0, F.concat(F.lit(" "), F.upper("lang"), F.lit(" "))).when(n == 1, F.concat("lang", F.lit("-US"))).when(n == 2, "Chinese").when(n == 3, "ZH_Hans")
    m = F.col("doc_id") % 4
    cell = F.when(m == 0, " N/A ").when(m == 1, "Unreadable").when(m == 2, F.col("lang")).otherwise("？")
    return table(spark, sf, "documents").select("doc_id", M.language_code(named).alias("code"), M.is_unreadable(cell).alias("unreadable"))


@query(r"""
with p as (select p_partkey, p_name || ' \mathrm{~h} = ' || p_size || ' \, x' as body, [' \mathrm{h}=' || p_size, p_brand || ' + 1', p_name || '\ ', p_brand || ' + 1', 'y = ' || p_size] as fs from part),
f as (select p_partkey, body, unnest(fs) as formula, generate_subscripts(fs, 1) as i from p),
k as (select p_partkey, formula, min(i) as i from f where not contains(regexp_replace(replace(replace(replace(body, '\,', ''), '\ ', ''), '\mathrm{~h}', '\mathrm{h}'), '\s+', '', 'g'), regexp_replace(replace(replace(replace(formula, '\,', ''), '\ ', ''), '\mathrm{~h}', '\mathrm{h}'), '\s+', '', 'g')) group by all)
select p_partkey, cast(count(*) as bigint) as n, string_agg(formula, ';' order by i) as formulas from k group by p_partkey""")
def formula_novelty(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct formulas of a page that its text does not have already, spacing aside."""
    size = F.col("p_size").cast("string")
    body = M.formula_compact(F.concat("p_name", F.lit(" \\mathrm{~h} = "), size, F.lit(" \\, x")))
    formulas = F.array(F.concat(F.lit(" \\mathrm{h}="), size), F.concat("p_brand", F.lit(" + 1")), F.concat("p_name", F.lit("\\ ")), F.concat("p_brand", F.lit(" + 1")), F.concat(F.lit("y = "), size))
    kept = F.array_distinct(F.filter(F.col("fs"), lambda f: ~F.contains(F.col("body"), M.formula_compact(f))))
    rows = table(spark, sf, "part").select("p_partkey", body.alias("body"), formulas.alias("fs")).select("p_partkey", kept.alias("kept"))
    return rows.where(F.size("kept") > 0).select("p_partkey", F.size("kept").cast("bigint").alias("n"), F.array_join("kept", ";").alias("formulas"))


@query(r"""
with r as (select p_partkey, [p_name, ' ' || p_brand || ' ', cast(p_size as varchar) || ' %', 'c', '\alpha', p_name, '', case when p_partkey % 2 = 0 then p_brand else 'x' end, case when p_partkey % 3 = 0 then '4 mm' else 'unit' end] as cells from part)
select p_partkey, array_to_string(list_distinct_kept, ',') as names, len(filled) > 0 and len(list_filter(filled, lambda x: regexp_matches(x, '[0-9]'))) <= greatest(1, len(filled) // 3) as header
from (select p_partkey, list_filter(cells, lambda x: x <> '') as filled, list_filter(t, lambda x, i: list_position(t, x) = i) as list_distinct_kept from (
  select p_partkey, cells, list_filter(list_transform(cells, lambda x: trim(x)), lambda x: length(x) between 2 and 24 and not regexp_matches(x, '[\\{}]') and lower(x) not in ('c', 'l', 'r') and not regexp_matches(x, '^[\d\s.~≤≥%/-]+$')) as t from r))""")
def header_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The names in a table's first row, and whether that row looks like a header."""
    odd = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("x")
    unit = F.when(F.col("p_partkey") % 3 == 0, "4 mm").otherwise("unit")
    cells = F.array("p_name", F.concat(F.lit(" "), "p_brand", F.lit(" ")), F.concat("p_size", F.lit(" %")), F.lit("c"), F.lit("\\alpha"), "p_name", F.lit(""), odd, unit)
    return table(spark, sf, "part").select("p_partkey", F.array_join(M.header_names(cells), ",").alias("names"), M.is_header(cells).alias("header"))


@query(r"""
with d as (select doc_id, string_split(text, chr(10)) as x from documents where text is not null), l as (select doc_id, unnest(x) as said, generate_subscripts(x, 1) - 1 as i from d),
m as (select doc_id, i, case when i % 6 = 5 then '| ' || said || ' |' when (doc_id + i) % 4 = 0 then '## ' || said when (doc_id + i) % 7 = 0 then 'Table 1 ' || said else said end as line from l),
a as (select doc_id, i, contains(line, '|') as row, case when trim(line) = '' or contains(line, '|') or starts_with(trim(line), '[TABLE_PLACEHOLDER]') then null when regexp_matches(trim(line), '(?i)^(表|Table)') then substr(trim(line), 1, 120) when starts_with(trim(line), '#') then substr(trim(regexp_replace(trim(line), '^#+', '')), 1, 120) end as said from m),
w as (select *, last_value(said ignore nulls) over (partition by doc_id order by i rows between 12 preceding and 1 preceding) as anchor, lag(row, 1, false) over (partition by doc_id order by i) as inside from a)
select doc_id, cast(i as bigint) as line, coalesce(anchor, '') as anchor from w where row and not inside""")
def table_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of each table with the nearest caption or heading among the 12 lines before."""
    lines = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "said"))
    n = F.col("doc_id") + F.col("i")
    line = F.when(F.col("i") % 6 == 5, F.concat(F.lit("| "), "said", F.lit(" |"))).when(n % 4 == 0, F.concat(F.lit("## "), "said")).when(n % 7 == 0, F.concat(F.lit("Table 1 "), "said")).otherwise(F.col("said"))
    marked = lines.select("doc_id", "i", F.contains(line, F.lit("|")).alias("row"), M.anchor_text(line).alias("said"))
    w = Window.partitionBy("doc_id").orderBy("i")
    seen = marked.select("*", F.last("said", ignorenulls=True).over(w.rowsBetween(-12, -1)).alias("anchor"), F.lag("row", 1, False).over(w).alias("inside"))
    return seen.where("row and not inside").select("doc_id", F.col("i").cast("bigint").alias("line"), F.coalesce("anchor", F.lit("")).alias("anchor"))


@query("""
with c as (select distinct l_orderkey, l_partkey from lineitem), m as (select l_orderkey, p_partkey from c left join part on p_partkey = l_partkey and p_size <= 10)
select l_orderkey, cast(count(p_partkey) as bigint) as n_images, coalesce(string_agg(cast(p_partkey as varchar), ',' order by p_partkey), '') as images from m group by l_orderkey""")
def chunk_images(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with the pictures of their pages; those without any have an empty list."""
    chunks = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("pages"))
    images = table(spark, sf, "part").where("p_size <= 10").select(F.col("p_partkey").alias("page"))
    met = chunks.select("l_orderkey", F.explode_outer("pages").alias("page")).join(images.withColumn("image", F.col("page")), "page", "left")
    held = met.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("image")).alias("images"))
    return held.select("l_orderkey", F.size("images").cast("bigint").alias("n_images"), F.array_join("images", ",").alias("images"))


@query("""
with b as (select l_orderkey, l_linenumber, l_partkey % 300 as y0, l_partkey % 300 + l_quantity as y1 from lineitem),
g as (select *, case when y0 <= max(y1) over (partition by l_orderkey order by y0, y1, l_linenumber rows between unbounded preceding and 1 preceding) then 0 else 1 end as cut from b)
select l_orderkey, cast(band as bigint) as band, min(y0) as top, max(y1) as bottom, cast(count(*) as bigint) as boxes from (select *, sum(cut) over (partition by l_orderkey order by y0, y1 range between unbounded preceding and current row) as band from g) group by l_orderkey, band""")
def reading_bands(spark: SparkSession, sf: str) -> DataFrame:
    """The boxes of a page in horizontal bands, from the top: a new one begins where all boxes before have ended."""
    top = F.col("l_partkey") % 300
    boxes = table(spark, sf, "lineitem").select("l_orderkey", top.alias("y0"), (top + F.col("l_quantity")).alias("y1"))
    boxes = spread(boxes, "l_orderkey", boxes.count())
    return ledger.bands(boxes, "l_orderkey", "y0", "y1").groupBy("l_orderkey", "band").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.count("*").alias("boxes"))


@query("""
with u as (select user_id, event_type as unit, arg_max(value, (ts, event_id)) filter (where value > 50) as result from events group by all)
select user_id, unit, result, cast(count(*) over (partition by user_id) as bigint) as completed from u""")
def checkpoint_results(spark: SparkSession, sf: str) -> DataFrame:
    """The completed units of each build, every one once, with its last result and their number; partial sums come first, so long histories are short."""
    kept = F.col("value") > 50
    units = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("unit")).agg(F.max_by(F.when(kept, F.col("value")), F.when(kept, F.struct("ts", "event_id"))).alias("result"))
    return units.withColumn("completed", F.count("*").over(Window.partitionBy("user_id")))


@query("""
with b as (select o_orderpriority, count(*) filter (where o_orderstatus = 'P' and o_totalprice > 400000) as busy from orders group by 1),
r as (select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) as place from orders where o_orderstatus = 'O')
select o_orderpriority, o_orderkey, cast(place as bigint) as place from r join b using (o_orderpriority) where place + busy <= 400""")
def dispatch_ready(spark: SparkSession, sf: str) -> DataFrame:
    """What idle workers take from each queue: a top-k by age, 400 workers less the busy ones."""
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate", (F.expr("o_orderstatus = 'P' and o_totalprice > 400000")).alias("active"), (F.col("o_orderstatus") == "O").alias("ready"))
    return ledger.dispatch(orders, "o_orderpriority", "active", "ready", ["o_orderdate", "o_orderkey"], 400).select("o_orderpriority", "o_orderkey", "place")


@query("""
with n as (select l_orderkey, count(*) filter (where l_returnflag = 'N') as entities, count(*) filter (where l_returnflag = 'A') as relations, count(*) filter (where l_returnflag = 'R' and l_linestatus = 'F') as gaps from lineitem group by 1)
select l_orderkey, entities, relations, gaps, case when entities = 0 and relations = 0 then 'FAILED' when relations = 0 or gaps > 0 then 'COMPLETED_WITH_GAPS' else 'COMPLETED' end as status, case when entities = 0 and relations = 0 then 0 else entities end as visible from n""")
def publication_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and outcome of each staged version: failed without any unit, with gaps if relations lack or gaps are known; failed versions show nothing."""
    flag = F.col("l_returnflag")
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(flag == "N").alias("entities"), F.count_if(flag == "A").alias("relations"), F.count_if((flag == "R") & (F.col("l_linestatus") == "F")).alias("gaps"))
    failed = (F.col("entities") == 0) & (F.col("relations") == 0)
    status = F.when(failed, "FAILED").when((F.col("relations") == 0) | (F.col("gaps") > 0), "COMPLETED_WITH_GAPS").otherwise("COMPLETED")
    return n.select("*", status.alias("status"), F.when(failed, 0).otherwise(F.col("entities")).alias("visible"))


@query("""
with e as (select event_id, user_id, ts, event_type = 'signup' as begins, cast(floor(value) as bigint) % 3 as task from events where event_type in ('signup', 'purchase')),
h as (select *, last_value(case when begins then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as held from e)
select h.event_id, h.user_id, h.task, coalesce(b.task = h.task and h.ts <= b.ts + interval 1 day, false) as accepted from h left join e b on b.event_id = h.held where not h.begins""")
def probe_saves(spark: SparkSession, sf: str) -> DataFrame:
    """Saves that are accepted because the last probe begun has their task and is a day old at most."""
    e = table(spark, sf, "events").where("event_type in ('signup', 'purchase')").select("event_id", "user_id", "ts", (F.col("event_type") == "signup").alias("begins"), (F.floor("value").cast("bigint") % 3).alias("task"))
    return ledger.guarded_saves(e, "user_id", "task", "begins", "ts", "event_id").select("event_id", "user_id", "task", "accepted")


@query("""
select user_id, event_type as stage, cast(count(*) as bigint) as attempts, arg_max(value > 100, (ts, event_id)) as completed, cast(epoch_us(max(ts)) - epoch_us(min(ts)) as bigint) as micros from events group by all""")
def page_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts, last state and time from first to last event of every page and stage."""
    last = F.max_by(F.col("value") > 100, F.struct("ts", "event_id"))
    took = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("stage")).agg(F.count("*").alias("attempts"), last.alias("completed"), took.alias("micros"))


@query("""
select s_suppkey, case s_suppkey % 5 when 0 then cast(s_nationkey as bigint) when 1 then cast(s_nationkey as bigint) when 2 then cast(s_nationkey as bigint) end as parent, s_suppkey % 5 <> 4 as named from supplier""")
def parent_ids(spark: SparkSession, sf: str) -> DataFrame:
    """An organisation's parent under the first of three names that has a value; one that is no integer is none."""
    n, key = F.col("s_suppkey") % 5, F.col("s_nationkey").cast("string")
    wrap = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    org = F.when(n == 0, wrap('{"parent_id":', key, ',"parentId":"x"}')).when(n == 1, wrap('{"parent_id":null,"parentId":"', key, '"}')).when(n == 2, wrap('{"parentOrgId":', key, "}")).when(n == 3, wrap('{"parentId":"n', key, '","parentOrgId":1}')).otherwise("{}")
    value = F.coalesce(*[F.get_json_object("org", f"$.{k}") for k in ("parent_id", "parentId", "parentOrgId")])
    return table(spark, sf, "supplier").select("s_suppkey", org.alias("org")).select("s_suppkey", value.try_cast("bigint").alias("parent"), value.isNotNull().alias("named"))


@query("""
with k as (select l_orderkey, l_linenumber - 1 as i, case l_returnflag when 'N' then 'data_table' when 'R' then 'calculation_sheet' else 'form_table' end as kind from lineitem)
select l_orderkey, coalesce(bool_and(kind = 'data_table'), true) as complete, coalesce(string_agg(i || ':' || case when kind = 'calculation_sheet' then 'calculation_sheet_requires_image_review' else 'table_type_requires_review' end, ',' order by i, kind <> 'calculation_sheet') filter (where kind <> 'data_table'), '') as reviews from k group by l_orderkey""")
def table_review(spark: SparkSession, sf: str) -> DataFrame:
    """Whether all tables of a sheet are plain ones, and what the others need."""
    kind = F.when(F.col("l_returnflag") == "N", "data_table").when(F.col("l_returnflag") == "R", "calculation_sheet").otherwise("form_table")
    k = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("i"), kind.alias("kind"))
    reason = F.when(F.col("kind") == "calculation_sheet", "calculation_sheet_requires_image_review").otherwise("table_type_requires_review")
    review = F.when(F.col("kind") != "data_table", F.struct("i", F.concat_ws(":", F.col("i").cast("string"), reason).alias("r")))
    held = k.groupBy("l_orderkey").agg(F.bool_and(F.col("kind") == "data_table").alias("complete"), F.array_sort(F.collect_list(review)).alias("rs"))
    return held.select("l_orderkey", "complete", F.array_join(F.col("rs.r"), ",").alias("reviews"))


@query("""
with m as (select l_orderkey, l_suppkey % 5 as i, min(l_partkey) as title from lineitem group by all having count(*) = 1)
select l.l_orderkey, l_linenumber, coalesce('Part ' || m.title, 'Table ' || l_linenumber) as title from lineitem l left join m on m.l_orderkey = l.l_orderkey and m.i = l_linenumber - 1""")
def positional_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Tables with the metadata that names their position; a position that is named more than once gets none."""
    lines = table(spark, sf, "lineitem")
    entries = lines.groupBy("l_orderkey", (F.col("l_suppkey") % 5 + 1).cast("int").alias("l_linenumber")).agg(F.count("*").alias("n"), F.min("l_partkey").alias("part")).where("n = 1").drop("n")
    title = F.coalesce(F.concat(F.lit("Part "), "part"), F.concat(F.lit("Table "), "l_linenumber"))
    return lines.select("l_orderkey", "l_linenumber").join(entries, ["l_orderkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", title.alias("title"))


@query(r"""
with t as (select p_partkey, case p_partkey % 4 when 0 then 'Table ' || p_size when 1 then p_name when 2 then '表' || p_size else '' end as title, case when p_partkey % 8 = 0 then 'Table ' || p_size else p_name end as inferred from part)
select p_partkey, title <> '' and title <> inferred and regexp_matches(title, '(?i)^(表|Table)') as reliable from t""")
def reliable_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles to trust: they begin like a caption, and are not what the table's own text would give."""
    n, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    numbered = F.concat(F.lit("Table "), size)
    title = F.when(n == 0, numbered).when(n == 1, F.col("p_name")).when(n == 2, F.concat(F.lit("表"), size)).otherwise("")
    inferred = F.when(F.col("p_partkey") % 8 == 0, numbered).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", ((title != "") & (title != inferred) & F.regexp_like(title, F.lit("(?i)^(表|Table)"))).alias("reliable"))


@query(r"""
with d as (select doc_id, string_split(text, chr(10)) as x from documents where text is not null), l as (select doc_id, unnest(x) as said, generate_subscripts(x, 1) - 1 as i from d),
m as (select doc_id, case when i % 5 = 1 then '** ## ' || substr(said, 1, 3) || ' ~~ ' when i % 5 = 2 then substr(said, 1, 1) || '%$' when i % 5 = 3 then '中文' || '..' else said end as line from l)
select doc_id, cast(count(*) as bigint) as lines, cast(count(*) filter (where case when length(line) = 0 then false when length(line) < 5 then not regexp_matches(line, '[\x{4e00}-\x{9fff}]{2}') and length(line) - length(regexp_replace(line, '[^\p{L}\p{N}]', '', 'g')) > 0.5 * length(line)
  else not regexp_matches(line, '[\x{4e00}-\x{9fff}]|[a-z]{4}') and length(line) - length(regexp_replace(line, '[．·~`''"\-+=|!@#$%^&*()\[\]{}<>?/\\,.;:\x{3000}\s]', '', 'g')) > 0.6 * length(line) end) as bigint) as garbage from m group by doc_id""")
def garbage_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each document that are mostly signs."""
    lines = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "said"))
    n = F.col("i") % 5
    line = F.when(n == 1, F.concat(F.lit("** ## "), F.substring("said", 1, 3), F.lit(" ~~ "))).when(n == 2, F.concat(F.substring("said", 1, 1), F.lit("%$"))).when(n == 3, "中文..").otherwise(F.col("said"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(M.is_garbage(line)).alias("garbage"))


@query("""
with f as (select p_partkey, case p_partkey % 4 when 0 then ['view', 'edit', 'required'] when 1 then ['view'] when 2 then [] else ['edit', 'hide'] end as has, p_brand as bound, case when p_partkey % 3 = 0 then ['label', 'colour'] else ['label'] end as props from part)
select p_partkey, 'permission' as issue, k as name from (select p_partkey, has, unnest(['view', 'edit', 'required']) as k from f) where not list_contains(has, k)
union all select p_partkey, 'property', k from (select p_partkey, unnest(props) as k from f) where k not in ('label', 'type', 'permissions', 'binding')
union all select p_partkey, 'binding', bound from f where bound not in (select p_brand from part where p_size > 45)""")
def form_issues(spark: SparkSession, sf: str) -> DataFrame:
    """What a form's fields lack: rules of the three permissions, properties that are known, bindings to a variable that exists."""
    n = F.col("p_partkey") % 4
    rule = lambda *keys: F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<string>")
    has = F.when(n == 0, rule("view", "edit", "required")).when(n == 1, rule("view")).when(n == 2, rule()).otherwise(rule("edit", "hide"))
    props = F.when(F.col("p_partkey") % 3 == 0, rule("label", "colour")).otherwise(rule("label"))
    part = table(spark, sf, "part")
    rows = lambda issue, names: F.transform(names, lambda k: F.struct(F.lit(issue).alias("issue"), k.alias("name")))
    lacks, unknown = F.array_except(rule("view", "edit", "required"), has), F.array_except(props, rule("label", "type", "permissions", "binding"))
    own = part.select("p_partkey", F.explode(F.concat(rows("permission", lacks), rows("property", unknown))).alias("x")).select("p_partkey", "x.issue", "x.name")
    known = part.where("p_size > 45").select("p_brand").distinct()
    return own.unionByName(part.join(known, "p_brand", "left_anti").select("p_partkey", F.lit("binding").alias("issue"), F.col("p_brand").alias("name")))


@query("""
with r as (select l_orderkey, l_linenumber = 1 as token, case l_returnflag when 'A' then 'string' when 'N' then 'integer' else case when l_linestatus = 'F' then 'object' else 'string' end end as type from lineitem),
p as (select l_orderkey, count(*) filter (where not token) as n, count(*) filter (where not token and type in ('object', 'array')) as deep from r group by 1)
select o_orderkey, case when o_orderpriority = '1-URGENT' then false else coalesce(n, 0) <= 3 and coalesce(deep, 0) = 0 end as safe, coalesce(n, 0) as required from orders left join p on l_orderkey = o_orderkey""")
def direct_execution(spark: SparkSession, sf: str) -> DataFrame:
    """Commands that may run at once: no high risk, at most three required parameters besides the session's own, none of them nested."""
    own = F.col("l_linenumber") == 1
    deep = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    needs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(~own).alias("n"), F.count_if(~own & deep).alias("deep"))
    n, d = F.coalesce("n", F.lit(0)), F.coalesce("deep", F.lit(0))
    return table(spark, sf, "orders").join(needs, "o_orderkey", "left").select("o_orderkey", ((F.col("o_orderpriority") != "1-URGENT") & (n <= 3) & (d == 0)).alias("safe"), n.cast("bigint").alias("required"))


@query("""
with a as (select s_suppkey, case s_suppkey % 4 when 0 then n_name when 1 then substr(n_name, 1, 3) || '-x-1' when 2 then 'zz-' || n_name else n_name || '-2' end as asked from supplier join nation on s_nationkey = n_nationkey)
select s_suppkey, asked, coalesce((select min(n_name) from nation where n_name = asked), (select arg_min(n_name, n_nationkey) from nation where starts_with(n_name, split_part(asked, '-', 1)))) as entry, exists(select 1 from nation where n_name = asked) as exact from a""")
def capability_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A model's entry by its whole name, else the first that starts with the part before the dash."""
    nation = table(spark, sf, "nation")
    name, n = F.col("n_name"), F.col("s_suppkey") % 4
    asked = F.when(n == 0, name).when(n == 1, F.concat(F.substring(name, 1, 3), F.lit("-x-1"))).when(n == 2, F.concat(F.lit("zz-"), name)).otherwise(F.concat(name, F.lit("-2")))
    names = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", asked.alias("asked"))
    return ledger.by_beginning(names, nation.select(F.col("n_name").alias("entry"), "n_nationkey"), "asked", "entry", "n_nationkey")


@query("""
with c as (select user_id, cast(ts as date) as day, case when value > 180 then 'MCP.membership.list' when value > 170 then 'get_ROLE' else 'save' end as command, case when event_type = 'view' and value < 10 then 'Membership' else 'misc' end as tag, case when event_type = 'click' and value < 5 then 'Membership' end as source, case when event_type = 'error' and value > 100 then 'A Form for leave' else 'Approval of leave' end as prompt from events)
select user_id, day, bool_or(starts_with(command, 'MCP.membership.') or contains(lower(command), 'member') or contains(lower(command), 'role') or contains(lower(command), 'org') or lower(tag) = 'membership' or lower(coalesce(source, '')) = 'membership') as needs_state,
  case when bool_or(contains(lower(prompt), 'form')) then 'form' else 'bpmn' end as kind from c group by all""")
def planning_needs(spark: SparkSession, sf: str) -> DataFrame:
    """Whether any command of a plan needs the members' directory, and what its prompts ask to be made: a process unless a form is named."""
    kind, value = F.col("event_type"), F.col("value")
    command = F.when(value > 180, "MCP.membership.list").when(value > 170, "get_ROLE").otherwise("save")
    tags = F.array(F.when((kind == "view") & (value < 10), "Membership").otherwise("misc"))
    source = F.when((kind == "click") & (value < 5), "Membership")
    prompt = F.when((kind == "error") & (value > 100), "A Form for leave").otherwise("Approval of leave")
    plans = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day"))
    return plans.agg(F.bool_or(M.needs_members(command, tags, source)).alias("needs_state"), F.when(F.bool_or(M.asks_form(prompt)), "form").otherwise("bpmn").alias("kind"))


@query(r"""
with b as (select l_orderkey, l_linenumber, case l_returnflag when 'N' then 'table' when 'A' then 'figure' else 'text' end as type, case when l_linestatus = 'F' then 'FAILED' else 'OK' end as status, case when l_quantity > 25 then 'layout_content' else 'ocr' end as stage, l_tax > 0.06 as unresolved, '<TABLE><tr><td>' || l_quantity || '</td></tr>' || case when l_suppkey % 2 = 0 then '</table >' else '' end as content from lineitem)
select l_orderkey, l_linenumber, type, not regexp_matches(content, '(?is)<table\b.*</table\s*>') as open from b where type in ('table', 'figure', 'formula') and ((status = 'FAILED' and stage = 'layout_content') or unresolved)""")
def recovery_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of a layout to read again: tables, figures and formulas whose content failed or whose delimiters are open; and whether their HTML is cut off."""
    flag = F.col("l_returnflag")
    kind = F.when(flag == "N", "table").when(flag == "A", "figure").otherwise("text")
    failed = (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 25)
    content = F.concat(F.lit("<TABLE><tr><td>"), F.col("l_quantity").cast("string"), F.lit("</td></tr>"), F.when(F.col("l_suppkey") % 2 == 0, "</table >").otherwise(""))
    b = table(spark, sf, "lineitem").where(kind.isin("table", "figure", "formula") & (failed | (F.col("l_tax") > 0.06)))
    return b.select("l_orderkey", "l_linenumber", kind.alias("type"), M.html_table_open(content).alias("open"))


@query(r"""
select p_partkey, 'Command: ' || p_name || chr(10) || 'Source Type: api' || chr(10) || 'Summary: ' || p_brand || chr(10) || 'Description: ' || case when p_partkey % 2 = 0 then p_type else p_brand end || chr(10) || 'Parameter Names: ' || case p_partkey % 3 when 0 then 'id, size' when 1 then 'name' else '' end || chr(10) || 'Risk Level: ' || case when p_size > 40 then 'high' else 'normal' end as text from part where p_partkey % 7 <> 0""")
def remote_commands(spark: SparkSession, sf: str) -> DataFrame:
    """Search results as commands in the form that is indexed; results that name no command are no commands."""
    key = F.col("p_partkey")
    names = F.when(key % 3 == 0, F.array(F.struct(F.lit("id").alias("name")), F.struct(F.lit("size").alias("name")))).when(key % 3 == 1, F.array(F.struct(F.lit("name").alias("name")))).otherwise(F.array().cast("array<struct<name:string>>"))
    meta = F.struct(F.when(key % 7 != 0, F.col("p_name")).alias("command"), F.when(F.col("p_size") > 40, "high").alias("risk_level"), names.alias("parameters"))
    sent = F.to_json(F.struct(F.col("p_brand").alias("title"), F.when(key % 2 == 0, F.col("p_type")).otherwise(" ").alias("chunkText"), meta.alias("metadata")))
    shape = "title string, chunkText string, content string, metadata struct<command:string, risk_level:string, parameters:array<struct<name:string>>>"
    r = table(spark, sf, "part").select("p_partkey", F.from_json(sent, shape).alias("r")).where("r.metadata.command is not null")
    lines = [("Command", F.col("r.metadata.command")), ("Source Type", F.lit("api")), ("Summary", F.coalesce("r.title", F.lit(""))), ("Description", M.first_text(F.col("r.chunkText"), F.col("r.content"), F.col("r.title")))]
    lines += [("Parameter Names", F.array_join("r.metadata.parameters.name", ", ")), ("Risk Level", F.coalesce("r.metadata.risk_level", F.lit("normal")))]
    return r.select("p_partkey", F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), value) for name, value in lines]).alias("text"))


@query("""
with m as (select p_partkey, unnest(case p_partkey % 5 when 0 then [p_partkey] when 1 then [p_partkey, p_size] when 2 then [p_partkey, p_size, 1] when 3 then [p_partkey] else cast([] as bigint[]) end) as id from part) select p_partkey, cast(id as bigint) as id from m""")
def member_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Members in a reply: a list by itself or under one of four names, or one object with an id; other objects hold none."""
    one, n = "array<struct<id:bigint, username:string>>", F.col("p_partkey") % 5
    made = lambda *ids: F.concat(F.lit("["), F.concat_ws(",", *[F.concat(F.lit('{"id":'), F.col(i).cast("string") if i != "1" else F.lit(i), F.lit("}")) for i in ids]), F.lit("]"))
    reply = F.when(n == 0, made("p_partkey")).when(n == 1, F.concat(F.lit('{"members":'), made("p_partkey", "p_size"), F.lit("}"))).when(n == 2, F.concat(F.lit('{"data":"x","results":'), made("p_partkey", "p_size", "1"), F.lit("}"))).when(n == 3, F.concat(F.lit('{"id":'), F.col("p_partkey").cast("string"), F.lit("}"))).otherwise('{"error":"none"}')
    lists = [F.when(F.startswith(F.get_json_object("reply", path), F.lit("[")), F.from_json(F.get_json_object("reply", path), one)) for path in ("$", "$.data", "$.members", "$.items", "$.results")]
    single = F.when(F.get_json_object("reply", "$.id").isNotNull(), F.from_json(F.concat(F.lit("["), "reply", F.lit("]")), one))
    return table(spark, sf, "part").select("p_partkey", reply.alias("reply")).select("p_partkey", F.explode(F.coalesce(*lists, single)).alias("m")).select("p_partkey", "m.id")


@query(r"""
with t as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace('**' || source || '** costs $x' || doc_id || '$' || chr(10) || chr(10) || chr(10) || chr(10) || text, '\*\*(.+?)\*\*', '\1', 'g'), '\$(.+?)\$', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) as base from documents where text is not null and source is not null)
select doc_id, sha256(base || case when doc_id % 2 = 0 then chr(10) || chr(10) || '[FORMULAS]' || chr(10) || 'x' || doc_id else '' end || case when doc_id % 3 = 0 then chr(10) || chr(10) || '[TABLES]' || chr(10) || 'a' || chr(10) || chr(10) || 'b' else '' end) as content from t""")
def rag_content(spark: SparkSession, sf: str) -> DataFrame:
    """A page as it is indexed: plain text, then its formulas and tables under their tags; digests, as the texts are whole."""
    key = F.col("doc_id")
    raw = F.concat(F.lit("**"), "source", F.lit("** costs $x"), key.cast("string"), F.lit("$\n\n\n\n"), "text")
    section = lambda when, tag, values, glue: F.when(when, F.concat(F.lit(f"[{tag}]\n"), F.concat_ws(glue, *values)))
    parts = [M.plain_markdown(raw), section(key % 2 == 0, "FORMULAS", [F.concat(F.lit("x"), key.cast("string"))], "\n"), section(key % 3 == 0, "TABLES", [F.lit("a"), F.lit("b")], "\n\n")]
    return table(spark, sf, "documents").where("text is not null and source is not null").select("doc_id", F.sha2(F.concat_ws("\n\n", *parts), 256).alias("content"))


@query("""
select p_partkey, cast(p_partkey % 3 as bigint) as tasks, case when p_partkey % 4 = 0 then 'start' when p_partkey % 5 = 0 then 'end' else '' end as missing, p_partkey % 2 = 0 as gateway from part""")
def process_structure(spark: SparkSession, sf: str) -> DataFrame:
    """A process definition's tasks and gateways, counted in its XML, and the first of its two ends that it lacks."""
    key = F.col("p_partkey")
    xml = F.concat(F.lit("<d><process>"), F.when(key % 4 != 0, "<startEvent/>").otherwise(""), F.repeat(F.lit("<userTask/>"), (key % 3).cast("int")), F.when(key % 2 == 0, "<exclusiveGateway/>").otherwise(""), F.when((key % 5 != 0) | (key % 4 == 0), "<endEvent/>").otherwise(""), F.lit("</process></d>"))
    steps = ("userTask", "startEvent", "endEvent", "exclusiveGateway")
    counts = F.xpath_string("xml", F.lit("concat(" + ",' ',".join(f"count(/d/process/{s})" for s in steps) + ")"))  # all from one parse
    made = spread(table(spark, sf, "part").select("p_partkey", xml.alias("xml")), "p_partkey").select("p_partkey", F.split(counts, " ").cast("array<bigint>").alias("n"))
    tasks, starts, ends, gateways = (F.get("n", F.lit(i)) for i in range(4))
    missing = F.when(starts == 0, "start").when(ends == 0, "end").otherwise("")
    return made.select("p_partkey", tasks.alias("tasks"), missing.alias("missing"), (gateways > 0).alias("gateway"))


@query("""
with s as (select n_nationkey, n_regionkey, n_name from nation where n_regionkey <> 0)
select c_custkey, coalesce(n_name, 'default') as provider, n_name is null as fallback from customer left join s on c_nationkey = n_nationkey""")
def settings_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every caller with the settings of its provider, or the default ones; Spark broadcasts the settings while they are small."""
    settings = table(spark, sf, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf, "customer").join(settings, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.lit("default")).alias("provider"), F.col("n_name").isNull().alias("fallback"))

"""Queries over the relational tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.functions.intervals import scalar_kind
from lodestack.operators import graph, lookup
from lodestack.registry import query, table

GRADES = [("x<=10", "small"), ("10<x\\leq 20", "medium"), ("20 < x < 35", "large"), ("35≤x＜45", "huge"), ("\\mathrm{x}>=45", "giant"), ("5~9", "void"), ("50<x<20", "void"), ("40<x", "oversize")]


@query("""
select p_partkey, p_size, g.grade from part join (values ('small', -1, 10), ('medium', 10, 20), ('large', 20, 34), ('huge', 34, 44), ('giant', 44, 1000), ('oversize', 40, 1000)) as g(grade, lo, hi)
on p_size > lo and p_size <= hi""")
def lookup_interval_select(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(GRADES, "rule string, grade string")
    return lookup.interval_lookup(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", rules, "rule").select("p_partkey", "p_size", "grade")


@query(r"""
with v as (select cast(p_size as varchar) as raw from part union all select p_type from part union all select cast(p_size as varchar) || '%' from part
  union all select '0' || cast(p_size as varchar) from part union all select '1 1/' || cast(p_size as varchar) from part union all select 'x<' || cast(p_size as varchar) from part union all select '' from part)
select kind, cast(count(*) as bigint) as n from (
  select case when raw = '' then 'blank' when regexp_full_match(raw, 'x<[0-9]+') then 'interval'
    when regexp_full_match(raw, '-?[0-9]+(\.[0-9]+)?%') and not regexp_matches(raw, '^-?0[0-9]') then 'percent'
    when regexp_full_match(raw, '-?[0-9]+(\.[0-9]+)?') and not regexp_matches(raw, '^-?0[0-9]') then 'number'
    when regexp_full_match(raw, '-?[0-9]+ [0-9]+/[1-9][0-9]*') then 'fraction' else 'text' end as kind from v) group by kind""")
def scalar_kind_histogram(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    raw = F.array(size, F.col("p_type"), F.concat(size, F.lit("%")), F.concat(F.lit("0"), size), F.concat(F.lit("1 1/"), size), F.concat(F.lit("x<"), size), F.lit(""))
    return table(spark, sf, "part").select(F.explode(raw).alias("raw")).groupBy(scalar_kind(F.col("raw")).alias("kind")).agg(F.count("*").alias("n"))


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'O' order by o_orderdate desc, o_orderkey limit 50 offset 50")
def status_scan_paged(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").where("o_orderstatus = 'O'")
    return lookup.page(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], 2, 50).select("o_orderkey", "o_totalprice")


@query("""
select c_custkey, c_name, coalesce(c_mktsegment, 'none') as segment from customer
where c_nationkey in (select n_nationkey from nation where n_nationkey % 5 = 1) order by c_custkey limit 1000""")
def command_set_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    sets = table(spark, sf, "nation").where("n_nationkey % 5 = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    rows = table(spark, sf, "customer").join(sets, "c_nationkey", "left_semi")
    return rows.select("c_custkey", "c_name", F.coalesce("c_mktsegment", F.lit("none")).alias("segment")).orderBy("c_custkey").limit(1000)


@query("""
select o_orderstatus, cast(count(*) as bigint) as rows_read, cast(count(distinct o_orderkey) as bigint) as distinct_ids, count(*) = count(distinct o_orderkey) as complete
from orders group by o_orderstatus""")
def complete_scan_check(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("rows_read"), F.countDistinct("o_orderkey").alias("distinct_ids"))
    return g.withColumn("complete", F.col("rows_read") == F.col("distinct_ids"))


@query("""
select l_returnflag, cast(count(*) as bigint) as n from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F') group by l_returnflag""")
def delete_by_id_list(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(gone, "l_orderkey", "left_anti").groupBy("l_returnflag").agg(F.count("*").alias("n"))


ASKED = ["customer#000000007", " Customer#00000001 ", "nobody", "#0000001"]


@query("""
with q(q) as (values ('customer#000000007'), (' Customer#00000001 '), ('nobody'), ('#0000001')),
h as (select q, c_custkey, case when lower(trim(c_name)) = lower(trim(q)) then 1 else 2 end as tier from q join customer on contains(lower(trim(c_name)), lower(trim(q)))),
b as (select q, min(tier) as tier from h group by q)
select h.q as asked, cast(count(*) as bigint) as n, min(h.c_custkey) as first_key, min(h.tier) as tier, case when count(*) = 1 then 'unique' else 'multiple' end as verdict
from h join b on h.q = b.q and h.tier = b.tier group by h.q""")
def tiered_name_lookup(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.createDataFrame([(q,) for q in ASKED], "asked string")
    hits = lookup.tiered_match(asked, table(spark, sf, "customer").select("c_custkey", "c_name"), "asked", ["c_name"])
    return hits.groupBy("asked").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"), F.min("tier").alias("tier"), F.when(F.count("*") == 1, "unique").otherwise("multiple").alias("verdict"))


NEW_NAMES = [(1, "The Small Steel Company"), (2, "large brushed copper ltd"), (3, "ECONOMY anodized"), (4, "東京"), (5, "standard polished tin")]
_KEY_SQL = "list_sort(list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower({0}), '[^a-z0-9 ]+', ' ', 'g')), ' +'), lambda w: w <> '' and w not in ('company', 'co', 'corp', 'corporation', 'inc', 'llc', 'ltd', 'limited', 'the'))))"


@query(f"""
with n(id, name) as (values (1, 'The Small Steel Company'), (2, 'large brushed copper ltd'), (3, 'ECONOMY anodized'), (4, '東京'), (5, 'standard polished tin')),
a as (select id, {_KEY_SQL.format("name")} as k from n),
b as (select p_type, {_KEY_SQL.format("p_type")} as k from (select distinct p_type from part)),
s as (select id, p_type, case when len(a.k) = 0 or len(b.k) = 0 then 0.0 else cast(len(list_intersect(a.k, b.k)) as double) / len(list_distinct(list_concat(a.k, b.k))) end as score from a, b),
r as (select *, row_number() over (partition by id order by score desc, p_type) as rn from s)
select id, p_type, round(score, 6) as score, case when score >= 0.9 then 'reuse' when score >= 0.75 then 'ask' else 'create' end as verdict from r where rn = 1""")
def org_similarity_best(spark: SparkSession, sf: str) -> DataFrame:
    new = spark.createDataFrame(NEW_NAMES, "id int, name string").withColumn("k", T.semantic_key(F.col("name")))
    known = table(spark, sf, "part").select("p_type").distinct().withColumn("pk", T.semantic_key(F.col("p_type")))
    score = known.join(F.broadcast(new), F.lit(True)).withColumn("score", T.jaccard(F.col("k"), F.col("pk")))
    best = score.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "p_type")).alias("b"))
    s = -F.col("b.s")
    return best.select("id", F.col("b.p_type").alias("p_type"), F.round(s, 6).alias("score"), F.when(s >= 0.9, "reuse").when(s >= 0.75, "ask").otherwise("create").alias("verdict"))


@query()
def org_similarity_difflib(spark: SparkSession, sf: str) -> DataFrame:
    """Best of token Jaccard and sequence ratio; difflib has no SQL form."""
    new = spark.createDataFrame(NEW_NAMES, "id int, name string")
    key = lambda c: F.array_join(T.semantic_key(F.col(c)), " ")

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)

    both = table(spark, sf, "part").select("p_type").distinct().join(F.broadcast(new), F.lit(True))
    both = both.withColumn("score", F.greatest(T.jaccard(T.semantic_key(F.col("name")), T.semantic_key(F.col("p_type"))), ratio(key("name"), key("p_type"))))
    return both.groupBy("id").agg(F.max(F.struct("score", "p_type")).alias("b")).select("id", "b.p_type", F.round("b.score", 6).alias("score"))


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit("REGION").alias("kind"), F.array(F.concat(F.lit("area "), F.lower("r_name"))).alias("aliases"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.col("n_name").alias("name"), F.lit("NATION").alias("kind"), F.array().cast("array<string>").alias("aliases"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("SUPPLIER").alias("kind"), F.array().cast("array<string>").alias("aliases"))
    return r.unionByName(n).unionByName(s)


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("source"), F.concat(F.lit("n"), "n_nationkey").alias("target"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("source"), F.concat(F.lit("s"), "s_suppkey").alias("target"))
    return n.unionByName(s).withColumn("relation", F.lit("HAS_PART")).withColumn("edge", F.concat("source", F.lit(">"), "target"))


@query("""
select 'r' || n_regionkey || '>n' || n_nationkey as edge, r_name as source_name, n_name as target_name, cast('REGION' as varchar) as source_kind, cast('NATION' as varchar) as target_kind
from nation join region on n_regionkey = r_regionkey where lower('area ' || lower(r_name)) = 'area asia'""")
def graph_one_hop(spark: SparkSession, sf: str) -> DataFrame:
    return graph.one_hop(_nodes(spark, sf), _edges(spark, sf), "AREA Asia").select("edge", "source_name", "target_name", "source_kind", "target_kind")


@query("""
select 'kind_not_allowed' as code, 'n' || s_nationkey || '>s' || s_suppkey as subject from supplier where s_nationkey <> 3
union all select 'missing_end', 'n' || s_nationkey || '>s' || s_suppkey from supplier where s_nationkey = 3
union all select 'missing_end', 'r' || n_regionkey || '>n' || n_nationkey from nation where n_nationkey = 3""")
def graph_violations(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([("HAS_PART", "REGION", "NATION")], "relation string, source_kind string, target_kind string")
    return graph.violations(_nodes(spark, sf).where("key <> 'n3'"), _edges(spark, sf), rules)


@query("""
select n_name, c_custkey as evidence, count(c_custkey) over (partition by n_nationkey) as n_evidence, row_number() over (partition by n_nationkey order by c_custkey) as place
from nation left join customer on c_nationkey = n_nationkey and c_acctbal > 5000""")
def evidence_attach(spark: SparkSession, sf: str) -> DataFrame:
    """Each subject with all ids of its evidence, in order, as rows, and their number; a subject without evidence has a row without an id."""
    subjects = table(spark, sf, "nation").select("n_nationkey", "n_name")
    evidence = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("evidence"))
    return graph.attached(subjects, evidence, "n_nationkey", "evidence").select("n_name", "evidence", "n_evidence", "place")


@query("""
with p as (select l_orderkey, l_linenumber, count(*) as n from lineitem where l_returnflag <> 'R' group by 1, 2),
o as (select o_orderkey, o_orderpriority from orders where o_orderkey % 7 <> 0),
j as (select o_orderpriority, coalesce(sum(n), 0) as items, count(n) > 0 as got, coalesce(max(n), 0) > 1 as dup from o left join p on o_orderkey = l_orderkey group by o_orderkey, o_orderpriority)
select o_orderpriority, cast(count(*) as bigint) as identified, cast(count(*) filter (got) as bigint) as extracted, cast(count(*) filter (not got) as bigint) as failed, cast(count(*) filter (dup) as bigint) as duplicates,
 (select cast(count(*) as bigint) from p where l_orderkey not in (select o_orderkey from o)) as orphans, bool_and(got and not dup) as complete from j group by o_orderpriority""")
def ledger_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads (line items) against the ledger (orders): found, missing, doubled and orphaned, by type."""
    payloads = table(spark, sf, "lineitem").where("l_returnflag <> 'R'").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    ledger = table(spark, sf, "orders").where("o_orderkey % 7 <> 0").select("o_orderkey", "o_orderpriority")
    orphans = payloads.join(ledger, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("orphans"))
    each = payloads.groupBy("l_orderkey").agg(F.max("n").alias("most"))
    j = ledger.join(each, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumns({"got": F.col("most").isNotNull(), "dup": F.coalesce(F.col("most") > 1, F.lit(False))})
    n = lambda c: F.count_if(c)
    g = j.groupBy("o_orderpriority").agg(F.count("*").alias("identified"), n(F.col("got")).alias("extracted"), n(~F.col("got")).alias("failed"), n(F.col("dup")).alias("duplicates"), F.bool_and(F.col("got") & ~F.col("dup")).alias("complete"))
    return g.join(F.broadcast(orphans), F.lit(True))  # one row


@query("""
with t as (select distinct (p_partkey % 10) / 10.0 as x0, (p_partkey // 10 % 10) / 10.0 as y0 from part),
f as (select l_orderkey, l_linenumber, (l_partkey % 97) / 97.0 as x, (l_suppkey % 89) / 89.0 as y from lineitem)
select cast(floor(x * 10) as bigint) as cx, cast(floor(y * 10) as bigint) as cy, cast(count(*) as bigint) as n from f join t on x >= x0 and x < x0 + 0.05 and y >= y0 and y < y0 + 0.05 group by 1, 2""")
def bbox_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Points within the boxes of a page: a grid cell makes the containment an equi-join."""
    boxes = table(spark, sf, "part").select(F.expr("(p_partkey % 10) / 10.0D").alias("x0"), F.expr("(p_partkey div 10 % 10) / 10.0D").alias("y0")).distinct()
    boxes = boxes.withColumns({"cx": F.floor(F.col("x0") * 10 + 0.5), "cy": F.floor(F.col("y0") * 10 + 0.5)})
    points = table(spark, sf, "lineitem").select(F.expr("(l_partkey % 97) / 97.0D").alias("x"), F.expr("(l_suppkey % 89) / 89.0D").alias("y"))
    points = points.withColumns({"cx": F.floor(F.col("x") * 10), "cy": F.floor(F.col("y") * 10)})
    within = points.join(boxes, ["cx", "cy"]).where("x >= x0 and x < x0 + 0.05D and y >= y0 and y < y0 + 0.05D")
    return within.groupBy("cx", "cy").agg(F.count("*").alias("n"))


_STEP = "case l_returnflag when 'R' then 'FAILED' when 'A' then 'COMPLETED' else 'PENDING' end"


@query(f"""
with s as (select l_orderkey, {_STEP} as st from lineitem),
x as (select l_orderkey, count(*) filter (st = 'FAILED') as f, count(*) as n from s group by 1)
select case when f = 0 then 'COMPLETED' when f = n then 'FAILED' else 'PARTIAL_FAILED' end as status, cast(count(*) as bigint) as executions, cast(sum(n) as bigint) as steps, cast(sum(f) as bigint) as failed_steps from x group by 1""")
def execution_status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    steps = table(spark, sf, "lineitem").select("l_orderkey", F.expr(_STEP).alias("st"))
    runs = steps.groupBy("l_orderkey").agg(F.count_if(F.col("st") == "FAILED").alias("f"), F.count("*").alias("n"))
    status = F.when(F.col("f") == 0, "COMPLETED").when(F.col("f") == F.col("n"), "FAILED").otherwise("PARTIAL_FAILED")
    return runs.groupBy(status.alias("status")).agg(F.count("*").alias("executions"), F.sum("n").alias("steps"), F.sum("f").alias("failed_steps"))


@query(f"""
with s as (select l_orderkey, l_linenumber, {_STEP} as st from lineitem)
select l_orderkey, case when count(*) filter (st = 'COMPLETED') = count(*) then 'COMPLETED' when count(*) filter (st = 'FAILED') > 0 and count(*) filter (st = 'PENDING') = 0 then 'FAILED'
  when count(*) filter (st = 'FAILED') > 0 then 'PARTIAL_FAILED' else 'UPLOADED' end as status,
  cast(100 * count(*) filter (st = 'COMPLETED') // count(*) as bigint) as progress, coalesce(string_agg(case when st = 'FAILED' then cast(l_linenumber as varchar) end, ',' order by l_linenumber), '') as failed_pages
from s group by l_orderkey""")
def task_progress(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_STEP).alias("st"))
    n = lambda v: F.count_if(F.col("st") == v)
    g = s.groupBy("l_orderkey").agg(F.count("*").alias("n"), n("COMPLETED").alias("c"), n("FAILED").alias("f"), n("PENDING").alias("p"), F.array_sort(F.collect_list(F.when(F.col("st") == "FAILED", F.col("l_linenumber")))).alias("bad"))
    status = F.when(F.col("c") == F.col("n"), "COMPLETED").when((F.col("f") > 0) & (F.col("p") == 0), "FAILED").when(F.col("f") > 0, "PARTIAL_FAILED").otherwise("UPLOADED")
    return g.select("l_orderkey", status.alias("status"), F.floor(100 * F.col("c") / F.col("n")).alias("progress"), F.array_join(F.transform("bad", lambda x: x.cast("string")), ",").alias("failed_pages"))


@query("""
select s_name, cast(sum(cast(l_quantity as decimal(18,2)) * cast(l_extendedprice as decimal(18,2))) as decimal(38,4)) as cost
from lineitem join supplier on l_suppkey = s_suppkey group by s_name""")
def provider_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Usage times unit price per provider; aggregated by key before the names are joined."""
    used = F.col("l_quantity").cast("decimal(18,2)") * F.col("l_extendedprice").cast("decimal(18,2)")
    by = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum(used).alias("cost"))
    joined = by.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("s_name").agg(F.sum("cost").cast("decimal(38,4)").alias("cost"))


@query("""
with r as (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_size desc, p_retailprice, p_partkey) as rn from part where p_type like '%ECONOMY%' and p_size >= 5)
select p_brand, p_partkey from r where rn = 1""")
def provider_select(spark: SparkSession, sf: str) -> DataFrame:
    """The provider per need: enough capability, then priority, then cost."""
    able = table(spark, sf, "part").where("p_type like '%ECONOMY%' and p_size >= 5")
    best = able.groupBy("p_brand").agg(F.min(F.struct((-F.col("p_size")).alias("s"), "p_retailprice", "p_partkey")).alias("b"))
    return best.select("p_brand", "b.p_partkey")


@query("""
with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders)
select o_custkey, cast(count(*) filter (rn <= 3) as bigint) as kept, cast(count(*) filter (rn > 3) as bigint) as deleted, max(case when rn = 1 then o_orderkey end) as newest from r group by 1""")
def retention_top3(spark: SparkSession, sf: str) -> DataFrame:
    rows = lookup.newest(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3)
    newest = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return rows.groupBy("o_custkey").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("deleted"), newest.alias("newest"))


@query("""
with recursive n(key, parent, name) as (
  select 'r' || r_regionkey, cast(null as varchar), r_name from region
  union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name from nation
  union all select 's' || s_suppkey, 'n' || s_nationkey, s_name from supplier),
w(key, name, depth, path) as (
  select key, name, 0, name from n where parent is null
  union all select n.key, n.name, depth + 1, path || '/' || n.name from n join w on n.parent = w.key where depth < 5)
select key, depth, path from w""")
def hierarchy_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Descendants with their path. Levels are joined one after another; the depth is bounded."""
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("key"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("key"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.col("s_name").alias("name"))
    view = f"lodestack_nodes_{uuid.uuid4().hex}"
    r.unionByName(n).unionByName(s).createOrReplaceTempView(view)
    return spark.sql(f"""
with recursive w(key, name, depth, path) as (
  select key, name, 0, name from {view} where parent is null
  union all select n.key, n.name, w.depth + 1, w.path || '/' || n.name from {view} n join w on n.parent = w.key where w.depth < 5)
select key, depth, path from w""")


@query("""
select 'p_brand' as column_name, cast(count(distinct p_brand) as bigint) as n_distinct, cast(count(*) filter (p_brand is null or p_brand = '') as bigint) as blanks, max(length(p_brand)) as longest from part
union all select 'p_type', cast(count(distinct p_type) as bigint), cast(count(*) filter (p_type is null or p_type = '') as bigint), max(length(p_type)) from part
union all select 'p_name', cast(count(distinct p_name) as bigint), cast(count(*) filter (p_name is null or p_name = '') as bigint), max(length(p_name)) from part""")
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    """One pass over the table, a row per column."""
    names = ["p_brand", "p_type", "p_name"]
    long = table(spark, sf, "part").select(F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("v")) for n in names])).alias("x")).select("x.*")
    return long.groupBy("column_name").agg(F.countDistinct("v").alias("n_distinct"), F.count_if(F.coalesce(F.col("v") == "", F.lit(True))).alias("blanks"), F.max(F.length("v")).cast("long").alias("longest"))


@query("""
with d as (select distinct o_custkey, cast(o_orderdate as date) as d from orders),
g as (select o_custkey, d, lag(d) over (partition by o_custkey order by d) as prev from d)
select o_custkey, cast(count(*) filter (d - prev > 30) as bigint) as gaps, cast(max(coalesce(d - prev, 0)) as bigint) as longest from g group by 1""")
def coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d")).distinct()
    gap = F.datediff("d", F.lag("d").over(Window.partitionBy("o_custkey").orderBy("d")))
    return d.withColumn("gap", gap).groupBy("o_custkey").agg(F.count_if(F.col("gap") > 30).alias("gaps"), F.max(F.coalesce("gap", F.lit(0))).cast("long").alias("longest"))


@query("""
with a as (select c_custkey, 'direct' as origin, c_mktsegment as permission from customer union all select o_custkey, 'role', o_orderpriority from orders union all select o_custkey, 'role', c_mktsegment from orders join customer on o_custkey = c_custkey)
select c_custkey, permission, min(origin) as origin from a group by 1, 2""")
def effective_permissions(spark: SparkSession, sf: str) -> DataFrame:
    """Permissions from all sources, each once, direct ones first."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").distinct()
    direct = c.select("c_custkey", F.lit("direct").alias("origin"), F.col("c_mktsegment").alias("permission"))
    role = o.join(c, "c_custkey", "left").select("c_custkey", F.lit("role").alias("origin"), F.explode(F.array_compact(F.array("o_orderpriority", "c_mktsegment"))).alias("permission"))
    return direct.unionByName(role).groupBy("c_custkey", "permission").agg(F.min("origin").alias("origin"))


@query("""
select l.l_orderkey, l.l_linenumber as later, e.l_linenumber as earlier from lineitem l join lineitem e on l.l_orderkey = e.l_orderkey and e.l_linenumber < l.l_linenumber
and e.l_shipdate <= l.l_shipdate + interval 3 day and l.l_shipdate <= e.l_shipdate + interval 3 day""")
def interval_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of three days within one order that overlap."""
    x = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("later"), F.col("l_shipdate").alias("d1"))
    y = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("earlier"), F.col("l_shipdate").alias("d2"))
    return x.join(y, "l_orderkey").where("earlier < later and d2 <= d1 + interval 3 day and d1 <= d2 + interval 3 day").select("l_orderkey", "later", "earlier")

"""Queries on runs, steps, commands and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import numbers as N
from lodestack.operators import versions
from lodestack.registry import query, table


@query("""
select l_orderkey, string_agg(cast(l_linenumber as varchar), ',' order by l_linenumber desc) as steps from lineitem where l_returnflag = 'A' and l_linenumber >= 2 group by l_orderkey""")
def rollback_order(spark: SparkSession, sf: str) -> DataFrame:
    """Successful steps from the second on, last one first."""
    done = table(spark, sf, "lineitem").where("l_returnflag = 'A' and l_linenumber >= 2")
    steps = F.sort_array(F.collect_list("l_linenumber"), asc=False)
    return done.groupBy("l_orderkey").agg(F.array_join(F.transform(steps, lambda s: s.cast("string")), ",").alias("steps"))


@query("""
with s as (select l_orderkey, l_linenumber, l_tax > 0.04 as depends, max(case when l_returnflag = 'R' then 1 else 0 end) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_tax rows between unbounded preceding and 1 preceding) as failed from lineitem)
select l_orderkey, cast(count(*) filter (depends and failed = 1) as bigint) as skipped, cast(count(*) as bigint) as steps from s group by l_orderkey""")
def skip_after_failure(spark: SparkSession, sf: str) -> DataFrame:
    """Steps that depend on others and follow a failed one."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_tax").rowsBetween(Window.unboundedPreceding, -1)
    s = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_tax") > 0.04).alias("depends"), F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).over(w).alias("failed"))
    return s.groupBy("l_orderkey").agg(F.count_if(F.col("depends") & (F.col("failed") == 1)).alias("skipped"), F.count("*").alias("steps"))


_CATEGORY = "case when value >= 90 then 'timeout' when value >= 60 then 'permission' when value >= 30 then 'not_found' else 'unknown' end"


@query(f"""
with r as (select user_id, {_CATEGORY} as category, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events where event_type = 'error')
select user_id, category, category in ('timeout', 'not_found') as recoverable from r where rn = 1""")
def last_error_category(spark: SparkSession, sf: str) -> DataFrame:
    """The category of each run's last failed step."""
    e = table(spark, sf, "events").where("event_type = 'error'").withColumn("category", F.expr(_CATEGORY))
    last = e.groupBy("user_id").agg(F.max_by("category", F.struct("ts", "event_id")).alias("category"))
    return last.withColumn("recoverable", F.col("category").isin("timeout", "not_found"))


@query("""
with n as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type = 'error')
select user_id, cast(count(*) as bigint) as attempts, cast(sum(least(60, power(2, least(n - 1, 20)))) as bigint) as seconds from n group by user_id""")
def retry_schedule(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf, "events").where("event_type = 'error'").withColumn("n", n)
    return e.groupBy("user_id").agg(F.count("*").alias("attempts"), F.sum(N.retry_delay(F.least("n", F.lit(21)))).alias("seconds"))


@query(r"""
with v as (select unnest([p_type, p_brand, cast(p_size as varchar), cast(p_size as varchar) || ',5', cast(p_size as varchar) || ' %', cast(p_size as varchar) || ' °C', '1:' || cast(p_size as varchar), '1-' || cast(p_size as varchar), '', 'p#' || cast(p_partkey as varchar)]) as raw from part),
t as (select lower(trim(raw)) as t from v)
select case when t = '' then 'blank' when regexp_matches(t, '^-?[0-9]+([.,][0-9]+)?\s*%$') then 'percent' when regexp_matches(t, '^-?[0-9]+([.,][0-9]+)?\s*°\s*[cf]$') then 'temperature' when regexp_matches(t, '^-?[0-9]+([.,][0-9]+)?\s*[~-]\s*[0-9]+([.,][0-9]+)?$') then 'range'
  when regexp_matches(t, '^[0-9]+\s*[:/]\s*[0-9]+$') then 'ratio' when regexp_matches(t, '^-?[0-9]+$') then 'integer' when regexp_matches(t, '^-?[0-9]+[.,][0-9]+$') then 'decimal' when regexp_matches(t, '^[a-z]+#[0-9]+$') then 'model'
  when regexp_matches(t, '\b(steel|copper|nickel|brass|tin)\b') then 'material' when regexp_matches(t, '\b(anodized|burnished|plated|polished|brushed)\b') then 'status' else 'text' end as category, cast(count(*) as bigint) as n from t group by 1""")
def cell_categories(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size").cast("string")
    raw = F.array("p_type", "p_brand", s, F.concat(s, F.lit(",5")), F.concat(s, F.lit(" %")), F.concat(s, F.lit(" °C")), F.concat(F.lit("1:"), s), F.concat(F.lit("1-"), s), F.lit(""), F.concat(F.lit("p#"), F.col("p_partkey").cast("string")))
    return table(spark, sf, "part").select(F.explode(raw).alias("raw")).groupBy(N.cell_category(F.col("raw")).alias("category")).agg(F.count("*").alias("n"))


@query("""
with b as (select l_orderkey, l_linenumber, (l_partkey % 500) / 1.0 as x0, (l_suppkey % 700) / 1.0 as y0, l_quantity as w from lineitem),
n as (select l_orderkey, l_linenumber, round(x0 / 600, 6) as x0, round(y0 / 800, 6) as y0, round((x0 + w) / 600, 6) as x1, round((y0 + w) / 800, 6) as y1, x0 + w <= 1 and y0 + w <= 1 as u from b)
select l_orderkey, l_linenumber, x0, y0, x1, y1 from n where not u and x0 >= 0 and y0 >= 0 and x1 <= 1 and y1 <= 1 and x0 < x1 and y0 < y1""")
def bbox_normalise(spark: SparkSession, sf: str) -> DataFrame:
    x, y, w = F.expr("(l_partkey % 500) / 1.0D"), F.expr("(l_suppkey % 700) / 1.0D"), F.col("l_quantity")
    box = N.normalised_box(x, y, x + w, y + w, F.lit(600.0), F.lit(800.0))
    rows = table(spark, sf, "lineitem").where(~((x + w <= 1) & (y + w <= 1))).select("l_orderkey", "l_linenumber", box.alias("b"))
    return rows.where("b is not null").select("l_orderkey", "l_linenumber", "b.*")


@query(r"""
select page_id, regexp_matches(url, '^https://[^/?#]+(/[^?#]*)?$') and not regexp_matches(url, '/\.\.?(/|$)') and not regexp_matches(lower(url), '\.(pdf|zip|png|jpg|exe)$') as safe from pages""")
def safe_links(spark: SparkSession, sf: str) -> DataFrame:
    """https with a host, no query, fragment, dot segments or binary suffix."""
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", (like(url, r"^https://[^/?#]+(/[^?#]*)?$") & ~like(url, r"/\.\.?(/|$)") & ~like(F.lower(url), r"\.(pdf|zip|png|jpg|exe)$")).alias("safe"))


@query("""
with o as (select l_orderkey, max(l_linenumber) as top, count(distinct l_linenumber) as seen from lineitem where l_returnflag <> 'R' group by 1),
m as (select l_orderkey, string_agg(cast(i as varchar), ',' order by i) as missing from (select l_orderkey, unnest(range(1, top + 1)) as i from o) x where not exists (select 1 from lineitem l where l.l_returnflag <> 'R' and l.l_orderkey = x.l_orderkey and l.l_linenumber = x.i) group by 1)
select o.l_orderkey, coalesce(missing, '') as missing, missing is null as complete from o left join m on o.l_orderkey = m.l_orderkey""")
def page_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Expected minus observed pages of each run, as sets within the run's own row."""
    seen = table(spark, sf, "lineitem").where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("s"), F.max("l_linenumber").alias("top"))
    missing = F.array_except(F.sequence(F.lit(1), F.col("top")), "s")
    return seen.select("l_orderkey", F.array_join(F.transform(missing, lambda i: i.cast("string")), ",").alias("missing"), (F.size(missing) == 0).alias("complete"))


@query("""
with r as (select p_brand, p_partkey, p_retailprice, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rn from part),
b as (select p_brand, max(case when rn = 1 then p_partkey end) as best, max(case when rn = 1 then p_retailprice end) as s1, max(case when rn = 2 then p_retailprice end) as s2 from r group by 1)
select p_brand, case when s1 >= 1 and s1 - coalesce(s2, 0) >= 2 then best end as chosen, case when s1 >= 1 and s1 - coalesce(s2, 0) >= 2 then 'aligned' else 'ambiguous' end as verdict from b""")
def argmax_with_margin(spark: SparkSession, sf: str) -> DataFrame:
    """The best candidate, if it is good and leads by a margin."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    r = table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice").withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    at = lambda n, c: F.max(F.when(F.col("rn") == n, F.col(c)))
    b = r.groupBy("p_brand").agg(at(1, "p_partkey").alias("best"), at(1, "p_retailprice").alias("s1"), at(2, "p_retailprice").alias("s2"))
    good = (F.col("s1") >= 1) & (F.col("s1") - F.coalesce("s2", F.lit(0.0)) >= 2)
    return b.select("p_brand", F.when(good, F.col("best")).alias("chosen"), F.when(good, "aligned").otherwise("ambiguous").alias("verdict"))


@query("""
select o_custkey, o_orderpriority, cast(count(*) as bigint) as claims, cast(count(distinct o_orderstatus) as bigint) as readings, count(distinct o_orderstatus) > 1 as conflicting, greatest(0.0, round(1.0 - 0.3 * (count(distinct o_orderstatus) - 1) - case when count(*) < 2 then 0.1 else 0 end, 2)) as confidence
from orders group by 1, 2""")
def claim_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("claims"), F.countDistinct("o_orderstatus").alias("readings"))
    score = F.round(F.lit(1.0) - F.lit(0.3) * (F.col("readings") - 1) - F.when(F.col("claims") < 2, 0.1).otherwise(0.0), 2)
    return g.withColumns({"conflicting": F.col("readings") > 1, "confidence": F.greatest(F.lit(0.0), score)})


@query("""
select conv_id, sha256(string_agg(role || ': ' || text, chr(10) order by turn, role, text)) as composed, cast(greatest(1, sum(length(text)) // 4) as bigint) as tokens from conversations group by conv_id""")
def ordered_compose(spark: SparkSession, sf: str) -> DataFrame:
    """The turns of a conversation in order, as one text."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("t"), F.sum(F.length("text")).alias("n"))
    whole = F.array_join(F.transform("t", lambda s: F.concat(s["role"], F.lit(": "), s["text"])), "\n")
    return c.select("conv_id", F.sha2(whole, 256).alias("composed"), F.greatest(F.lit(1), F.floor(F.col("n") / 4)).cast("long").alias("tokens"))


@query("""
select event_id, upper(case event_type when 'view' then 'get' when 'signup' then 'post' when 'purchase' then 'put' when 'error' then 'delete' else 'patch' end) as method, '/users/' || user_id || '/' || event_type as path,
  case when event_type = 'error' then 'high' when event_type in ('signup', 'purchase') then 'medium' else 'low' end as risk, case when json_extract_string(props, '$.k') is null then 'k' else '' end as missing from events""")
def command_import(spark: SparkSession, sf: str) -> DataFrame:
    """Commands "METHOD /path", taken apart, with their risk by verb and the required parameters that are missing."""
    verb = F.expr("case event_type when 'view' then 'get' when 'signup' then 'post' when 'purchase' then 'put' when 'error' then 'delete' else 'patch' end")
    command = F.concat(verb, F.lit(" /users/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"))
    e = table(spark, sf, "events").select("event_id", "props", F.regexp_extract(command, r"^(\w+)\s+(\S+)$", 1).alias("verb"), F.regexp_extract(command, r"^(\w+)\s+(\S+)$", 2).alias("path"))
    risk = F.when(F.col("verb") == "delete", "high").when(F.col("verb").isin("post", "put"), "medium").otherwise("low")
    missing = F.array_except(F.array(F.lit("k")), F.coalesce(F.expr("json_object_keys(props)"), F.array().cast("array<string>")))
    return e.select("event_id", F.upper("verb").alias("method"), "path", risk.alias("risk"), F.array_join(missing, ",").alias("missing"))


@query("""
with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders where o_orderstatus = 'F'),
a as (select o_custkey, max(o_orderdate) as newest from orders group by 1)
select r.o_custkey, r.o_orderkey, o.o_orderdate < a.newest as stale from r join orders o on r.o_orderkey = o.o_orderkey join a on r.o_custkey = a.o_custkey where rn = 1""")
def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    """The latest completed version of each key, and whether something newer exists."""
    o = table(spark, sf, "orders")
    done = versions.latest_completed(o, "o_custkey", "o_orderkey", F.col("o_orderdate"), F.col("o_orderstatus") == "F")
    newest = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("newest"))
    return done.join(newest, "o_custkey").select("o_custkey", "o_orderkey", (F.col("at") < F.col("newest")).alias("stale"))


@query("""
select l_orderkey, l_linenumber, cast(count(*) as bigint) as records from lineitem group by 1, 2 having count(distinct cast(l_partkey as varchar) || '/' || cast(l_suppkey as varchar)) > 1""")
def publication_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return versions.conflicts(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("""
with p as (select c_custkey, c_nationkey, c_mktsegment from customer where c_custkey % 2 = 0), e as (select c_custkey as entry, c_nationkey, c_mktsegment from customer where c_custkey % 2 = 1),
a as (select c_custkey, entry from (select *, row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey) as rn from p) join (select *, row_number() over (partition by c_nationkey, c_mktsegment order by entry) as rn from e) using (c_nationkey, c_mktsegment, rn)),
b as (select c_custkey, entry from (select *, row_number() over (partition by c_nationkey order by c_custkey) as rn from p where c_custkey not in (select c_custkey from a)) join (select *, row_number() over (partition by c_nationkey order by entry) as rn from e where entry not in (select entry from a)) using (c_nationkey, rn))
select c_custkey, entry, 1 as tier from a union all select c_custkey, entry, 2 from b""")
def recovery_match(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads to ledger entries by precedence, each entry once."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    entries = c.where("c_custkey % 2 = 1").withColumnRenamed("c_custkey", "entry")
    return versions.matched(c.where("c_custkey % 2 = 0"), entries, "c_custkey", "entry", [(["c_nationkey", "c_mktsegment"], None), (["c_nationkey"], None)])


@query("""
with t as (select p_partkey, list_distinct(list_filter(string_split(lower(p_name), ' '), lambda w: length(w) >= 2)) as a, list_distinct(list_filter(string_split(lower(p_type), ' '), lambda w: length(w) >= 2)) as b from part)
select p_partkey, cast(len(list_intersect(a, b)) as bigint) as shared, len(list_intersect(a, b)) >= 1 as fragment from t""")
def table_token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of a line that a table has too."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda w: F.length(w) >= 2))
    shared = F.size(F.array_intersect(tokens("p_name"), tokens("p_type")))
    return table(spark, sf, "part").select("p_partkey", shared.cast("long").alias("shared"), (shared >= 1).alias("fragment"))


@query("""
select user_id, event_id, attempt, attempt > 3 as exhausted from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as attempt from events where event_type = 'signup')""")
def start_or_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Each start of the same work is one attempt more than the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").where("event_type = 'signup'").withColumn("attempt", F.row_number().over(w).cast("long"))
    return e.select("user_id", "event_id", "attempt", (F.col("attempt") > 3).alias("exhausted"))

"""Queries on the layout of texts: lines by kind, headings, shapes of tables, excerpts, bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.registry import query, table


def _kind(line: Column) -> Column:
    like = lambda p: F.regexp_like(line, F.lit(p))
    return F.when(like("^ *$"), "blank").when(like(r"\|"), "table").when(like("^#{1,6} |^[0-9]+([.][0-9]+)* "), "heading").when(like("^ *[-*•] "), "list").when(like(r"\$\$|\\\["), "formula").otherwise("text")


_KIND_SQL = r"case when regexp_matches(x, '^ *$') then 'blank' when regexp_matches(x, '\|') then 'table' when regexp_matches(x, '^#{1,6} |^[0-9]+([.][0-9]+)* ') then 'heading' when regexp_matches(x, '^ *[-*•] ') then 'list' when regexp_matches(x, '\$\$|\\\[') then 'formula' else 'text' end"


@query(f"""
select doc_id, case when k in ('text', 'table', 'heading', 'blank') then k else 'other' end as kind, cast(count(*) as bigint) as n
from (select doc_id, {_KIND_SQL} as k from (select doc_id, unnest(string_split(text, chr(10))) as x from documents)) group by 1, 2""")
def block_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each document by kind; counted within the document's own row."""
    kinds = F.transform(F.split("text", "\n"), _kind)
    named = ["text", "table", "heading", "blank"]
    n = lambda k: F.size(F.filter(kinds, lambda x: x == k))
    other = F.size(F.filter(kinds, lambda x: ~x.isin(*named)))
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), n(k).cast("long").alias("n")) for k in named], F.struct(F.lit("other").alias("kind"), other.cast("long").alias("n")))
    return table(spark, sf, "documents").select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.kind", "r.n").where("n > 0")


_HEADING = "<h([1-6])[^>]*>([^<]*)</h[1-6]>"


@query(f"""
select page_id, cast(i as bigint) as place, cast(l as bigint) as level, trim(t, ' ') as title from (
  select page_id, unnest(regexp_extract_all(html, '{_HEADING}', 1)) as l, unnest(regexp_extract_all(html, '{_HEADING}', 2)) as t, unnest(range(len(regexp_extract_all(html, '{_HEADING}', 1)))) as i from pages)""")
def heading_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The headings of each page in order, with their levels."""
    found = lambda g: F.regexp_extract_all("html", F.lit(_HEADING), F.lit(g))
    h = table(spark, sf, "pages").select("page_id", F.posexplode(F.arrays_zip(found(1).alias("l"), found(2).alias("t"))).alias("i", "h"))
    return h.select("page_id", F.col("i").cast("long").alias("place"), F.col("h.l").cast("long").alias("level"), F.trim("h.t").alias("title"))


@query(r"""
with r as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')) as rows from documents where contains(text, '|')),
w as (select doc_id, list_transform(rows, lambda x: len(string_split(x, '|'))) as w from r)
select doc_id, cast(len(w) as bigint) as n_rows, cast(list_max(w) as bigint) as n_cols, list_max(w) = list_min(w) as even, list_max(w) >= 12 or len(w) >= 16 or list_sum(w) >= 180 as large from w""")
def table_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and columns of what is piped, whether all rows are equally wide, and whether it is a large table."""
    widths = F.transform(F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("|"))), lambda x: F.size(F.split(x, r"\|")))
    t = table(spark, sf, "documents").where(F.contains("text", F.lit("|"))).select("doc_id", widths.alias("w"))
    total = F.aggregate("w", F.lit(0), lambda acc, x: acc + x)
    return t.select("doc_id", F.size("w").cast("long").alias("n_rows"), F.array_max("w").cast("long").alias("n_cols"), (F.array_max("w") == F.array_min("w")).alias("even"), ((F.array_max("w") >= 12) | (F.size("w") >= 16) | (total >= 180)).alias("large"))


@query(r"""
with m as (select doc_id, length(text) as n, length(regexp_replace(text, '[A-Za-zÀ-ÿ]', '', 'g')) as other, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|'))) as pipes from documents)
select doc_id, case when n < 50 then 'recognise' when other > 0.6 * n then 'recognise' when pipes >= 5 then 'tables' when other > 0.3 * n then 'mixed' else 'direct' end as route from m""")
def route_decision(spark: SparkSession, sf: str) -> DataFrame:
    """How a page is to be read, by ordered thresholds on its measures."""
    t, n = F.col("text"), F.length("text")
    other = F.length(F.regexp_replace(t, "[A-Za-zÀ-ÿ]", ""))
    pipes = F.size(F.filter(F.split(t, "\n"), lambda x: F.contains(x, F.lit("|"))))
    route = F.when((n < 50) | (other > 0.6 * n), "recognise").when(pipes >= 5, "tables").when(other > 0.3 * n, "mixed").otherwise("direct")
    return table(spark, sf, "documents").select("doc_id", route.alias("route"))


@query(r"""
with h as (select doc_id, text, strpos(lower(text), 'license') as p from documents where contains(lower(text), 'license'))
select doc_id, cast(p as bigint) as at, sha256(substr(text, greatest(p - 100, 1), least(p, 101) + 199)) as excerpt, regexp_matches(substr(lower(text), greatest(p - 80, 1), least(p, 81) - 1), '(^|[^a-z])(no|not|without)[^a-z.!?][^.!?]*$') as negated from h""")
def term_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """A window around a term's first hit, and whether a negation stands before it in the same sentence."""
    low = F.lower("text")
    h = table(spark, sf, "documents").where(F.contains(low, F.lit("license"))).select("doc_id", "text", F.instr(low, "license").alias("p"))
    p = F.col("p")
    before = F.substring(F.lower("text"), F.greatest(p - 80, F.lit(1)), F.least(p, F.lit(81)) - 1)
    return h.select("doc_id", p.cast("long").alias("at"), F.sha2(F.substring("text", F.greatest(p - 100, F.lit(1)), F.least(p, F.lit(101)) + 199), 256).alias("excerpt"), F.regexp_like(before, F.lit(r"(^|[^a-z])(no|not|without)[^a-z.!?][^.!?]*$")).alias("negated"))


@query("""
select doc_id, sha256(coalesce(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^#{1,6} '))[1], trim(substr(text, 1, 100), ' '))) as summary from documents""")
def page_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The first heading, else the first 100 characters."""
    head = F.try_element_at(F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit("^#{1,6} "))), F.lit(1))
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce(head, F.trim(F.substring("text", 1, 100))), 256).alias("summary"))


@query("""
with w as (select c_custkey, c_nationkey as wanted from customer), k as (select s_nationkey, count(*) as n, min(s_suppkey) as s from supplier group by 1)
select c_custkey, case when n = 1 then s end as mapped, case when n is null then 'not_found' when n > 1 then 'duplicate' else 'mapped' end as reason from w left join k on wanted = s_nationkey""")
def one_to_one_map(spark: SparkSession, sf: str) -> DataFrame:
    """Each id to its only counterpart, or the reason why not."""
    k = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("s"))
    j = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(k, "c_nationkey", "left")
    return j.select("c_custkey", F.when(F.col("n") == 1, F.col("s")).alias("mapped"), F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "duplicate").otherwise("mapped").alias("reason"))


@query("""
with b as (select l_orderkey as page, l_linenumber as id, l_partkey % 100 as x0, l_suppkey % 60 as y0, l_partkey % 100 + 10 as x1, l_suppkey % 60 + 1 + l_quantity as y1 from lineitem),
p as (select f.page, f.id as formula, f.x0 as fx, f.y0 as fy, l.id as label, count(*) over (partition by f.page, f.id, f.x0, f.y0, f.y1) as n from b f join b l on f.page = l.page and l.x0 >= f.x1 and least(f.y1, l.y1) - greatest(f.y0, l.y0) >= 0.5 * least(f.y1 - f.y0, l.y1 - l.y0))
select page, formula, fx, fy, label from p where n = 1""")
def label_binding(spark: SparkSession, sf: str) -> DataFrame:
    """Labels to the right of a formula that overlap half of the lower height, where there is only one; pages are joined by key."""
    b = table(spark, sf, "lineitem").selectExpr("l_orderkey as page", "l_linenumber as id", "l_partkey % 100 as x0", "l_suppkey % 60 as y0", "l_partkey % 100 + 10 as x1", "l_suppkey % 60 + 1 + l_quantity as y1")
    f, r = b.alias("f"), b.alias("r")
    both = F.least("f.y1", "r.y1") - F.greatest("f.y0", "r.y0") >= 0.5 * F.least(F.col("f.y1") - F.col("f.y0"), F.col("r.y1") - F.col("r.y0"))
    p = f.join(r, (F.col("f.page") == F.col("r.page")) & (F.col("r.x0") >= F.col("f.x1")) & both)
    g = p.groupBy(F.col("f.page").alias("page"), F.col("f.id").alias("formula"), F.col("f.x0").alias("fx"), F.col("f.y0").alias("fy"), F.col("f.y1").alias("y1")).agg(F.count("*").alias("n"), F.min("r.id").alias("label"))
    return g.where("n = 1").select("page", "formula", "fx", "fy", "label")


@query("""
with recursive c as (select conv_id, length(text) as n, row_number() over (partition by conv_id order by turn, role, text) as i from conversations),
f(conv_id, i, batch, size, units) as (
  select conv_id, i, 0, n, 1 from c where i = 1
  union all select c.conv_id, c.i, case when f.size + c.n > 12000 or f.units >= 40 then f.batch + 1 else f.batch end, case when f.size + c.n > 12000 or f.units >= 40 then c.n else f.size + c.n end,
    case when f.size + c.n > 12000 or f.units >= 40 then 1 else f.units + 1 end from f join c on c.conv_id = f.conv_id and c.i = f.i + 1)
select conv_id, cast(batch as bigint) as batch, cast(max(units) as bigint) as units, cast(max(size) as bigint) as chars from f group by 1, 2""")
def batches_by_size(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation's units in order; a batch ends where one more would make over 12000 characters or over 40 units.

    A unit of more characters is a batch of its own. Only lengths are gathered, of one conversation at a time.
    """
    c = table(spark, sf, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("at"), F.length("text").alias("n"))
    sizes = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at.turn", "at.role", F.xxhash64("at.text").alias("h"), "n"))), lambda x: x["n"]).alias("sizes"))

    def step(acc: Column, n: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        full = F.coalesce((last["chars"] + n > 12000) | (last["units"] >= 40), F.lit(True))
        one = F.struct(n.cast("long").alias("chars"), F.lit(1).cast("long").alias("units"))
        more = F.struct((last["chars"] + n).cast("long").alias("chars"), (last["units"] + 1).cast("long").alias("units"))
        return F.when(full, F.array_append(acc, one)).otherwise(F.array_append(F.slice(acc, 1, F.size(acc) - 1), more))

    batches = F.aggregate("sizes", F.array().cast("array<struct<chars:bigint,units:bigint>>"), step)
    return sizes.select("conv_id", F.posexplode(batches).alias("batch", "b")).select("conv_id", F.col("batch").cast("long").alias("batch"), "b.units", "b.chars")

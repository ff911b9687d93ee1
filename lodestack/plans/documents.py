"""Queries over documents, pages, benchmark, labels, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import chunking, lookup
from lodestack.registry import query, table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


@query("""
with d as (select doc_id, length(text) as n, text from documents)
select doc_id, cast(n as bigint) as text_chars,
  cast(n - length(regexp_replace(text, '[!-/:-@\\[-`{-~]', '', 'g')) as bigint) as symbols,
  cast(len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|') )) as bigint) as pipe_lines,
  cast(len(regexp_extract_all(text, '[!-/:-@\\[-`{-~]{4,}')) as bigint) as long_symbol_runs from d""")
def text_metrics(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    symbol = r"[!-/:-@\[-`{-~]"
    lines = F.filter(F.split(t, "\n"), lambda x: F.contains(x, F.lit("|")))
    return _docs(spark, sf).select("doc_id", F.length(t).cast("long").alias("text_chars"), F.regexp_count(t, F.lit(symbol)).cast("long").alias("symbols"), F.size(lines).cast("long").alias("pipe_lines"), F.regexp_count(t, F.lit(symbol + "{4,}")).cast("long").alias("long_symbol_runs"))


@query(r"""
select doc_id, case when length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) > 0.3 * length(text) then 'zh' else 'en' end as by_share,
  case when length(regexp_replace(t, '[^\x{4e00}-\x{9fff}]', '', 'g')) >= 4 then 'zh' when len(regexp_extract_all(t, '[A-Za-z]+')) >= 3 and length(regexp_replace(t, '[^A-Za-z]', '', 'g')) >= 12 then 'en' end as by_evidence
from (select doc_id, text, regexp_replace(regexp_replace(text, '\$[^$]*\$', ' ', 'g'), '<[^>]*>', ' ', 'g') as t from documents)""")
def language_detect(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.language_by_share(F.col("text")).alias("by_share"), T.language_by_evidence(F.col("text")).alias("by_evidence"))


@query(f"""
select doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^{T.NOISE_LINE}$\\n?', '', 'g'), '{T.NOISE_WITHIN}', '', 'g'), ' {{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))) as cleaned from documents""")
def line_cleaner(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.sha2(T.clean_lines(F.col("text")), 256).alias("cleaned"))


@query(r"""
select page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g'),
  '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'), ' ')) as visible from pages""")
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.sha2(T.html_text(F.col("html")), 256).alias("visible"))


@query("""
select doc_id, cast(i as bigint) as chunk, sha256(c) as sha from (
  select doc_id, unnest(x) as c, unnest(range(1, len(x) + 1)) as i from (
    select doc_id, list_filter(list_transform(range(1, greatest(length(text), 1) + 1, 700), lambda s: trim(substr(text, s, 700), ' ')), lambda c: c <> '') as x from documents))""")
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _docs(spark, sf).select("doc_id", F.posexplode(T.fixed_chunks(F.col("text"), 700)).alias("i", "c"))
    return chunks.select("doc_id", (F.col("i") + 1).cast("long").alias("chunk"), F.sha2("c", 256).alias("sha"))


@query("""
select doc_id, cast(i as bigint) as segment, sha256(c) as sha from (
  select doc_id, unnest(x) as c, unnest(range(1, len(x) + 1)) as i from (
    select doc_id, case when length(text) <= 2000 then [text] else list_transform(range(1, length(text) + 1, 1800), lambda s: substr(text, s, 2000)) end as x from documents))""")
def chunk_overlap(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _docs(spark, sf).select("doc_id", F.posexplode(T.overlapping_chunks(F.col("text"), 2000, 200)).alias("i", "c"))
    return chunks.select("doc_id", (F.col("i") + 1).cast("long").alias("segment"), F.sha2("c", 256).alias("sha"))


@query()
def chunk_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Whole lines packed greedily into chunks; the state of the walk depends on every line before (no SQL form)."""
    return chunking.packed(_docs(spark, sf), size=1200)


@query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents),
p as (select doc_id, i, line, contains(line, '|') as pipe, i - row_number() over (partition by doc_id, contains(line, '|') order by i) as run from l)
select doc_id, cast(min(i) as bigint) as first_line, cast(count(*) as bigint) as table_rows, cast(max(len(string_split(line, '|'))) as bigint) as columns from p where pipe group by doc_id, run having count(*) >= 2""")
def markdown_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of at least two adjacent lines with pipes: found within each document's own array of lines, without a shuffle."""
    lines = F.split("text", "\n")
    piped = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.contains(x, F.lit("|")).alias("pipe"), F.size(F.split(x, r"\|")).alias("n"))), lambda s: s["pipe"])
    runs = F.transform(piped, lambda s, k: F.struct((s["i"] - k).alias("run"), s["i"].alias("i"), s["n"].alias("n")))
    each = F.transform(F.array_distinct(F.transform(runs, lambda r: r["run"])), lambda g: F.filter(runs, lambda r: r["run"] == g))
    t = _docs(spark, sf).where(F.contains("text", F.lit("|"))).select("doc_id", F.explode(F.filter(each, lambda g: F.size(g) >= 2)).alias("g"))
    return t.select("doc_id", F.element_at("g", 1)["i"].cast("long").alias("first_line"), F.size("g").cast("long").alias("table_rows"), F.array_max(F.transform("g", lambda r: r["n"])).cast("long").alias("columns"))


@query("""
with n as (select item_id, text, length(text) as size from benchmark)
select item_id, doc_id, cast(strpos(d.text, n.text) - 1 as bigint) as start, (length(d.text) - length(replace(d.text, n.text, ''))) = size as is_unique from n join documents d on contains(d.text, n.text)""")
def grounding_check(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts that occur verbatim in documents, and whether once: candidates by a hashed anchor, then checked.

    An item's anchor is the 12 characters from its first word that begins within it; without one, its first 12 characters, or all
    of shorter items; empty items are void. A document has such windows at its words, and everywhere only if an item needs that.
    They are looked up in the anchors, which are broadcast if they are few, so that no window is shuffled then. Windows come from
    one pass over stretches of the text, as a cut at a place would count the characters from the text's beginning each time.
    """
    most, stretch = 12, 4096
    word = F.regexp_extract("text", r"(?s)^.+?(?<=[ \n])([^ \n].{11})", 1)
    size = F.when(word != "", 0).otherwise(F.least(F.length("text"), F.lit(most)))
    items = table(spark, sf, "benchmark").where("text <> ''").select("item_id", F.col("text").alias("quote"), size.alias("size"), word.alias("word"))
    items = items.withColumn("anchor", F.xxhash64("size", F.when(F.col("size") == 0, F.col("word")).otherwise(F.substring(F.col("quote"), F.lit(1), F.col("size")))))
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # 13 at most; 0 is at words
    stretches = _docs(spark, sf).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{1,{stretch + most}}})).{{1,{stretch}}}"), F.lit(1))).alias("part"))
    at = lambda n: f"(?s)(?=(.{{{n}}}))" if n else r"(?s)(?<=[ \n])(?=([^ \n].{11}))"
    windows = [F.transform(F.regexp_extract_all("part", F.lit(at(n)), F.lit(1)), lambda w: F.xxhash64(F.lit(n), w)) for n in sizes]  # noqa: B023
    anchors = stretches.select("doc_id", F.explode(F.concat(F.array().cast("array<bigint>"), *windows)).alias("anchor"))
    known = anchors.join(lookup.few(items.select("anchor").distinct()), "anchor", "left_semi").distinct()
    pairs = known.join(lookup.few(items), "anchor").select("doc_id", "item_id", "quote")
    hits = pairs.join(_docs(spark, sf).select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("quote")))
    once = F.length("text") - F.length(F.replace("text", F.col("quote"), F.lit(""))) == F.length("quote")
    return hits.select("item_id", "doc_id", (F.expr("locate(quote, text)") - 1).cast("long").alias("start"), once.alias("is_unique"))


@query("""
select doc_id, case when source = '' then '' when length(source) <= 8 then '***' else substr(source, 1, 4) || '***' || right(source, 4) end as source,
  case when contains(lower(lang || '_key'), 'key') then '***REDACTED***' else lang end as lang, case when length(lang || ':' || doc_id) <= 8 then '***' else substr(lang || ':' || doc_id, 1, 4) || '***' || right(lang || ':' || doc_id, 4) end as label from documents""")
def secret_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Masked values row by row."""
    hidden = F.when(T.is_secret_key(F.concat("lang", F.lit("_key"))), "***REDACTED***").otherwise(F.col("lang"))
    return _docs(spark, sf).select("doc_id", T.masked(F.col("source")).alias("source"), hidden.alias("lang"), T.masked(F.concat("lang", F.lit(":"), F.col("doc_id").cast("string"))).alias("label"))


@query("""
select doc_id, sha256(trim(source, ' ') || chr(0) || trim(lang, ' ') || chr(0) || cast(doc_id as varchar)) as stable,
  sha256(cast(length(source) as varchar) || ':' || source || cast(length(lang) as varchar) || ':' || lang) as prefixed,
  md5('lang=' || lang || '&source=' || source) as cache, substr(sha1(source || cast(doc_id as varchar)), 1, 16) as task,
  'sha256:' || sha256('{"doc_id":' || cast(doc_id as varchar) || ',"lang":"' || lang || '"}') as fingerprint from documents""")
def stable_keys(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    canonical = F.concat(F.lit('{"doc_id":'), i, F.lit(',"lang":"'), F.col("lang"), F.lit('"}'))
    return _docs(spark, sf).select(
        "doc_id", T.stable_key(F.col("source"), F.col("lang"), i).alias("stable"), T.prefixed_key(F.col("source"), F.col("lang")).alias("prefixed"),
        F.md5(F.concat(F.lit("lang="), "lang", F.lit("&source="), "source")).alias("cache"), F.substring(F.sha1(F.concat("source", i)), 1, 16).alias("task"), F.concat(F.lit("sha256:"), F.sha2(canonical, 256)).alias("fingerprint"),
    )


@query("select min(doc_id) as doc_id, cast(count(*) as bigint) as copies from documents where trim(text, ' ') <> '' group by trim(text, ' ')")
def dedupe_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    """Grouped by a hash and the length of the text: the shuffle carries no text."""
    t = F.trim("text")
    return _docs(spark, sf).where(t != "").groupBy(F.sha2(t, 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query(r"""
select doc_id, coalesce(array_to_string(list_slice(k, 1, 20), ','), '') as keywords from (
  select doc_id, list_transform(list_sort(list_transform(list_distinct(w), lambda x: {'p': list_position(w, x), 'x': x})), lambda s: s.x) as k from (
    select doc_id, regexp_extract_all(lower(text), '[a-z]{8,}') as w from documents))""")
def keyword_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 distinct long words, by first position."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0)))
    return _docs(spark, sf).select("doc_id", F.array_join(F.slice(words, 1, 20), ",").alias("keywords"))


@query("""
select reason, cast(count(*) as bigint) as n from (
  select unnest(list_filter([case when length(text) < 200 then 'short' end, case when quality = 0 then 'low_quality' end, case when toxic = 1 then 'toxic' end, case when l.doc_id is null then 'unlabelled' end], lambda x: x is not null)) as reason
  from documents d left join labels l on d.doc_id = l.doc_id) group by reason""")
def data_quality_reasons(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("doc_id", F.length("text").alias("n")).join(table(spark, sf, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    reasons = F.array(F.when(F.col("n") < 200, "short"), F.when(F.col("quality") == 0, "low_quality"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("known").isNull(), "unlabelled"))
    return d.select(F.explode(F.array_compact(reasons)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""
with q as (select embedding as e from embeddings where vec_id = 0),
s as (select vec_id, round(list_dot_product(list_transform(x.embedding, lambda v: cast(v as double)), list_transform(q.e, lambda v: cast(v as double))) / (sqrt(list_sum(list_transform(x.embedding, lambda v: cast(v as double) * v))) * sqrt(list_sum(list_transform(q.e, lambda v: cast(v as double) * v)))), 6) as score from embeddings x, q)
select vec_id, score from s where score >= 0.1 order by score desc, vec_id limit 10""")
def semantic_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of one vector, above a threshold; one row is broadcast."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    q = F.broadcast(e.where("vec_id = 0").select(F.col("e").alias("q")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    score = F.round(dot("e", "q") / (F.sqrt(dot("e", "e")) * F.sqrt(dot("q", "q"))), 6)
    return e.join(q, F.lit(True)).select("vec_id", score.alias("score")).where("score >= 0.1").orderBy(F.desc("score"), "vec_id").limit(10)


@query("""
with t as (select conv_id, turn, role, lag(role) over w as before, lag(text) over w as earlier, text from conversations window w as (partition by conv_id order by turn, role, text))
select conv_id, cast(count(*) as bigint) as turns, cast(count(*) filter (role = before) as bigint) as continued, cast(count(*) filter (substr(text, 1, 20) = substr(earlier, 1, 20)) as bigint) as repeated from t group by conv_id""")
def continuation_pages(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = table(spark, sf, "conversations").withColumns({"before": F.lag("role").over(w), "head": F.substring("text", 1, 20)}).withColumn("earlier", F.lag("head").over(w))
    return t.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == F.col("before")).alias("continued"), F.count_if(F.col("head") == F.col("earlier")).alias("repeated"))


@query(r"""
with s as (select doc_id, source, n_chars, regexp_matches(lower(text), 'license|copyright') as legal from documents),
k as (select *, row_number() over (partition by source order by n_chars desc, doc_id) as rn, count(*) over (partition by source) as n, max(n_chars) over (partition by source) as top from s),
c as (select *, row_number() over (partition by source order by legal desc, rn) as place from k where rn <= 30 and n >= 3 and top >= 500)
select source, doc_id, cast(place as bigint) as place from c where place <= 15""")
def retrieval_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Top 30 by score; nothing if they are few or the best is weak; preferred ones first, cut at 15."""
    d = _docs(spark, sf).select("doc_id", "source", "n_chars", F.regexp_like(F.lower("text"), F.lit("license|copyright")).alias("legal"))
    by = Window.partitionBy("source")
    k = d.withColumn("rn", F.row_number().over(by.orderBy(F.desc("n_chars"), "doc_id"))).where("rn <= 30").withColumns({"n": F.count("*").over(by), "top": F.max("n_chars").over(by)}).where("n >= 3 and top >= 500")
    return k.withColumn("place", F.row_number().over(by.orderBy(F.desc("legal"), "rn")).cast("long")).where("place <= 15").select("source", "doc_id", "place")


@query("""
select lang, string_agg(cast(doc_id as varchar), ',' order by source_no, doc_id) as order_of from (
  select lang, doc_id, cast(substr(source, 4) as int) as source_no, row_number() over (partition by lang, source order by doc_id) as rn from documents where regexp_full_match(source, 'src[0-9]+')) where rn = 1 group by lang""")
def chapter_merge_sort(spark: SparkSession, sf: str) -> DataFrame:
    """The first document of each numbered part, in numeric order of the parts."""
    d = _docs(spark, sf).where(F.regexp_like("source", F.lit("^src[0-9]+$"))).groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id"))
    ordered = F.array_sort(F.collect_list(F.struct(F.substring("source", 4, 9).cast("int").alias("no"), "doc_id")))
    return d.groupBy("lang").agg(ordered.alias("o")).select("lang", F.array_join(F.transform("o", lambda s: s["doc_id"].cast("string")), ",").alias("order_of"))


@query(r"""
with d as (select doc_id, list_distinct(regexp_extract_all(text, '[A-Z]{2,}')) as s from documents),
x as (select doc_id, unnest(s) as symbol from d), n as (select symbol, count(*) as docs, min(doc_id) as first_doc from x group by symbol)
select symbol, cast(docs as bigint) as docs, case when docs = 1 then first_doc end as defined_in, case when docs = 1 then 'resolved' else 'unresolved' end as verdict from n""")
def symbol_dependency(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols resolve to a document if it is the only one that has them."""
    x = _docs(spark, sf).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Z]{2,}"), F.lit(0)))).alias("symbol"))
    n = x.groupBy("symbol").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))
    return n.select("symbol", "docs", F.when(F.col("docs") == 1, F.col("first_doc")).alias("defined_in"), F.when(F.col("docs") == 1, "resolved").otherwise("unresolved").alias("verdict"))

"""Queries on objects, quotations and names within whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import marks as M
from lodestack.functions import prose as P
from lodestack.functions import spans
from lodestack.operators import mentions, sections, splices
from lodestack.registry import query, table


def _answer() -> Column:
    """A document's text without signs, with objects in it: nested ones, braces in strings, broken tails, none, several, no JSON."""
    k, n = F.col("doc_id") % 7, F.col("n_chars").cast("string")
    plain = F.regexp_replace("text", r'[{}"\\]', " ")
    q = F.lit('"')
    made = (
        F.when(k == 0, F.concat(F.lit('{"a": {"b": [1, {"c": "x}y"}], "n": '), n, F.lit('}, "d": "q\\"{"} and more }')))
        .when(k == 1, F.concat(F.lit('{"a": {"n": '), n, F.lit("} ")))
        .when(k == 2, F.lit(""))
        .when(k == 3, F.concat(F.lit('{"first": {}} then {"n": '), n, F.lit("}")))
        .when(k == 4, F.concat(F.lit("{"), q, F.col("lang"), F.lit('{": "}", "e": {"f": {}}}')))
        .when(k == 5, F.concat(F.lit("{n: "), n, F.lit('} or {"b": 2}')))
        .otherwise(F.concat(F.lit('\\{ "open {" }} {"'), F.col("source"), F.lit('": 1}')))
    )
    half = F.floor(F.length(plain) / 2).cast("int")
    return F.concat(F.substring(plain, F.lit(1), half), made, F.substring(plain, half + 1, F.length(plain)))


@query(r"""
with d as (select *, regexp_replace(text, '[{}"\\]', ' ', 'g') as plain, doc_id % 7 as k from documents),
t as (select doc_id, left(plain, length(plain) // 2) || case k when 0 then '{"a": {"b": [1, {"c": "x}y"}], "n": ' || n_chars || '}, "d": "q\"{"} and more }' when 1 then '{"a": {"n": ' || n_chars || '} ' when 2 then '' when 3 then '{"first": {}} then {"n": ' || n_chars || '}'
  when 4 then '{"' || lang || '{": "}", "e": {"f": {}}}' when 5 then '{n: ' || n_chars || '} or {"b": 2}' else '\{ "open {" }} {"' || source || '": 1}' end || substr(plain, length(plain) // 2 + 1) as t from d),
s as (select doc_id, case when contains(t, '{') then substr(t, instr(t, '{')) end as s from t),
p as (select doc_id, list_reduce(list_concat([{'w': '', 'd': 0, 'q': false, 'o': '', 'e': false}], list_transform(regexp_extract_all(s, '(?s:\\.)|["{}]|[^"{}\\]+|\\'), lambda w: {'w': w, 'd': 0, 'q': false, 'o': '', 'e': false})),
  lambda a, x: {'w': '', 'd': a.d + case when a.q then 0 when x.w = '{' then 1 when x.w = '}' then -1 else 0 end, 'q': case when x.w = '"' then not a.q else a.q end, 'o': case when a.e then a.o else a.o || x.w end, 'e': a.e or (not a.q and x.w = '}' and a.d = 1)}) as r from s)
select doc_id, case when r.e then r.o end as object, case when r.e then json_valid(r.o) end as parses from p""")
def balanced_objects(spark: SparkSession, sf: str) -> DataFrame:
    """The first object of each answer, to the brace that closes it, and whether it is JSON."""
    found = table(spark, sf, "documents").select("doc_id", spans.balanced_object(_answer()).alias("object"))
    return found.withColumn("parses", F.when(F.col("object").isNotNull(), F.try_parse_json("object").isNotNull()))


@query("""
with d as (select doc_id, text, length(text) as n, doc_id % 9 as k from documents),
q as (select *, case k when 0 then substr(text, n // 3 + 1, 30) when 8 then substr(text, 1, 8) || '...' || substr(text, n // 2 + 1, 30) when 7 then 'never in any text ... never in any text' when 6 then substr(text, 1, 20) || '...' || substr(text, n // 2 + 1, 20) || '...'
    when 5 then substr(text, n // 2 + 1, 20) || ' ... ' || substr(text, 1, 20) when 4 then substr(text, 1, 14) || '…' || substr(text, n - 13, 14) when 3 then substr(text, n // 4 + 1, 25) || '…' || substr(text, n // 2 + 1, 25) else substr(text, n // 4 + 1, 12 + k) || ' ... ' || substr(text, n // 4 + 40, 40) end as quote from d),
e as (select *, (length(quote) - length(replace(quote, '...', ''))) // 3 + length(quote) - length(replace(quote, '…', '')) as marks, case when contains(quote, '...') then '...' else '…' end as mark from q),
h as (select *, trim(string_split(quote, mark)[1], ' ') as head, trim(string_split(quote, mark)[-1], ' ') as tail from e),
c as (select *, case when head <> '' then (n - length(replace(text, head, ''))) // length(head) end as heads, case when tail <> '' then (n - length(replace(text, tail, ''))) // length(tail) end as tails, instr(text, head) - 1 as first, instr(text, tail) - 1 as last from h),
s as (select *, case when quote = '' then 'none' when contains(text, quote) then 'exact' when marks <> 1 or length(head) < 12 or length(tail) < 12 or heads = 0 or tails = 0 then 'none' when heads > 1 or tails > 1 then 'several'
    when last >= first + length(head) and last + length(tail) - first <= 5000 then 'restored' else 'none' end as state from c)
select doc_id, state, case state when 'exact' then instr(text, quote) - 1 when 'restored' then first end as start, case state when 'exact' then substr(text, instr(text, quote), length(quote)) when 'restored' then substr(text, first + 1, last + length(tail) - first) end as quotation from s""")
def quotations(spark: SparkSession, sf: str) -> DataFrame:
    """Quotations with something left out, restored from the one place that they can come from."""
    n, k, t = F.length("text"), F.col("doc_id") % 9, F.col("text")
    at = lambda share: F.floor(n / share).cast("int") + 1
    sub = lambda start, size: F.substring(t, start, F.lit(size) if isinstance(size, int) else size)
    dots, one = F.lit("..."), F.lit(1)
    quote = (
        F.when(k == 0, sub(at(3), 30))
        .when(k == 8, F.concat(sub(one, 8), dots, sub(at(2), 30)))
        .when(k == 7, "never in any text ... never in any text")
        .when(k == 6, F.concat(sub(one, 20), dots, sub(at(2), 20), dots))
        .when(k == 5, F.concat(sub(at(2), 20), F.lit(" ... "), sub(one, 20)))
        .when(k == 4, F.concat(sub(one, 14), F.lit("…"), sub(n - 13, 14)))
        .when(k == 3, F.concat(sub(at(4), 25), F.lit("…"), sub(at(2), 25)))
        .otherwise(F.concat(sub(at(4), (k + 12).cast("int")), F.lit(" ... "), sub(at(4) + 39, 40)))
    )
    found = table(spark, sf, "documents").select("doc_id", "text", spans.quotation(t, quote).alias("q"))
    return found.select("doc_id", "q.state", F.col("q.start").cast("long").alias("start"), F.substring(t, F.col("q.start") + 1, F.col("q.length")).alias("quotation"))


@query("""
with w as (select doc_id, text, regexp_extract_all(lower(text), '[a-z0-9._-]+|[^a-z0-9._-]+') as w from documents),
i as (select doc_id, w, unnest(w) as x, generate_subscripts(w, 1) as i from w),
p as (select doc_id, x, i, sum(length(x)) over (partition by doc_id order by i)::bigint as stop from i),
n as (select doc_id, list_filter(w, lambda x: regexp_matches(x, '^[a-z0-9._-]{3,}$')) as names from w),
ab as (select doc_id, names[1] as a, names[4] as b from n where len(names) >= 4),
m as (select l.doc_id, least(l.stop - length(l.x), r.stop - length(r.x)) as s, greatest(l.stop, r.stop) as e from ab join p l on l.doc_id = ab.doc_id and l.x = a join p r on r.doc_id = ab.doc_id and r.x = b where a <> b and greatest(l.stop, r.stop) - least(l.stop - length(l.x), r.stop - length(r.x)) <= 200),
f as (select doc_id, count(*) as n, bool_or(regexp_matches(lower(text[greatest(s - 40, 0) + 1 : e + 80]), 'not |different|versus|compared|instead|exclude|不属于|并非|不同|对比|区别|排除')) as doubt, min((s, e)) as first from m join documents using (doc_id) group by doc_id)
select doc_id, case when n is null then 'none' when doubt then 'ambiguous' else 'found' end as verdict, coalesce(n, 0) as n_pairs, case when not doubt then first[1] end as start, case when not doubt then first[2] end as "end" from ab left join f using (doc_id)""")
def name_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the first and the fourth name of a text stand near each other anywhere in it, in all places, and without a word that parts them."""
    texts = table(spark, sf, "documents").select("doc_id", "text")
    names = F.regexp_extract_all(F.lower("text"), F.lit("(?<![a-z0-9._-])[a-z0-9._-]{3,}"), F.lit(0))
    pairs = texts.select("doc_id", F.get(names, F.lit(0)).alias("a"), F.get(names, F.lit(3)).alias("b")).where("b is not null")
    return mentions.relations(texts, pairs, "doc_id").withColumns({c: F.col(c).cast("long") for c in ("start", "end")})


@query(r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) + doc_id as k from documents),
m as (select doc_id, trim(case k % 11 when 0 then 'GB/T 150.' || (k % 7) || '—20' || (10 + k % 80) when 1 then 'TSG ' || (k % 99) || ' - 2009 ' || x when 2 then ' ' || (k % 12000) || ' ' when 3 then '- ' || (k % 999) || ' —' when 4 then '[Figure: ' || case when k % 2 = 0 then 'Watermark' else 'pump' end || '] ' || x
    when 5 then x || ' HTTPS://a.b' when 6 then case when k % 3 = 0 then 'T σ' when k % 3 = 1 then 'σ／σ' else 'Tp' end when 7 then '' else x end, ' ') as t from l)
select doc_id, kind, count(*) as n from (
  select doc_id, case when regexp_matches(t, '^[A-Z]{1,6}\s*/?\s*[A-Z]?\s*\d+(?:\.\d+)?\s*[—-]\s*\d{4}$|^(?:[A-Z]{1,6}\s*/?\s*[A-Z]?\s*\d+(?:\.\d+)?|TSG\s*\d+)\s*[—-]\s*\d{4}\b|^\d{1,4}$|^[—-]\s*\d{1,4}\s*[—-]$') then 'header'
    when contains(lower(t), '[figure:') and regexp_matches(lower(t), 'watermark|overlay|logo|seal|stamp|背景水印|水印|table with|table of|tabular data') then 'figure'
    when regexp_matches(lower(t), 'http://|https://|www[.]|aqsiq[.]gov[.]cn|国家质监监督检验检疫总局') then 'text' when regexp_replace(t, '\s+', '', 'g') in ('T', 't', 'p', 'σ', 'η', '=', 'Tσ', 'tσ', 'pσ', 'σ／σ') then 'formula' end as kind from m)
where kind is not null group by all""")
def noise_lines(spark: SparkSession, sf: str) -> DataFrame:
    """How many lines of each text are noise, by kind; lines of all kinds are set among the text's own."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    k, x = F.col("i") + 1 + F.col("doc_id"), F.col("x")
    n = lambda c: c.cast("string")
    at = lambda i: k % 11 == i
    line = (
        F.when(at(0), F.concat(F.lit("GB/T 150."), n(k % 7), F.lit("—20"), n(10 + k % 80)))
        .when(at(1), F.concat(F.lit("TSG "), n(k % 99), F.lit(" - 2009 "), x))
        .when(at(2), F.concat(F.lit(" "), n(k % 12000), F.lit(" ")))
        .when(at(3), F.concat(F.lit("- "), n(k % 999), F.lit(" —")))
        .when(at(4), F.concat(F.lit("[Figure: "), F.when(k % 2 == 0, "Watermark").otherwise("pump"), F.lit("] "), x))
        .when(at(5), F.concat(x, F.lit(" HTTPS://a.b")))
        .when(at(6), F.when(k % 3 == 0, "T σ").when(k % 3 == 1, "σ／σ").otherwise("Tp"))
        .when(at(7), "")
        .otherwise(x)
    )
    return lines.select("doc_id", M.noise_kind(line).alias("kind")).where("kind is not null").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query()
def calculation_items(spark: SparkSession, sf: str) -> DataFrame:
    """The sections and items of texts with formulas among their lines, each with the offsets that cut it from its text."""
    k, x = lambda i: (F.col("doc_id") + i) % 9, lambda t: F.translate(t, "$\\#", "")

    def line(t: Column, i: Column) -> Column:
        n = i.cast("string")
        return (
            F.when((k(i) == 0) & (F.col("doc_id") % 2 == 0), F.concat(F.lit("## "), F.substring(x(t), 1, 20)))
            .when(k(i) == 1, F.concat(F.lit("$x_"), n, F.lit(" = a$ $$y$$  ")))
            .when(k(i) == 2, F.concat(F.lit("Note: "), x(t)))
            .when(k(i) == 3, F.concat(F.lit(" \\begin{align} a_"), n, F.lit(" &= \\$1 ")))
            .when(k(i) == 4, F.lit("b \\end{align}"))
            .when(k(i) == 5, "Density — mass per volume")
            .when(k(i) == 6, F.concat(F.lit("Label "), n))
            .otherwise(x(t))
        )

    text = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    return sections.sections(table(spark, sf, "documents").select("doc_id", text.alias("text")), "doc_id")


@query("""
with d as (select doc_id, string_split(text, chr(10)) as w from documents),
l as (select doc_id, generate_subscripts(w, 1) as i, case (doc_id + generate_subscripts(w, 1)) % 5 when 0 then '' when 1 then '  ' || translate(unnest(w), '$' || chr(92), '') || ' ' when 2 then '   ' else translate(unnest(w), '$' || chr(92), '') end as line from d),
p as (select *, trim(line) as kept, coalesce(sum(length(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as pos from l),
k as (select *, pos + length(line) - length(ltrim(line)) as source, coalesce(sum(length(kept) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as place from p where kept <> '')
select doc_id, place::bigint as place, source::bigint as source, length(kept) as length, kept as text from k""")
def tidy_map(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without white space at the ends of lines, and where each line of them stands in the text that was given."""
    k = lambda i: (F.col("doc_id") + i + 1) % 5
    plain = lambda t: F.translate(t, "$\\", "")
    line = lambda t, i: F.when(k(i) == 0, "").when(k(i) == 1, F.concat(F.lit("  "), plain(t), F.lit(" "))).when(k(i) == 2, "   ").otherwise(plain(t))
    given = table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))
    mapped = sections.tidied(given, "doc_id")[1]
    return mapped.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("place", "source", "length")], "text")


@query("""
with d as (select doc_id, text, length(text) as n from documents),
e as (select doc_id, unnest([{'s': n // 3, 'e': n // 3 + 5, 'no': 2, 'w': ''}, {'s': n // 3, 'e': n // 3, 'no': 1, 'w': '['}, {'s': n // 3, 'e': n // 3, 'no': 7, 'w': ']'}, {'s': n // 2, 'e': n // 2 + 7, 'no': 3, 'w': doc_id::varchar}, {'s': n // 2 + 3, 'e': n // 2 + 9, 'no': 4, 'w': '?'}, {'s': n - 2, 'e': n + 5, 'no': 5, 'w': '!'}, {'s': n, 'e': n, 'no': 6, 'w': 'end'}, {'s': n // 2 + 1, 'e': n // 2 + 1, 'no': 8, 'w': 'in'}]) as ed, n from d),
l as (select doc_id, list(ed order by ed.s, ed.e, ed.no) filter (where ed.s >= 0 and ed.e <= n) as l, count(*) filter (where ed.s < 0 or ed.e > n) as outside from e group by doc_id),
r as (select d.doc_id, text, outside, len(l) as n, list_reduce(list_concat([{'s': 0, 'e': 0, 'no': 0, 'w': '', 'at': 0, 'out': '', 'k': 0}], list_transform(l, lambda x: {'s': x.s, 'e': x.e, 'no': x.no, 'w': x.w, 'at': 0, 'out': '', 'k': 0})),
  lambda a, x: case when x.s >= a.at then {'s': 0, 'e': 0, 'no': 0, 'w': '', 'at': x.e, 'out': a.out || substr(text, a.at + 1, x.s - a.at) || x.w, 'k': a.k + 1} else a end) as r from d join l using (doc_id))
select doc_id, r.out || substr(text, r.at + 1) as text, r.k::bigint as n_applied, outside as n_outside, (n - r.k)::bigint as n_overlapping from r""")
def spliced_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts after edits at places that touch, overlap and reach beyond them."""
    texts = table(spark, sf, "documents").select("doc_id", "text")
    n = F.length("text")
    third, half = F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int")
    places = [(third, third + 5, ""), (third, third, "["), (third, third, "]"), (half, half + 7, F.col("doc_id").cast("string")), (half + 3, half + 9, "?"), (n - 2, n + 5, "!"), (n, n, "end"), (half + 1, half + 1, "in")]
    edits = F.array(*[F.struct(a.alias("start"), b.alias("end"), (F.lit(w) if isinstance(w, str) else w).alias("with"), F.lit(no).alias("no")) for (a, b, w), no in zip(places, (2, 1, 7, 3, 4, 5, 6, 8), strict=True)])
    return splices.spliced(texts, texts.select("doc_id", F.inline(edits)), "doc_id")


@query("""
with d as (select doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as w from documents),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from d),
f as (select doc_id, trim(line) as anchor, min(i) as i from l where trim(line) <> '' group by all),
t as (select doc_id, unnest([{'no': 1, 'a': w[1], 't': '| a | b |'}, {'no': 2, 'a': '  ' || w[len(w) // 2 + 1], 't': '| ' || doc_id || ' |'}, {'no': 3, 'a': 'no such line', 't': '| c |'}, {'no': 4, 'a': w[1], 't': '| second |'}], recursive := false) as t from d),
p as (select t.doc_id, t.t.no as no, t.t.t as body, coalesce(f.i, (select max(i) from l where l.doc_id = t.doc_id)) as i from t left join f on f.doc_id = t.doc_id and f.anchor = trim(t.t.a)),
g as (select doc_id, i, string_agg(chr(10) || chr(10) || body || chr(10), '' order by no) as more from p group by all)
select l.doc_id, string_agg(line || coalesce(more, ''), chr(10) order by l.i) as text from l left join g on g.doc_id = l.doc_id and g.i = l.i group by l.doc_id""")
def anchored_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables set below the lines that announce them, in whole texts; those whose line is not there at the end."""
    texts = table(spark, sf, "documents").select("doc_id", "text")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: splices.trimmed(x)), lambda x: x != "")  # as a plain function it would get the index, too
    first, middle = F.get(lines, F.lit(0)), F.get(lines, F.floor(F.size(lines) / 2).cast("int"))
    row = lambda no, anchor, body: F.struct(F.lit(no).alias("no"), anchor.alias("anchor"), body.alias("table"))
    tables = F.array(row(1, first, F.lit("| a | b |")), row(2, F.concat(F.lit("  "), middle), F.concat(F.lit("| "), F.col("doc_id").cast("string"), F.lit(" |"))), row(3, F.lit("no such line"), F.lit("| c |")), row(4, first, F.lit("| second |")))
    edits = splices.below_anchors(texts, texts.select("doc_id", F.inline(tables)), "doc_id")
    return splices.spliced(texts, edits, "doc_id").select("doc_id", "text")


@query("""
with g as (select doc_id, lower(left(text, 60) || case doc_id % 9 when 0 then ' MCP.x' when 1 then ' Deploy it' when 2 then ' an address' when 3 then ' Fetch all' when 4 then ' org chart' when 5 then ' 组织结构' when 6 then ' Mermaid tool ' else '' end) as g, case doc_id % 7 when 0 then 'mcp' when 1 then 'cmdengine' when 2 then 'other' end as r from documents)
select doc_id, case when r in ('cmdengine', 'mcp') then r when regexp_matches(g, 'mcp[.]|tool |server ') then 'mcp' when regexp_matches(g, 'create|add|assign|bind|update|delete|deploy|start|join') then 'cmdengine' when regexp_matches(g, 'show|list|get|fetch|search|find|convert|ocr|extract') then 'mcp' else 'cmdengine' end as mode,
  regexp_matches(g, 'organization structure|organization chart|org chart|org tree|organizational tree|mermaid|组织结构|组织机构|组织关系|组织树|机构关系|机构结构') as chart from g""")
def task_modes(spark: SparkSession, sf: str) -> DataFrame:
    """How tasks are to be run, by request or by the words of their goal, and whether a chart is asked for."""
    k = F.col("doc_id")
    more = F.when(k % 9 == 0, " MCP.x").when(k % 9 == 1, " Deploy it").when(k % 9 == 2, " an address").when(k % 9 == 3, " Fetch all").when(k % 9 == 4, " org chart").when(k % 9 == 5, " 组织结构").when(k % 9 == 6, " Mermaid tool ").otherwise("")
    goal = F.concat(F.substring("text", 1, 60), more)
    requested = F.when(k % 7 == 0, "mcp").when(k % 7 == 1, "cmdengine").when(k % 7 == 2, "other")
    return table(spark, sf, "documents").select("doc_id", P.task_mode(goal, requested).alias("mode"), P.asks_chart(goal).alias("chart"))


@query("""
with d as (select doc_id, replace(text, '$', '') as x, doc_id % 4 as k from documents),
t as (select doc_id, left(x, length(x) // 3) || '$$a_' || doc_id || ' = 1$$' || case k when 0 then ' and 式中：a 为 ' || doc_id || chr(10) || chr(10) || chr(10) || 'b' || chr(10) || ' $$q$$ ' when 1 then '式中:c' || chr(10) || '## Next ' when 2 then ' none ' else '式中：d' || chr(10) || 'A.2.1 on ' end || substr(x, length(x) // 3 + 1) || '$$z$$' as t from d),
f as (select doc_id, regexp_extract_all(t, '(?s:[$][$](.*?)[$][$])') as f, string_split_regex(t, '(?s:[$][$](.*?)[$][$])') as p from t),
b as (select doc_id, unnest(f) as formula, unnest(p[1:len(f)]) as before, unnest(p[2:]) as after, generate_subscripts(f, 1) as place from f),
v as (select *, regexp_extract(after, '(?s:(式中[:：].*))', 1) as told from b)
select doc_id, place, formula, length(before) as n_before, length(after) as n_after, left(trim(regexp_replace(string_split_regex(string_split_regex(told, '(?m:^\\s*(?:#{1,6}\\s+|(?:[A-Z][.])?\\d+(?:[.]\\d+){1,}\\s+))')[1], '\\n\\s*[$][$]')[1], '\\n{2,}', chr(10), 'g'), ' ' || chr(10) || chr(9)), 1200) as variables from v""")
def formula_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Displayed formulas of whole texts, the text up to their neighbours, and what is said of their variables."""
    k, n, x = F.col("doc_id") % 4, F.col("doc_id").cast("string"), F.replace("text", F.lit("$"), F.lit(""))
    third = F.floor(F.length(x) / 3).cast("int")
    more = F.when(k == 0, F.concat(F.lit(" and 式中：a 为 "), n, F.lit("\n\n\nb\n $$q$$ "))).when(k == 1, "式中:c\n## Next ").when(k == 2, " none ").otherwise("式中：d\nA.2.1 on ")
    text = F.concat(F.substring(x, F.lit(1), third), F.lit("$$a_"), n, F.lit(" = 1$$"), more, F.substring(x, third + 1, F.length(x)), F.lit("$$z$$"))
    blocks = table(spark, sf, "documents").select("doc_id", F.posexplode(P.formula_blocks(text)).alias("i", "b"))
    return blocks.select("doc_id", (F.col("i") + 1).cast("long").alias("place"), F.col("b.formula").alias("formula"), F.length("b.before").cast("long").alias("n_before"), F.length("b.after").cast("long").alias("n_after"), P.formula_variables(F.col("b.after")).alias("variables"))

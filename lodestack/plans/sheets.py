"""Queries on tables in pages: projection to records, alignment of ragged rows, reading order of areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.operators import alignment, areas, projection, tables
from lodestack.registry import query, table

# Tables are made of four parts each, with shapes that follow their number t: heads of one or two rows, heads written as plain
# cells, an empty head, a brand over two rows, a name over two columns, a missing price, a footer, captions, loose sizes.


def _sheets(spark: SparkSession, sf: str) -> DataFrame:
    """(t, html)."""
    key = F.col("p_partkey")
    t = F.floor(key / 4)
    size = F.col("p_size").cast("string")
    parts = table(spark, sf, "part").select(
        t.alias("t"), key.alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.format_number("p_retailprice", 2).alias("price"),
        F.when(key % 29 == 0, F.concat(F.lit("~ "), size)).when(key % 10 == 0, F.concat(F.lit("x &gt;= "), size)).otherwise(size).alias("size"),
    )
    rows = parts.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("k", "name", "brand", "size", "price"))).alias("rows"))
    n, t = F.size("rows"), F.col("t")
    td = lambda text, more="": F.concat(F.lit(f"<td{more}>"), text, F.lit("</td>"))
    none = F.lit("")
    wide, tall = t % 11 == 0, (t % 5 == 0) & (t % 11 != 0) & (n > 1)

    def body(x: Column, i: Column) -> Column:
        name = F.when(wide & (i == 0), td(x["name"], ' colspan="2"')).otherwise(td(x["name"]))
        brand = F.when((wide & (i == 0)) | (tall & (i == 1)), none).when(tall & (i == 0), td(x["brand"], ' rowspan="2"')).otherwise(td(x["brand"]))
        price = F.when((t % 13 == 0) & (i == n - 1), none).otherwise(td(x["price"]))
        return F.concat(F.lit("<tr>"), name, brand, td(x["size"]), price, F.lit("</tr>"))

    tag = F.when(t % 17 == 0, "td").otherwise("th")
    cell = lambda text, more="": F.concat(F.lit("<"), tag, F.lit(f"{more}>"), text, F.lit("</"), tag, F.lit(">"))
    last = F.when(t % 23 == 0, none).otherwise("Price")
    head = F.concat(F.lit("<tr>"), cell(F.lit("Name")), cell(F.lit("Brand")), cell(F.lit("Size")), cell(last), F.lit("</tr>"))
    above = F.when(t % 3 == 0, F.concat(F.lit("<tr>"), cell(F.lit("Part"), ' colspan="2"'), cell(F.lit("Measure"), ' colspan="2"'), F.lit("</tr>"))).otherwise(none)
    foot = F.when(t % 7 == 0, '<tfoot><tr><td colspan="4">Total</td></tr></tfoot>').otherwise(none)
    caption = F.when(t % 31 == 0, "See note").when(t % 4 == 1, F.concat(F.lit("Prices "), t.cast("string")))
    lines = F.concat(F.array(above, head), F.transform("rows", body), F.array(foot))
    return rows.select("t", projection.html_of(lines, caption).alias("html"))


#: The same cells by the rules of ``_sheets``, and the rules of ``projection.project`` on them.
_PROJECTED = r"""
with p as (select p_partkey // 4 as t, p_partkey as k, row_number() over (partition by p_partkey // 4 order by p_partkey) - 1 as i, count(*) over (partition by p_partkey // 4) as n, p_name as name, p_brand as brand, format('{:,.2f}', p_retailprice) as price,
  case when p_partkey % 29 = 0 then '~ ' || p_size when p_partkey % 10 = 0 then 'x >= ' || p_size else cast(p_size as varchar) end as size from part),
s as (select t, any_value(n) as n, t % 11 = 0 as wide, t % 5 = 0 and t % 11 <> 0 and any_value(n) > 1 as tall, case when t % 3 = 0 then 2 else 1 end as h, t % 17 <> 0 as head from p group by t),
hd(j, name) as (values (0, 'Name'), (1, 'Brand'), (2, 'Size'), (3, 'Price')),
cells as (
  select t, 0 as row, j as col, 1 as down, 2 as across, head, false as foot, case when j = 0 then 'Part' else 'Measure' end as text from s, hd where h = 2 and j in (0, 2)
  union all select t, h - 1, j, 1, 1, head, false, case when j = 3 and t % 23 = 0 then '' else name end from s, hd
  union all select t, h + i, 0, 1, case when wide and i = 0 then 2 else 1 end, false, false, name from p join s using (t)
  union all select t, h + i, 1, case when tall and i = 0 then 2 else 1 end, 1, false, false, brand from p join s using (t) where not (wide and i = 0) and not (tall and i = 1)
  union all select t, h + i, 2, 1, 1, false, false, size from p join s using (t)
  union all select t, h + i, 3, 1, 1, false, false, price from p join s using (t) where not (t % 13 = 0 and i = p.n - 1)
  union all select t, h + n, 0, 1, 4, false, true, 'Total' from s where t % 7 = 0),
texts as (select t, text from cells union all select t, case when t % 31 = 0 then 'See note' else 'Prices ' || t end from s where t % 31 = 0 or t % 4 = 1),
kinds as (select *, case when text = '' then 'blank' when regexp_full_match(text, 'x >= [0-9]+') then 'interval' when regexp_full_match(text, '-?[0-9]+([.][0-9]+)?') and not regexp_matches(text, '^-?0[0-9]') then 'number' else 'text' end as kind from cells),
g as (select t, unnest(range(row, row + down)) as r, col, down, across, head, text, kind, row, 'r' || row || 'c' || col as ref from kinds),
places as (select t, r, unnest(range(col, col + across)) as c, across, head, text, kind, row, ref from g),
shape as (select t, max(r) + 1 as n_rows, max(c) + 1 as width, count(*) as n_places from places group by t),
starts as (select t, row, bool_and(head) as heads from cells group by t, row),
run as (select t, coalesce(min(row) filter (not heads), max(row) + 1) as n_head from starts group by t),
fields as (select t, c, string_agg(text, ' / ' order by r) as path, bool_or(text <> '') as named from (select t, c, ref, min(r) as r, any_value(text) as text from places join run using (t) where r < n_head group by t, c, ref) group by t, c),
facts as (select t, bool_or(regexp_matches(text, '(?i)\b(if|except|unless|only|note|see|interpolat\w*)\b')) as conditional, bool_or(regexp_matches(text, '[<>≤≥~～]\s*-?\d|\d\s*[~～]') and not regexp_full_match(text, 'x >= [0-9]+')) as loose from texts group by t),
body as (select t, bool_or(foot) as footer, bool_or(across > 1 and row > 0) as spanning, bool_or(across > 1 and row + down > n_head) as wide_body from cells join run using (t) group by t),
v as (select t, n_rows, width, n_head, loose, case when n_head > 0 and n_head < n_rows and n_places = n_rows * width and not conditional and not footer and not wide_body and (select count(*) from fields f where f.t = shape.t and named) = width then null
    when conditional then 'conditional_source_requires_review' when footer then 'footer_requires_review' when spanning then 'body_spanning_cells' when n_places <> n_rows * width then 'ragged_table_rows' else 'ambiguous_header' end as reason
  from shape join run using (t) join facts using (t) join body using (t)),
verdicts as (select *, reason is null and not loose as complete from v)
"""


@query(
    _PROJECTED
    + """
select t, case when complete then 'complete' else 'unavailable' end as status, concat_ws(',', reason, case when loose then 'unsupported_condition' end) as reasons, n_head, case when reason is null then width else 0 end as n_fields, case when reason is null then n_rows - n_head else 0 end as n_records from verdicts"""
)
def table_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Which tables are records under a header, and why the others are not."""
    verdicts, _ = projection.project(projection.source_cells(_sheets(spark, sf), "t", "html"), "t")
    return verdicts.withColumn("reasons", F.array_join("reasons", ",")).withColumns({c: F.col(c).cast("long") for c in ("n_head", "n_fields", "n_records")})


@query(
    _PROJECTED
    + """
select t, r as row, c as col, path, text as value, kind, ref as source, case when ref <> 'r' || r || 'c' || c then 'merged_fill' when text = '' then 'blank_in_source' else 'source' end as status, complete as published
from places join verdicts using (t) join fields using (t, c) where reason is null and r >= n_head"""
)
def table_records(spark: SparkSession, sf: str) -> DataFrame:
    """Each value of the projected tables with its column's names, its kind and the cell that it was read from; those of doubtful tables unpublished."""
    _, records = projection.project(projection.source_cells(_sheets(spark, sf), "t", "html"), "t")
    return records.withColumn("path", F.array_join("path", " / ")).withColumns({c: F.col(c).cast("long") for c in ("row", "col")})


#: The kind of a cell v.
_KIND = r"""case when v = '' then 'blank' when v in ('n/a', 'na', 'n.a.', '?', '？', '无法识别', '看不清', 'unreadable') then 'unreadable' when regexp_matches(v, '^-?[0-9]+([.,][0-9]+)?\s*%$') then 'percent' when regexp_matches(v, '^-?[0-9]+([.,][0-9]+)?\s*°\s*[cf]$') then 'temperature'
  when regexp_matches(v, '^-?[0-9]+([.,][0-9]+)?\s*[~-]\s*[0-9]+([.,][0-9]+)?$') then 'range' when regexp_matches(v, '^[0-9]+\s*[:/]\s*[0-9]+$') then 'ratio' when regexp_matches(v, '^-?[0-9]+$') then 'integer' when regexp_matches(v, '^-?[0-9]+[.,][0-9]+$') then 'decimal' when regexp_matches(v, '^[a-z]+#[0-9]+$') then 'model'
  when regexp_matches(v, '\b(steel|copper|nickel|brass|tin)\b') then 'material' when regexp_matches(v, '\b(anodized|burnished|plated|polished|brushed)\b') then 'status' else 'text' end"""

#: What a cell scores in a column: kind, and the numbers of kinds in the column as m.
_FIT = """case when kind = 'blank' then -50 when kind = 'unreadable' then 0 when raw = 0 and cardinality(m) > 0 then -100 else raw end"""
_RAW = """(case when coalesce(m[kind], 0) > 0 then 300 + least(200, 40 * m[kind]) else 0 end
  + case when kind in ('numeric', 'integer', 'decimal', 'ratio', 'range') and coalesce(m['numeric'], m['integer'], m['decimal'], m['ratio'], m['range']) is not null then 150 else 0 end
  - case when kind = 'ratio' and coalesce(m['integer'], m['temperature']) is not null then 100 when kind = 'integer' and m['ratio'] is not null then 150 when kind = 'decimal' and m['ratio'] is not null then 75 else 0 end
  + case when kind in ('material', 'model', 'text') and coalesce(m['material'], m['model']) is not null then 100 when kind = 'status' and m['status'] is not null then 100 else 0 end)"""


@query(
    """
with c as (select p_partkey, p_type as col, lower(trim(case when p_partkey % 7 = 0 then '1:' || p_size when p_partkey % 5 = 0 then p_size || ',5' when p_partkey % 11 = 0 then '' when p_partkey % 13 = 0 then 'brass ' || p_name when p_partkey % 17 = 0 then 'plated' when p_partkey % 19 = 0 then p_size || ' ~ 9' when p_partkey % 23 = 0 then 'n/a' when p_partkey % 29 = 0 then 'm#' || p_size when p_partkey % 3 = 0 then p_name else cast(p_size as varchar) end)) as v from part),
k as (select *, """
    + _KIND
    + """ as kind from c),
n as (select col, map_from_entries(list((kind, n))) as m from (select col, kind, count(*) as n from k group by all) group by col)
select p_partkey, kind, ("""
    + _FIT
    + ") / 100.0::double as score from (select p_partkey, kind, m, "
    + _RAW
    + """ as raw from k join n using (col))"""
)
def column_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How well each cell fits its column, by how often the column has cells of its kind and of related ones; all kinds are met."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    v = F.when(k % 7 == 0, F.concat(F.lit("1:"), size)).when(k % 5 == 0, F.concat(size, F.lit(",5"))).when(k % 11 == 0, "").when(k % 13 == 0, F.concat(F.lit("brass "), "p_name")).when(k % 17 == 0, "plated").when(k % 19 == 0, F.concat(size, F.lit(" ~ 9"))).when(k % 23 == 0, "n/a").when(k % 29 == 0, F.concat(F.lit("m#"), size)).when(k % 3 == 0, F.col("p_name")).otherwise(size)
    cells = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("col"), alignment.cell_kind(v).alias("kind"))
    counts = cells.groupBy("col", "kind").agg(F.count("*").cast("int").alias("n")).groupBy("col").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("counts"))  # an entry a kind
    return cells.join(counts, "col").select("p_partkey", "kind", (alignment.cell_score(F.col("kind"), F.col("counts")) / 100.0).alias("score"))


def _ragged(spark: SparkSession, sf: str) -> DataFrame:
    """(t, row, cells): tables of twelve parts each under a header, with cells of all kinds, some rows short at an end or at both."""
    k = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    word = F.array(*[F.lit(x) for x in ("brass ", "plated ", "", "steel ", "")])
    first = F.when(k % 13 == 0, "N/A").otherwise(F.concat(F.get(word, k % 5), "p_name"))
    measure = F.when(k % 4 == 1, F.concat(size, F.lit(" ~ "), (F.col("p_size") + 3).cast("string"))).when(k % 17 == 0, "").when(k % 4 == 2, F.concat(size, F.lit(",5"))).otherwise(size)
    share = F.when(k % 7 == 0, F.concat(size, F.lit(" %"))).otherwise(F.concat(F.lit("1:"), size))
    heat = F.when(k % 24 < 12, F.concat(size, F.lit(" °C"))).when(k % 9 == 0, "brushed").otherwise(F.col("p_type"))
    cells = F.array(first, F.replace("p_brand", F.lit("Brand"), F.lit("b")), measure, share, heat)
    left = F.when(k % 6 == 2, 1).when(k % 10 == 3, 2).otherwise(0)
    right = F.when(k % 8 == 5, 1).when(k % 14 == 4, 2).otherwise(0)
    kept = F.slice(cells, left + 1, 5 - left - right)
    body = table(spark, sf, "part").select(F.floor(k / 12).alias("t"), (k % 12 + 1).cast("int").alias("row"), F.when(k % 25 == 7, F.concat(cells, F.array(F.lit("more")))).otherwise(kept).alias("cells"))
    head = body.select("t").distinct().select("t", F.lit(0).alias("row"), F.array(F.lit("名称"), F.lit("Model"), F.lit("Size mm"), F.lit("系数"), F.when(F.col("t") % 2 == 0, "State").otherwise("处理")).alias("cells"))
    return body.unionByName(head)


@query(
    r"""
with p as (select p_partkey as k, p_partkey // 12 as t, p_partkey % 12 + 1 as row, cast(p_size as varchar) as s, * from part),
q as (select k, t, row, case when k % 6 = 2 then 1 when k % 10 = 3 then 2 else 0 end as l, case when k % 8 = 5 then 1 when k % 14 = 4 then 2 else 0 end as r,
  [case when k % 13 = 0 then 'N/A' else ['brass ', 'plated ', '', 'steel ', ''][k % 5 + 1] || p_name end, replace(p_brand, 'Brand', 'b'), case when k % 4 = 1 then s || ' ~ ' || (p_size + 3) when k % 17 = 0 then '' when k % 4 = 2 then s || ',5' else s end,
   case when k % 7 = 0 then s || ' %' else '1:' || s end, case when k % 24 < 12 then s || ' °C' when k % 9 = 0 then 'brushed' else p_type end] as full_cells from p),
rows as (select t, row, case when k % 25 = 7 then list_append(full_cells, 'more') else full_cells[l + 1 : 5 - r] end as cells from q union all select distinct t, 0, ['名称', 'Model', 'Size mm', '系数', case when t % 2 = 0 then 'State' else '处理' end] from q),
counted as (select t, col, kind, count(*) as n from (
  select t, col, case when row = 0 then case col when 1 then 'material' when 2 then 'text' when 3 then 'range' when 4 then 'ratio' else case when t % 2 = 0 then 'text' else 'status' end end else """
    + _KIND
    + r""" end as kind
  from (select t, row, unnest(range(1, 6)) as col, lower(trim(unnest(cells))) as v from rows where len(cells) = 5)
  ) where kind <> 'blank' group by all),
profiles as (select t, col, map_from_entries(list((kind, n))) as m from counted group by t, col),
last as (select t, row, cells, max(case when row > 0 and len(cells) = 5 then row end) over (partition by t order by row rows between unbounded preceding and 1 preceding) as b from rows),
short as (select last.t, last.row, last.cells, b, rows.cells as above from last join rows on rows.t = last.t and rows.row = b where last.row > 0 and len(last.cells) < 5),
ways as (select t, row, cells, above, b, unnest(range(0, 6 - len(cells))) as l from short),
each as (select w.*, col, case when col - l between 1 and len(cells) then lower(trim(cells[col - l])) end as v from ways w, range(1, 6) c(col)),
scored as (select t, row, b, l, sum(case when v is null then case when above[col] <> '' then 35 else 0 end else fit end)::int as score from (
    select *, """
    + _FIT
    + " as fit from (select *, "
    + _RAW
    + r""" as raw from (select e.*, coalesce(m, map {}) as m, """
    + _KIND
    + r""" as kind from each e left join profiles using (t, col)))) group by t, row, b, l),
best as (select t, row, b, arg_min(l, (-score, l)) as l, max(score) as top, list(score order by score desc) as scores from scored group by t, row, b),
fits as (select t, row, b, l from best where top >= 100 and top - scores[2] >= 200)
select t, rows.row, case when len(rows.cells) = 5 then 'complete' when len(rows.cells) > 5 then 'cut' when l is not null then 'repaired' else 'padded' end as state, l as skipped,
  array_to_string(case when len(rows.cells) >= 5 then rows.cells[1:5] when l is not null then list_transform(range(1, 6), lambda j: case when j - l between 1 and len(rows.cells) then rows.cells[j - l] else above.cells[j] end) else list_concat(rows.cells, list_transform(range(0, 5 - len(rows.cells)), lambda x: '')) end, '|') as cells, b as source_row
from rows left join fits using (t, row) left join rows above on above.t = rows.t and above.row = b"""
)
def ragged_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with missing cells under the columns that they fit best, what is missing taken from the last complete row."""
    return alignment.aligned(_ragged(spark, sf), "t").withColumn("cells", F.array_join("cells", "|")).withColumns({c: F.col(c).cast("long") for c in ("row", "skipped", "source_row")})


@query("""
with recursive b as (
  select l_orderkey // 2 as page, row_number() over (partition by l_orderkey // 2 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as box,
    (l_partkey % 24) / 25 as x0, (l_partkey % 24) / 25 + (l_quantity % 6 + 1) / 60 as x1, (l_suppkey * 7 % 30) / 31 as y0, (l_suppkey * 7 % 30) / 31 + (l_partkey % 9 + 1) / 150 as y1 from lineitem),
r as (select page from b group by page having count(*) between 2 and 16 and bool_and(x0 >= 0 and x0 < x1 and x1 <= 1 and y0 >= 0 and y0 < y1 and y1 <= 1)),
a(page, box, x0, x1, y0, y1, path, ax0, ay0, ax1, ay1, n, stuck) as (
  select page, box, x0, x1, y0, y1, cast([] as integer[]), 0::double, 0::double, 1::double, 1::double, count(*) over (partition by page), false from b join r using (page)
  union all
  select page, box, x0, x1, y0, y1, case when axis is null then path else list_append(path, band) end,
    case when axis = 'x' then coalesce(low, ax0) else ax0 end, case when axis = 'y' then coalesce(low, ay0) else ay0 end, case when axis = 'x' then coalesce(high, ax1) else ax1 end, case when axis = 'y' then coalesce(high, ay1) else ay1 end,
    case when axis is null then 0 else count(*) over (partition by page, path, band) end, axis is null
  from (select *, (prior + min(f) over (partition by page, path, band)) / 2 as low, (max(t) over (partition by page, path, band) + later) / 2 as high
    from (select *, max(t) over (partition by page, path order by band range between unbounded preceding and 1 preceding) as prior, min(f) over (partition by page, path order by band range between 1 following and unbounded following) as later
      from (select *, case when axis = 'y' then yb else least(xb, 1) end::integer as band, case when axis = 'y' then y0 else x0 end as f, case when axis = 'y' then y1 else x1 end as t
        from (select *, case when max(yb) over (partition by page, path) > 0 then 'y' when max(xb) over (partition by page, path) > 0 then 'x' end as axis
          from (select *, sum(yg) over (partition by page, path order by y0, box) as yb, sum(xg) over (partition by page, path order by x0, box) as xb
            from (select *, coalesce((max(y1) over (partition by page, path order by y0, box rows between unbounded preceding and 1 preceding) <= y0)::int, 0) as yg, coalesce((max(x1) over (partition by page, path order by x0, box rows between unbounded preceding and 1 preceding) <= x0)::int, 0) as xg
              from a where n > 1)))))))
select page, row_number() over (partition by page order by path) as place, box, ax0 as area_x0, ay0 as area_y0, ax1 as area_x1, ay1 as area_y1 from a where n = 1 and page not in (select page from a where stuck)""")
def reading_areas(spark: SparkSession, sf: str) -> DataFrame:
    """The areas of a page's boxes in reading order: rows of boxes first, columns within a row, rows within a column, and so on."""
    line = table(spark, sf, "lineitem").withColumn("page", F.floor(F.col("l_orderkey") / 2))
    box = F.row_number().over(Window.partitionBy("page").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    x0, y0 = (F.col("l_partkey") % 24) / 25, (F.col("l_suppkey") * 7 % 30) / 31
    corners = {"x0": x0, "x1": x0 + (F.col("l_quantity") % 6 + 1) / 60, "y0": y0, "y1": y0 + (F.col("l_partkey") % 9 + 1) / 150}
    return areas.reading_areas(line.select("page", box.cast("long").alias("box"), *[c.alias(k) for k, c in corners.items()]), "page")


@query(
    _PROJECTED.rstrip()
    + """,
q as (select t, r, unnest(range(0, width)) as c from (select t, width, unnest(range(0, n_rows)) as r from shape)),
w as (select q.t, q.r, q.c, text from q left join (select t, r, c, any_value(text) as text from places group by t, r, c) p using (t, r, c)),
rws as (select t, r, list(coalesce(text, '') order by c) as cells from w group by t, r),
h as (select t, list_transform(cells, lambda x, i: case when x = '' then 'Col' || i else x end) as names from rws where r = 0),
u as (select t, list_transform(names, lambda x, i: case when list_position(names, x) = i then x else x || '_' || i end) as names from h),
m as (select t, r, '| ' || array_to_string(list_transform(cells, lambda x: replace(x, '|', chr(92) || '|')), ' | ') || ' |' as md, array_to_string(list_transform(cells, lambda x: case when regexp_matches(x, '[,"]') then '"' || replace(x, '"', '""') || '"' else x end), ',') as csv, array_to_string(cells, chr(9)) as tsv,
  '{' || array_to_string(list_transform(cells, lambda x, i: '"' || names[i] || '":"' || replace(x, '"', chr(92) || '"') || '"'), ',') || '}' as obj, len(cells) as n from rws join u using (t))
select t, string_agg(md || case when r = 0 then chr(10) || '|' || repeat(' --- |', n) else '' end, chr(10) order by r) as markdown, string_agg(csv, chr(10) order by r) as csv, string_agg(tsv, chr(10) order by r) as tsv, '[' || coalesce(string_agg(obj, ',' order by r) filter (where r > 0), '') || ']' as json from m group by t"""
)
def table_contract(spark: SparkSession, sf: str) -> DataFrame:
    """HTML tables of all shapes as markdown, comma- and tab-separated rows, and JSON records."""
    cells = projection.source_cells(_sheets(spark, sf), "t", "html")
    grid = projection.places(cells, "t").select("t", F.col("r").alias("row"), F.col("c").alias("col"), "text")
    return tables.rendered(grid, "t")


@query(r"""
with p as (select p_partkey as k, p_name as name, p_size as s, p_brand as b from part),
c as (select k, 'r1c0' as source, unnest([{'a': 'size ', 'f': '$x=' || s || '$'}, {'a': ' and ', 'f': '$$y_{' || k || '} (2.' || s % 7 || ')$$'}, {'a': ' or ', 'f': case when k % 3 = 0 then '$x=' || s || '$' else '' end}], recursive := false) as u, unnest([1, 2, 3]) as i from p
  union all select k, 'r1c1', {'a': name || ' ', 'f': '\(z \tag{' || s || '}\)'}, 1 from p where k % 2 = 0 union all select k, 'r1c1', {'a': name, 'f': ''}, 1 from p where k % 2 = 1),
o as (select k, source, u.f as latex, sum(length(u.a) + length(u.f)) over (partition by k, source order by i)::bigint as stop from c),
f as (select k, source, stop - length(latex) as start, stop, latex, case when latex like '$$%' then '2.' || (select s % 7 from p where p.k = o.k) when latex like '\(%' then (select s from p where p.k = o.k)::varchar end as label from o where latex <> ''),
n as (select k, unnest(['r1c0', 'r1c0', 'r1c1']) as source, unnest(['$x=' || s || '$', '$$y_{' || k || '} (2.' || s % 7 || ')$$', '\(z \tag{' || s || '}\)']) as latex from p),
g as (select k, source, latex, count(*) as n, min(k || ':' || source || ':' || start || ':' || stop) as ref, any_value(label) as label from f group by all)
select n.k as p_partkey, n.source, n.latex, case when g.n is null then 'none' when g.n > 1 then 'several' else 'found' end as verdict, case when g.n = 1 then ref end as source_ref, g.label from n left join (select k, source, latex, sum(n) as n, min(ref) as ref, any_value(label) as label from g group by all) g on g.k = n.k and g.source = n.source and g.latex = n.latex""")
def cell_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """Formulas that are named for a cell, bound to the one place in it where they are written; none and several are told apart."""
    k, s = F.col("p_partkey"), F.col("p_size")
    t = lambda c: c.cast("string")
    x, y, z = F.concat(F.lit("$x="), t(s), F.lit("$")), F.concat(F.lit("$$y_{"), t(k), F.lit("} (2."), t(s % 7), F.lit(")$$")), F.concat(F.lit("\\(z \\tag{"), t(s), F.lit("}\\)"))
    left = F.concat(F.lit("size "), x, F.lit(" and "), y, F.lit(" or "), F.when(k % 3 == 0, x).otherwise(""))
    right = F.when(k % 2 == 0, F.concat("p_name", F.lit(" "), z)).otherwise(F.col("p_name"))
    row = F.concat(F.lit("<tr><td>"), left, F.lit("</td><td>"), right, F.lit("</td></tr>"))
    parts = table(spark, sf, "part")
    html = projection.html_of(F.array(F.lit("<tr><th>a</th><th>b</th></tr>"), row), F.lit(None).cast("string"))
    found = projection.cell_formulas(projection.source_cells(parts.select("p_partkey", html.alias("html")), "p_partkey", "html"), "p_partkey")
    named = parts.select("p_partkey", F.inline(F.array(*[F.struct(F.lit(ref).alias("source"), latex.alias("latex")) for ref, latex in (("r1c0", x), ("r1c0", y), ("r1c1", z))])))
    return projection.bound(found, named, "p_partkey").select("p_partkey", "source", "latex", "verdict", "source_ref", "label")

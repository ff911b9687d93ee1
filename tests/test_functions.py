"""Boundary rows of expressions, folds, matching and sources."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.functions.intervals import interval_contains, parse_interval, scalar_kind
from lodestack.operators import graph, lookup
from lodestack.operators.chunking import pack_lines
from lodestack.sources import tables
from lodestack.streaming import folds, windows

CONTAINS = [("1<x<=5", 1, False), ("1<x<=5", 5, True), ("1<=x<5", 1, True), ("1<=x<5", 5, False), ("5>x", 4.9, True), ("x\\geq 3", 3, True), ("$2 \\leqslant x ＜ 4$", 2, True), ("＞5", 5, False), (">5", 5.5, True), ("\\mathrm{DN}<=40", 40, True), ("-2<t<-1", -1.5, True)]
NO_INTERVAL = ["a~b", "1~5", "5<x<1", "1<x>5", "5<=x<=5", "x", "", "x<y", None]


@pytest.mark.parametrize("text,value,want", CONTAINS)
def test_interval_contains(spark, text, value, want):
    df = spark.createDataFrame([(text, str(value))], "t string, v string")
    assert df.select(interval_contains(parse_interval(F.col("t")), F.col("v"))).first()[0] is want


def test_no_interval(spark):
    df = spark.createDataFrame([(t,) for t in NO_INTERVAL], "t string")
    assert [r[0] for r in df.select(parse_interval(F.col("t"))).collect()] == [None] * len(NO_INTERVAL)
    assert not df.limit(1).select(interval_contains(parse_interval(F.lit("x<5")), F.lit("many"))).first()[0]


def test_scalar_kind(spark):
    want = {"007": "text", "0.5": "number", "-3": "number", "12%": "percent", "１２％": "text", "1 1/2": "fraction", "1 1/0": "text", "": "blank", "x<5": "interval", "-05": "text", "abc": "text"}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.k for r in df.select("t", scalar_kind(F.col("t")).alias("k")).collect()} == want | {"１２％": "text"}


def test_languages(spark):
    rows = [("中中中aaaaaaa", "en", None), ("中中中中aaaaaaaaa", "zh", "zh"), ("", "en", None), ("abcd efgh ijk", "en", None), ("abcd efgh ijkl", "en", "en"), ("$abcd efgh ijkl$", "en", None)]
    df = spark.createDataFrame(rows, "t string, a string, b string")
    for r in df.select("*", T.language_by_share(F.col("t")).alias("x"), T.language_by_evidence(F.col("t")).alias("y")).collect():
        assert (r.x, r.y) == (r.a, r.b), r


def test_names_and_masks(spark):
    one = spark.range(1)
    got = one.select(T.semantic_key(F.lit("The ACME Steel Co.")).alias("k"), T.jaccard(T.semantic_key(F.lit("東京")), T.semantic_key(F.lit("x"))).alias("j"), T.masked(F.lit("12345678")).alias("a"), T.masked(F.lit("123456789")).alias("b"), T.slug(F.lit("--Ä b!")).alias("s"), T.slug(F.lit("!")).alias("d"), T.is_secret_key(F.lit("monkey")).alias("m")).first()
    assert (got.k, got.j, got.a, got.b, got.s, got.d, got.m) == (["acme", "steel"], 0.0, "***", "1234***6789", "b", "default", True)


def test_chunks(spark):
    sizes = lambda n: [len(c) for c in spark.range(1).select(T.overlapping_chunks(F.repeat(F.lit("a"), n), 10, 2)).first()[0]]
    assert (sizes(10), sizes(11), sizes(16)) == ([10], [10, 3], [10, 8])
    assert pack_lines(["a", "b" * 9, "|x|", "|y|", "", "c" * 30], 10) == ["a", "b" * 9, "|x|\n|y|", "c" * 30]


def test_lines(spark):
    text = "12\n— 3 —\nsee https://x.y now\nGB/T 150.1—2024\nkeep []  this\n\n\n\nT\nend www"
    assert spark.range(1).select(T.clean_lines(F.lit(text))).first()[0] == "keep this\n\nend www"


def test_tiers_and_graph(spark):
    rows = spark.createDataFrame([(1, "Ann"), (2, "Anna"), (3, None)], "id int, name string")
    hits = lookup.tiered_match(spark.createDataFrame([(" ann",), ("nn",), ("",)], "q string"), rows, "q", [F.col("name")])
    assert sorted((r.q, r.id, r.tier) for r in hits.collect()) == [("", 3, 1), (" ann", 1, 1), ("nn", 1, 2), ("nn", 2, 2)]
    nodes = spark.createDataFrame([("a", "A", "X", ["alpha"]), ("b", "B", "Y", []), ("b", "B", "Y", [])], "key string, name string, kind string, aliases array<string>")
    edges = spark.createDataFrame([("e1", "a", "b", "R"), ("e2", "b", "a", "R"), ("e3", "a", "z", "R")], "edge string, source string, target string, relation string")
    bad = graph.violations(nodes, edges, spark.createDataFrame([("R", "X", "Y")], "relation string, source_kind string, target_kind string"))
    assert sorted(map(tuple, bad.collect())) == [("duplicate_node", "b"), ("kind_not_allowed", "e2"), ("missing_end", "e3")]
    assert {r.edge for r in graph.one_hop(nodes.distinct(), edges, "ALPHA").collect()} == {"e1", "e2"}


def test_sources(spark):
    pages = spark.createDataFrame([(1, 2), (2, 2), (2, 2)], "id int, total int")
    assert tables.complete(pages, "id", "total").count() == 2
    with pytest.raises(ValueError, match="incomplete"):
        tables.complete(pages.where("id = 1"), "id", "total")
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, at int")
    new = spark.createDataFrame([(2, "c", 3), (2, "d", 2), (3, None, 1)], "id int, v string, at int")
    assert sorted(map(tuple, tables.upsert(old, new, ["id"], ["at"]).collect()), key=str) == [(1, "a", 1), (2, "c", 3), (3, None, 1)]
    set_null = spark.createDataFrame([(1, {"v": None})], "id int, fields map<string,string>")
    assert sorted(map(tuple, tables.update(old, set_null, ["id"]).collect())) == [(1, None, 1), (2, "b", 1)]
    row = spark.range(1).select(tables.delimited(F.array(F.lit('a"b'), F.lit("c,d"), F.lit("e"))), tables.delimited(F.array(F.lit("c,d"), F.lit("e")), "\t"), tables.markdown_row(F.array(F.lit("a|b"), F.lit("c")))).first()
    assert list(row) == ['"a""b","c,d",e', "c,d\te", "| a\\|b | c |"]


def test_folds():
    at = lambda m: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)
    lease = pd.Timedelta(minutes=10)
    assert folds.lease_states([(at(0), "click"), (at(10), "click"), (at(20), "click")], lease) == ("EXHAUSTED", 1, 1)
    assert folds.lease_states([(at(0), "click"), (at(9), "view"), (at(18), "purchase")], lease) == ("COMPLETED", 1, 0)
    assert folds.lease_states([(at(0), "click"), (at(1), "error"), (at(2), "click")], lease) == ("RUNNING", 2, 0)
    assert folds.cache_counts([(at(0), 1), (at(1), 2), (at(2), 1), (at(3), 3), (at(4), 1)], pd.Timedelta(hours=1), 2) == (1, 4, 2)
    assert folds.cache_counts([(at(0), 1), (at(60), 1), (at(121), 1)], pd.Timedelta(hours=1), 2) == (1, 2, 0)


def test_stream_equals_batch(spark, tmp_path):
    path, out = "/root/testdata/sf0.001", str(tmp_path / "out")
    batch = spark.read.parquet(f"{path}/events.parquet")
    (tmp_path / "in").mkdir()
    batch.write.parquet(str(tmp_path / "in" / "a"))
    stream = windows.read_events(spark, str(tmp_path / "in" / "*"), batch.schema)
    q = windows.tumbling(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    want = {(r.start, r.event_type): r.n for r in windows.tumbling(batch).collect()}
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(out).collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_html_grids(spark):
    from lodestack.operators.tables import grid, html_cells, markdown_cells

    source = "<table><tr><th rowspan=2>a&amp;b</th><th colspan='2'>c</th></tr><tr><td>1<br>2</td><td> </td></tr></table><table><tr><td>other</td></tr></table>"
    assert [(r, c, sr, sc, s, t) for r, c, sr, sc, s, t in grid(source)] == [(0, 0, 0, 0, "recognized", "a&b"), (0, 1, 0, 1, "recognized", "c"), (0, 2, 0, 1, "spanned", "c"), (1, 0, 0, 0, "spanned", "a&b"), (1, 1, 1, 1, "recognized", "1\n2"), (1, 2, 1, 2, "blank", "")]
    assert grid(None) == [] and grid("<p>x</p>") == []
    assert [grid(s)[0][5] for s in ("<td>" + "x" * 200_001, "<tr><td colspan=101>", "<tr><td>" * 2001)] == ["too_long", "span", "too_many_cells"]
    assert grid("<tr><td>a<td rowspan=2>b<tr><td colspan=2>c")[0][4:] == ("rejected", "overlap")
    df = spark.createDataFrame([(1, source), (2, None)], "page_id long, html string")
    assert html_cells(df, "page_id", "html").groupBy("page_id").count().collect() == [(1, 6)]
    lines = spark.createDataFrame([("| a \\| b | c |",), ("|---|:-:|",), ("x",), ("a|b",)], "l string")
    assert [r[0] for r in lines.select(markdown_cells(F.col("l"))).collect()] == [["a | b", "c"], None, None, ["a", "b"]]


def test_boxes_and_numbers(spark):
    from lodestack.functions import numbers as N

    one = lambda c: spark.range(1).select(c).first()[0]
    box = lambda *v: N.normalised_box(*map(F.lit, v), F.lit(200.0), F.lit(100.0))
    assert tuple(one(box(20.0, 10.0, 100.0, 50.0))) == (0.1, 0.1, 0.5, 0.5)
    assert tuple(one(box(0.1, 0.1, 0.5, 0.5))) == (0.1, 0.1, 0.5, 0.5)
    assert one(box(50.0, 10.0, 20.0, 50.0)) is None and one(box(20.0, 10.0, 300.0, 50.0)) is None
    assert one(N.overlap_share(box(0.0, 0.0, 1.0, 1.0), box(0.5, 0.5, 1.0, 1.0))) == 0.25
    assert [one(N.parse_number(F.lit(t))) for t in ("≤ 3,5", "-2", "x", ">1.5")] == [3.5, -2.0, None, 1.5]
    assert [one(N.retry_delay(F.lit(n))) for n in (1, 3, 7, 9)] == [1, 4, 60, 60]
    assert (one(N.token_estimate(F.lit(""))), one(N.token_estimate(F.lit("a" * 9)))) == (1, 2)


def test_headers_and_schemas(spark):
    from lodestack.operators import versions as V

    one = lambda c: spark.range(1).select(c).first()[0]
    row = lambda *v: F.array(*map(F.lit, v))
    assert one(V.merged_header(row("Size", " ", "Note", ""), row("min", "max", "Note", ""))) == ["Size min", "Size max", "Note", "Note"]
    assert one(V.filled(row("", "a", "", "b"))) == ["a", "a", "a", "b"]
    fields = one(V.schema_fields(F.lit('{"properties": {"n": {"type": "integer"}, "t": {"title": "T"}}, "required": ["n"]}')))
    assert [tuple(f) for f in fields] == [("n", "integer", "n", True), ("t", "string", "T", False)]
    assert one(V.schema_fields(F.lit("{}"))) is None


def test_matched_uses_every_entry_of_a_key(spark):
    from lodestack.operators import versions

    payloads = spark.createDataFrame([(2, 1, "a"), (4, 1, "a"), (6, 1, "b"), (8, 2, "a")], "p long, k long, s string")
    entries = spark.createDataFrame([(1, 1, "a"), (3, 1, "a"), (5, 1, "a"), (7, 3, "a")], "e long, k long, s string")
    out = versions.matched(payloads, entries, "p", "e", [(["k", "s"], None), (["k"], None)])
    assert sorted(map(tuple, out.collect())) == [(2, 1, 1), (4, 3, 1), (6, 5, 2)]


def test_grounding_takes_short_items_and_repeats(spark, tmp_path):
    from lodestack.plans.documents import grounding_check

    docs = [(1, "a short one"), (2, "the benchmark passage, the benchmark passage"), (3, ""), (4, None)]
    items = [(1, "short"), (2, "the benchmark passage"), (3, "a"), (4, "nowhere at all"), (5, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = sorted((i, d, t.find(q), t.count(q) == 1) for d, t in docs if t for i, q in items if q and q in t)
    assert sorted(tuple(r) for r in grounding_check(spark, str(tmp_path)).collect()) == want

"""Quotations in documents: places of all kinds, and work that grows with a text's length, not with its square."""

import time

import duckdb

from lodestack import registry


def test_quotations_in_long_texts_and_at_the_edges_of_stretches(spark, tmp_path):
    words = "".join(f"word{i} " for i in range(60_000))  # the windows of so long a text took minutes when each was cut at its place
    near = ["x" * n + " the quotation stands here" + "y" * 5000 for n in range(4070, 4100)]
    texts = [words, "", None, "short", "a b", "日本語の文章です。" * 1000, "😀 smile at this text 😀", *near, "twice here. twice here."]
    items = ["word59998 word59999", "the quotation stands here", " the quotation", "short", "a", "語の文章です。日本語の文章", "twice here.", "text 😀", "never there at all", "yyyyyyyyyyyyyyy", "y" * 4990]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*enumerate(items), (99, "short")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    began = time.time()
    got = sorted(map(tuple, registry.QUERIES["grounding_check"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(registry.ORACLES["grounding_check"]).fetchall()) and len(got) > 60
    assert time.time() - began < 60

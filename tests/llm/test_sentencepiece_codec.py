import random

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lodestack.llm import sentencepiece_codec as codec
from lodestack.llm.entries import PIECE_MODEL, op10_sentencepiece

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def test_whole_table_equals_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op10_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip


ALPHABET = ["a", "e", "t", "h", "in", "the", " ", "  ", "    ", "\n", "é", "☃", "\x00", "\t", "1", "00", codec.SPACE, "日本", "привет", "==", "--", "\U0001f600", "�"]


def test_random_texts_equal_library(library):
    made = random.Random(3)
    texts = ["".join(made.choices(ALPHABET, k=made.randint(0, 40))) for _ in range(5000)] + [" " * n for n in range(40)] + ["the " * 20_000, "a" * 30_000, "\n" * 999]
    assert codec.Encoder(codec.load(PIECE_MODEL)).encode(pa.array(texts)).to_pylist() == library.encode(texts)


def test_slices_do_not_matter(library, monkeypatch):
    monkeypatch.setattr(codec, "SLICE_BYTES", 7)
    monkeypatch.setattr(codec, "INDEX_BYTES", 5)
    texts = ["hello there", "", "a  b", None, "unbelievable\nthings"]
    assert codec.Encoder(codec.load(PIECE_MODEL)).encode(pa.array(texts)).to_pylist() == [library.encode(t or "") for t in texts]


def test_edges_and_decoding(spark, library):
    v = codec.load(PIECE_MODEL)
    texts = ["x", None, "", "é☃\x00\U0001f600", " lead", "x"]
    df = spark.createDataFrame([(t, [0]) for t in texts], "text string, pieces array<int>").withColumn("ids", codec.encode(spark, F.col("text"), v)).withColumn("back", codec.decode(spark, F.col("ids"), v))
    for r in df.collect():
        assert r.ids == library.encode(r.text or "") and r.back == (r.text or "")
    ids = spark.createDataFrame([(None,), ([],), ([None, -1, 99_999, 0, 1, 2],), ([library.piece_to_id("<0xC3>")],), (library.encode("ok"),)], "ids array<int>")
    assert [r[0] for r in ids.select(codec.decode(spark, F.col("ids"), v)).collect()] == [None, "", "", "�", "ok"]
    assert df.limit(0).count() == 0


def test_encoded_and_checked_in_one(spark):
    from pyspark.sql import functions as F

    from lodestack.llm import sentencepiece_codec as codec
    from lodestack.llm.entries import PIECE_MODEL

    v = codec.load(PIECE_MODEL)
    df = spark.createDataFrame([(None,), ("",), ("Hello  world",), ("a▁b",), ("中文 x\n",)], "t string")
    for r in df.select("t", codec.encode(spark, F.col("t"), v).alias("ids"), codec.encode_checked(spark, F.col("t"), v).alias("c")).collect():
        assert r.c.ids == r.ids and r.c.round_trip is True

import random

import pytest
from pyspark.sql import functions as F

from lodestack.llm import language_id
from lodestack.llm.entries import op7_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = op7_language_id(spark, SF).join(docs, "doc_id").cache()
    assert out.count() == docs.count()
    held = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert held[0] >= 0.98 and 0 <= held[1] <= held[2] <= 1
    assert out.where("rejected").count() <= 0.005 * docs.count()


TRAIN = [(t, lang) for lang, t in [("en", "the nation of the standing here and there with those others"), ("de", "der zug und die straße über für nicht schön geworden")] for _ in range(5)]


def test_edges(spark):
    model = language_id.fit(spark.createDataFrame([*TRAIN, (None, "en"), ("text", None)], "text string, lang string"))
    texts = {None: "und", "": "und", "12 !? \n": "und", "the": "en", "Über": "de", "THE NATION": "en", "x" * 200_000: None, "語": None, "straße " * 9000: "de"}
    rows = spark.createDataFrame([(t, "zz", 1.0) for t in texts], "text string, lang string, score double").select("text", model.predict(F.col("text")).alias("p")).collect()
    for r in rows:
        want = texts[r.text]
        assert r.p.lang == want if want else r.p.lang in ("de", "en")
        assert 0 <= r.p.score <= 1
        if r.p.lang == "und" or r.text == "語":
            assert r.p.rejected


@pytest.mark.parametrize("train", [[], [(None, "en")]])
def test_nothing_to_learn_from(spark, train):
    model = language_id.fit(spark.createDataFrame(train, "text string, lang string"))
    p = spark.createDataFrame([("abc",)], "text string").select(model.predict(F.col("text")).alias("p")).first().p
    assert (p.lang, p.score, p.rejected) == ("und", 0.0, True)


def test_empty_table(spark):
    model = language_id.fit(spark.createDataFrame(TRAIN, "text string, lang string"))
    assert spark.createDataFrame([], "text string").select(model.predict(F.col("text"))).count() == 0


def test_languages_of_copies_are_learned(spark):
    words = "abend berg cielo dorp etang fjord grad huis isola jour kirche lago".split()
    rows = [(f"{w} {w[::-1]} {w}s", w) for w in words]
    copies = spark.createDataFrame(rows, "text string, lang string").crossJoin(spark.range(600)).drop("id")
    model = language_id.fit(copies)
    assert sorted(set(model.langs)) == sorted(words)
    said = spark.createDataFrame(rows, "text string, lang string").select("lang", model.predict(F.col("text")).alias("p")).collect()
    assert all(r.p.lang == r.lang and not r.p.rejected for r in said)


def test_foreign_and_junk_texts_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    made = random.Random(3)
    junk = {
        "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
        "zh": "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
        "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
        "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
        "hex": " ".join(f"{made.getrandbits(32):08x}" for _ in range(400)),
        "letters": " ".join("".join(made.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(300)),
    }
    rejected = lambda df: df.select("kind", model.predict(F.col("text")).alias("p")).groupBy("kind").agg(F.avg(F.col("p.rejected").cast("int"))).collect()
    bad = dict(rejected(spark.createDataFrame(list(junk.items()), "kind string, text string")))
    assert bad == dict.fromkeys(junk, 1.0)
    clean = docs.where("length(text) > 0").crossJoin(spark.createDataFrame([(5,), (12,), (100_000,)], "kind int")).select("kind", F.array_join(F.slice(F.split("text", " +"), 1, F.col("kind")), " ").alias("text"))
    good = dict(rejected(clean))
    assert good[100_000] <= 0.005 and good[12] <= 0.02 and good[5] <= 0.02


def by_hand(model, text):
    """Language, score and rejection of a text, trigram by trigram, against each centroid in turn."""
    import math
    import re

    if not re.search(r"[^\W\d_]", text or ""):
        return language_id.UNDETERMINED, 0.0, True
    low = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
    padded, counts = b" " + low + b" ", {}
    for i in range(len(padded) - 2):
        a, b, c = padded[i : i + 3]
        if (a, b) != (32, 32):
            k = ((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 20
            counts[k] = counts.get(k, 0) + 1
    weights = {k: math.log1p(n) * float(model.idf[k]) for k, n in counts.items()}
    norm = math.sqrt(sum(w * w for w in weights.values())) or 1
    cosines = [sum(w * float(c[k]) for k, w in weights.items()) / norm for c in model.centroids]
    best = max(range(len(cosines)), key=lambda j: cosines[j])  # the first of equals
    score = min(1.0, max(0.0, cosines[best]))
    return model.langs[best], score, score < model.floors[best] * math.sqrt(min(1, len(counts) / language_id.FULL_TRIGRAMS))


def test_predictions_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    texts = [r.text for r in docs.collect()] + [None, "", "12 3", "x", "日本語", "A b", "\x00é", "zzzz qqqq", "the " * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in rows.select("i", "t", model.predict(F.col("t")).alias("p")).collect():
        lang, score, rejected = by_hand(model, r.t)
        assert (r.p.lang, r.p.rejected) == (lang, rejected), r.t
        assert abs(r.p.score - score) < 1e-4


def test_equal_centroids_give_the_first_language_and_copies_the_same_answer(spark):
    docs = spark.createDataFrame([("same words here", x) for x in ("bb", "aa", "cc", "aa")], "text string, lang string")
    model = language_id.fit(docs)
    rows = spark.createDataFrame([("same words here",)] * 5, "t string").select(model.predict(F.col("t")).alias("p")).collect()
    assert {r.p.lang for r in rows} == {"aa"} and len({r.p.score for r in rows}) == 1

import random
import re

import pytest

from lodestack.llm import decontaminate
from lodestack.llm.common import content_key


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    doc, covered, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        size = min(window, len(w))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(doc) - size + 1 if w else 0):
            if tuple(doc[i : i + size]) in grams:
                covered |= set(range(i, i + size))
                names.add("null" if name is None else str(name))
    return len(doc), len(covered), sorted(names)


def compare(spark, docs, items):
    df = spark.createDataFrame([(i, t, "h", 2) for i, t in docs], "doc_id long, text string, hash string, at int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, item int")
    found = decontaminate.find(df, bench).collect()
    assert sorted((r.doc_id for r in found), key=str) == sorted((i for i, _ in docs), key=str)  # a row each
    out = {(r.doc_id, r.text_hash): (r.n_words, r.n_hit, list(r["items"])) for r in found}
    keys = {(r[0], r[1]): r[2] for r in df.select(*content_key(), "text").collect()}
    assert set(out) == set(keys)
    for k, text in keys.items():
        assert out[k] == brute(text, items), (k, (text or "")[:80])


def test_random_texts(spark):
    made = random.Random(2)
    bag = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(made.choices(bag, k=made.choice([3, 8, 9, 10, 11, 14, 30])))) for i in range(40)]
    docs = []
    for i in range(80):
        w = made.choices(bag, k=made.randint(0, 60))
        for _ in range(2):
            piece = words(made.choice(items)[1])
            cut = made.randint(0, len(piece))
            at = made.randint(0, len(w))
            w[at:at] = made.choice([piece, piece[:cut], piece[cut:]])
        docs.append((i, made.choice([" ", ", ", "\n"]).join(w)))
    compare(spark, docs, items)


TEN = "one two three four five six seven eight nine ten"
EDGES = [(1, None), (2, ""), (3, "--- !"), (4, TEN.upper()), (5, TEN.replace(" ", "-")), (5, TEN.replace(" ", "-")), (5, "other"), (None, f"x {TEN} x"), (6, "one two three"), (7, TEN[:-4]), (8, "a " * 40_000 + TEN), (9, "Élan élan"), (10, "same " * 30)]
ITEMS = [(1, TEN), (2, TEN), (3, None), (4, ""), (5, "two three"), (6, "same " * 12), (None, f"{TEN} eleven"), (7, "élan"), (1, TEN)]


@pytest.mark.parametrize("items", [ITEMS, [], ITEMS[:1]])
def test_edges(spark, items):
    compare(spark, EDGES, items)


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", 0)
    compare(spark, EDGES, ITEMS)


def test_no_documents(spark):
    compare(spark, [], ITEMS)

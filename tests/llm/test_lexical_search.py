import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lodestack.llm import lexical_search as ls
from lodestack.llm.entries import ORACLES, op13_lexical_search

SF = "/root/testdata/sf0.001"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, words, df = len(counts), sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, some in asked.items():
        scored = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in some if t in c)
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def check(spark, docs, items, k):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, score string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    out = ls.search(d, q, k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(docs, items, k)


def test_whole_table_equals_brute_force_and_sql(spark):
    got = sorted((tuple(r) for r in op13_lexical_search(spark, SF).collect()), key=str)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert got == brute(docs, items, 50)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert got == sorted(con.sql(ORACLES["op13_lexical_search"]).fetchall(), key=str)


def made_docs(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    return [(i, " ".join(r.choices(words, [1 / (j + 1) for j in range(300)], k=r.choice([1, 5, 40, 200])))) for i in range(n)], r, words


@pytest.mark.parametrize(("block", "beam", "asked"), [(4096, 256, 500_000), (64, 4, 500_000), (100, 1, 40)])
def test_blocks_beams_and_parts_of_items(spark, monkeypatch, block, beam, asked):
    for name, v in (("BLOCK", block), ("BEAM", beam), ("QUERY_TERMS", asked)):
        monkeypatch.setattr(ls, name, v)
    docs, r, words = made_docs(600, 3)
    docs += [(1000 + i, docs[7][1]) for i in range(90)]  # many ties
    items = [(i, " ".join(r.choices(words, k=r.choice([1, 3, 30])))) for i in range(25)]
    check(spark, docs, items, 20)


EDGES = [(1, None), (2, ""), (3, " .,- "), (4, "One two"), (4, "One two"), (None, "one TWO"), (None, "one two"), (5, "two " * 50_000), (6, "é É one"), (7, "3,5"), (8, "one\x00two")]


def test_edges(spark):
    check(spark, EDGES, [(1, "one"), (1, "two é"), (2, None), (3, ""), (None, "É 3"), (4, "absent"), (5, "one " * 30_000), (6, "two"), (6, "two")], 3)


@pytest.mark.parametrize(("docs", "items"), [([], []), ([], [(1, "a")]), ([(1, "a b")], []), ([(1, "a b")], [(1, "b")]), ([(1, "a"), (2, "a")], [(1, "a")])])
def test_tiny_tables(spark, docs, items):
    check(spark, docs, items, 5)


def test_treap_holds_the_maximum_of_every_square():
    r = np.random.default_rng(4)
    cells = {(int(a), int(b)): int(v) for a, b, v in zip(r.integers(0, 50, 400), r.integers(0, 90, 400), r.integers(1, 10**9, 400), strict=True)}
    treap = ls.Treap(np.array([c[0] for c in cells]), np.array([c[1] for c in cells]), np.array(list(cells.values())), 90)

    def walk(level, node, row, col, best):
        side = 1 << (treap.height - level)
        inside = [v for (a, b), v in cells.items() if row <= a < row + side and col <= b < col + side]
        assert best == max(inside)
        if side == 1:
            return
        for quarter in range(4):
            there, child = treap.down(level, np.array([node]), np.array([quarter]))
            a, b = row + side // 2 * (quarter >> 1), col + side // 2 * (quarter & 1)
            held = any(a <= x < a + side // 2 and b <= y < b + side // 2 for x, y in cells)
            assert there[0] == held
            if held:
                walk(level + 1, int(child[0]), a, b, best - int(treap.lacks[level][child[0]]))

    walk(0, 0, 0, 0, treap.best)


def test_bounds_close_ranges():
    """Of many documents of which few hold the rare term, far from all are scored in full."""
    n, rare = 4096, 30
    r = np.random.default_rng(5)
    cols = np.concatenate([np.arange(n), r.choice(n, rare, replace=False)])
    rows = np.concatenate([np.zeros(n, np.int64), np.ones(rare, np.int64)])
    values = np.concatenate([r.integers(1, 100, n), np.full(rare, 10_000)])
    treap = ls.Treap(rows, cols, values, n)
    start = ls.Ranges(np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([2 * treap.best]), np.array([2]), np.array([0, 1]), np.zeros(2, np.int64), np.full(2, treap.best))
    best = ls.Best(1, 10)
    assert ls.descend(treap, start, best, np.arange(n), np.ones(n, bool)) < n // 4
    total = np.zeros(n, np.int64)
    np.add.at(total, cols, values)
    assert best.doc.tolist() == sorted(range(n), key=lambda d: (-total[d], d))[:10]

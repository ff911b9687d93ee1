import random
import re

import pytest

from lodestack.llm import near_dedup
from lodestack.llm.entries import op8_minhash_near_dedup

SF = "/root/testdata/sf0.001"


def brute(rows, shingle=2):
    """{(id, text): (set size, smallest id reachable)} by comparing all pairs."""
    sets = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w)} if 0 < len(w) < shingle else {tuple(w[j : j + shingle]) for j in range(len(w) - shingle + 1)})
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both) and rows[x][0] is not None and rows[y][0] is not None:
                    up[root(x)] = root(y)
    lowest = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            lowest[root(x)] = min(i, lowest.get(root(x), i))
    return [(len(s), lowest.get(root(x))) for x, s in enumerate(sets)]


def compare(out, rows):
    want = sorted(((i, n, c, c is None or i == c) for (i, _), (n, c) in zip(rows, brute(rows), strict=True)), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out), key=str) == want


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    compare(op8_minhash_near_dedup(spark, SF).collect(), rows)


def test_groups_of_near_copies(spark):
    """More near-copies than a short list has, a chain of drifting texts, and clean texts between them."""
    made = random.Random(7)
    words = [f"w{i}" for i in range(4000)]
    base = made.choices(words, k=60)
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(made.randint(0, 6)):
            w[made.randrange(60)] = made.choice(words)
        rows.append((1000 - i, " ".join(w)))
    drift = made.choices(words, k=50)
    for i in range(30):
        drift = list(drift)
        drift[made.randrange(50)] = made.choice(words)
        rows.append((2000 + i, "  ".join(drift).upper()))
    rows += [(3000 + i, " ".join(made.choices(words, k=40))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(near_dedup.near_duplicates(docs, shingle=2).collect(), rows)


EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b"), (7, "A\x0bB"), (7, "A\x0bB"), (None, "a b"), (8, "x " * 30_000), (9, "x x"), (10, "é É"), (11, "é É"), (0, "x\x00 y")]


def test_edges(spark):
    docs = spark.createDataFrame([(i, t, "n", 3) for i, t in EDGES], "doc_id long, text string, id string, n int")
    compare(near_dedup.near_duplicates(docs, shingle=2).collect(), EDGES)


@pytest.mark.parametrize("rows", [[], [(5, "just one text")]])
def test_tiny_tables(spark, rows):
    compare(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect(), rows)

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import ann
from lodestack.llm.entries import op6_ann

SF = "/root/testdata/sf0.1"


def brute(rows, is_query, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for i in np.flatnonzero([is_query(n) for n in ids]):
        s = (x @ x[i]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[i]))
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(ids[j], s[j]) for j in order]
    return out


def test_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows, lambda n: n % 50 == 0, 5)
    got = {}
    for r in op6_ann(spark, SF).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    of = dict(rows)
    for q, found in got.items():
        assert [s for _, s in (found[i] for i in range(1, 6))] == sorted((s for _, s in found.values()), reverse=True)
        for v, s in found.values():
            a, b = np.array(of[q], float), np.array(of[v], float)
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
    hits = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_probing_finds_the_whole_radius():
    made = np.random.default_rng(5)
    codes = made.integers(0, 1 << 8, (3000, 8)).astype(np.uint8)
    codes[:50] = codes[50] ^ (1 << made.integers(0, 8, (50, 8))).astype(np.uint8)
    index = ann.MultiIndex(codes)
    for radius in (0, 8, 15, 22, 50):
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[50]).sum(1) <= radius)
        assert list(index.within(codes[50], radius, ann._flips(radius // 8))) == list(want)


ROWS = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (9, [4.0, 0.0]), (9, [4.0, 0.0]), (None, [1.0, 1.0])]


def test_edges(spark):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in ROWS], "vec_id long, embedding array<float>, id string, code int")
    out = [tuple(r) for r in ann.search(df, F.col("id").isin(0, 4), k=5).collect()]
    assert [(q, n, v) for q, n, v, _ in sorted(out)] == [(0, 1, 1), (0, 2, 9), (0, 3, 2)]
    assert ann.search(df.limit(0), F.col("id") >= 0).count() == 0
    assert ann.search(df.where("vec_id = 0"), F.col("id") >= 0).count() == 0

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestack.llm import lm_score
from lodestack.llm.entries import op3_lm_score

SF = "/root/testdata/sf0.001"
K = lm_score.CUTOFF
BOS, EOS = ("begin",), ("end",)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


class Katz:
    """The model, one token at a time."""

    def __init__(self, texts):
        self.uni, self.bi, self.context = Counter(), Counter(), Counter()
        for t in texts:
            w = [*words(t), EOS]
            self.uni.update(w)
            self.bi.update(zip([BOS, *w[:-1]], w, strict=True))
            self.context.update([BOS, *w[:-1]])
        self.n = sum(self.uni.values())
        levels = lambda c: [sum(v == r for v in c.values()) for r in range(1, K + 2)]
        self.du, self.db = lm_score.discounts(levels(self.uni)), lm_score.discounts(levels(self.bi))
        self.total = self.n + (not any(v <= K for v in self.uni.values()))
        self.unknown = 1 - sum(self.disc(c, self.du) for c in self.uni.values()) / self.total
        self.after = defaultdict(list)
        for (u, v), c in self.bi.items():
            self.after[u].append((v, c))
        self.alpha, self.full = {}, {}
        for u, seen in self.after.items():
            self.full[u] = self.context[u] + (not any(c <= K for _, c in seen))
            self.alpha[u] = (1 - sum(self.disc(c, self.db) for _, c in seen) / self.full[u]) / (1 - sum(self.p1(v) for v, _ in seen))

    @staticmethod
    def disc(c, d):
        return c * (d[c - 1] if c <= K else 1)

    def p1(self, v):
        return self.disc(self.uni[v], self.du) / self.total if v in self.uni else self.unknown

    def p(self, u, v):
        if (u, v) in self.bi:
            return self.disc(self.bi[u, v], self.db) / self.full[u]
        return self.alpha.get(u, 1) * self.p1(v)


def compare(rows, texts, held):
    m = Katz([t for i, t in texts.items() if not held[i]])
    for r in rows:
        w = [*words(texts[r.doc_id]), EOS]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in m.uni for x in w), m.n, held[r.doc_id])
        assert r.base_score == pytest.approx(sum(math.log10((m.uni[x] + 1) / (m.n + len(m.uni) + 1)) for x in w), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(m.p(u, v)) for u, v in zip([BOS, *w[:-1]], w, strict=True)), rel=1e-9)
    return m


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op3_lm_score(spark, SF).collect()
    assert len(rows) == len(texts)
    m = compare(rows, texts, {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts})
    for u in [BOS, *random.Random(3).sample(sorted(x for x in m.after if isinstance(x, str)), 20)]:
        assert sum(m.p(u, v) for v in m.uni) + m.alpha[u] * m.unknown == pytest.approx(1, abs=1e-9)


def test_edges_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BUCKET_CHARS", 40)
    monkeypatch.setattr(lm_score, "CHUNK_TEXTS", 3)
    texts = dict(enumerate([None, "", "  \n", "a b A B", "b a\x00 é É", "the the the " * 40, "a new word", "x", "x" * 70_000, "a b a b a b"]))
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in texts.items()], "doc_id long, text string, key long, score string")
    compare(lm_score.score(docs, F.col("doc_id") % 4 == 2).collect(), texts, {i: i % 4 == 2 for i in texts})


@pytest.mark.parametrize("shares", [0.2, 1e9])
def test_hot_contexts_are_spread(spark, monkeypatch, shares):
    monkeypatch.setattr(lm_score, "BUCKET_CHARS", 400)
    monkeypatch.setattr(lm_score, "HOT_SHARES", shares)
    made = random.Random(9)
    texts = {i: " ".join(made.choice(["the", "The", f"w{made.randrange(60)}"]) for _ in range(made.randint(0, 50))) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    compare(lm_score.score(docs, F.col("doc_id") % 4 == 2).collect(), texts, {i: i % 4 == 2 for i in texts})


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in lm_score.score(docs, F.lit(True)).collect()}
    assert (rows[1].n_tokens, rows[1].n_known, rows[1].base_score, rows[1].score) == (3, 0, 0.0, 0.0)
    assert rows[None].n_tokens == 1
    assert lm_score.score(docs.limit(0), F.lit(False)).count() == 0

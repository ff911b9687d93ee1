"""Operator 3: log probabilities of whole texts under a Katz back-off bigram model of the corpus itself.

P(v | u) = d(c) c(uv) / D(u) for a pair seen in training, else alpha(u) P(v); P(v) = d(c) c(v) / N for a known word, else
the mass that is left. Discounts d are Good-Turing's for counts up to CUTOFF, alpha is what makes P(. | u) sum to one.

All counts are exact and over all documents. A token would be too small a row to shuffle, so a batch of documents ships one
packed row per bucket of context words: its distinct (context, word, document) with their numbers, sorted, as compressed
arrays. A bucket holds every pair of its contexts, so it counts them, scores all seen pairs and keeps the unseen ones; the
unigram counts of its words, which the back-off needs, it asks of the buckets that own those words. A context word that
would overfill a bucket is spread over all of them by its second word, and its count and weight enter at the end. The tables (counts,
pairs, weights) are written to the shared folder, partitioned by bucket. Sums come back per batch of documents.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import SPACE_WORDS, Tokens, bound_batches, materialize, release, word_hashes

CUTOFF = 5
#: Characters of text per bucket of contexts, as planned; a bucket's arrays are in one task's memory.
BUCKET_CHARS = 6_000_000
CHUNK_TEXTS, CHUNK_CHARS = 8192, 4_000_000
BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0x1123456789ABCDEF)
#: A context word with this many times a bucket's fair share of tokens is spread over all buckets.
HOT_SHARES = 4
#: Documents that hot words are looked for in, at most (as expected). They decide where rows go, not what comes out.
HOT_SAMPLE = 2000
_ROW = "kind string, key long, home long, blob binary, stats array<long>, x double, y double"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.float64(), pa.float64()]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes; ascending 64-bit keys as differences."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        delta = a.dtype == np.uint64
        if delta:
            a = np.diff(a, prepend=np.uint64(0))
        elif a.dtype.kind in "iu" and len(a):
            a = a.astype(np.min_scalar_type(int(a.max()))) if a.min() >= 0 else a
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
        out.append((a.dtype.str, len(a), delta, pa.compress(planes, codec="zstd", asbytes=True)))
    return pickle.dumps(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, delta, data in pickle.loads(blob):
        size = np.dtype(kind).itemsize
        a = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n).T.copy().view(kind).ravel() if n else np.zeros(0, kind)
        out.append(np.cumsum(a, dtype=np.uint64) if delta else a)
    return out


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _among(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The index of each hash in the sorted ``hot``, or -1."""
    if not len(hot):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
    return np.where(hot[at] == h, at, -1)


def _packed(ids: pa.Array, held: np.ndarray, texts: pa.Array, batch: int, buckets: int, hot: np.ndarray) -> Iterator[tuple]:
    """Rows of one batch: 'head' with its documents, and 'pairs' for each bucket."""
    t = Tokens(texts, SPACE_WORDS)
    n = len(t.offsets) - 1
    h = np.concatenate([word_hashes(t.vocabulary), [BEGIN, END]]).astype(np.uint64)
    begin, end = len(h) - 2, len(h) - 1
    words = np.diff(t.offsets)
    doc = t.text_of()
    at = np.arange(len(t.codes)) + doc
    u, v = np.full(len(at) + n, begin, np.int64), np.full(len(at) + n, end, np.int64)
    v[at], u[at + 1] = t.codes, t.codes
    owner = np.repeat(np.arange(n), words + 1)
    yield "head", -1 - batch, batch, pickle.dumps((ids.to_pylist(), held, words + 1)), None
    place = np.empty(len(h), np.int64)
    order = np.lexsort((h, _bucket(h, buckets)))
    place[order] = np.arange(len(h))
    spread = _among(h, hot)[order] >= 0
    by_hash = np.argsort(h)
    rank = np.empty(len(h), np.int64)
    rank[by_hash] = np.arange(len(h))
    bits_d, bits_v = max(1, int(n).bit_length()), len(h).bit_length()
    keys, count = np.unique(place[u] << (bits_v + bits_d) | rank[v] << bits_d | owner, return_counts=True)
    d, keys = keys & ((1 << bits_d) - 1), keys >> bits_d
    v, u = keys & ((1 << bits_v) - 1), keys >> bits_v
    sorted_h, ordered = h[by_hash], h[order]
    of = _bucket(ordered, buckets)[u]
    if spread.any():  # pairs of a hot context go where their second word belongs
        of = np.where(spread[u], _bucket(sorted_h, buckets)[v], of)
        by = np.argsort(of, kind="stable")
        of, u, v, d, count = of[by], u[by], v[by], d[by], count[by]
    cuts = np.flatnonzero(np.diff(of)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(of)], strict=True) if len(of) else ():
        mine, runs = np.unique(u[a:b], return_counts=True)
        theirs, which = np.unique(v[a:b], return_inverse=True)
        yield "pairs", int(of[a]), batch, pack(ordered[mine], runs, sorted_h[theirs], which, d[a:b], count[a:b], held.astype(np.uint8)), None


def _group_sum(index: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, weight, minlength=n)


#: Sums travel as whole multiples of this, which compress and add up exactly.
UNIT = 2.0**-32


def _by_document(batch: np.ndarray, d: np.ndarray, logs: Iterable[np.ndarray], numbers: Iterable[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """Per batch its documents (as steps), and their sums of non-negative logarithms and of numbers, packed.

    The arrays to be summed are taken one at a time, so that a generator's are never all in memory.
    """
    keys, at = np.unique(batch.astype(np.int64) << 32 | d, return_inverse=True)
    sums = [np.rint(_group_sum(at, x, len(keys)) / UNIT).astype(np.int64) for x in logs] + [_group_sum(at, x, len(keys)).astype(np.int64) for x in numbers]
    of, doc = keys >> 32, keys & 0xFFFFFFFF
    cuts = np.flatnonzero(np.diff(of)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(of)], strict=True) if len(of) else ():
        yield int(of[a]), pack(np.diff(doc[a:b], prepend=0), *(x[a:b] for x in sums))


def _hot_tokens(h: np.ndarray, batch: np.ndarray, d: np.ndarray, count: np.ndarray, seen: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Per batch the (document, hot context) pairs with their numbers of tokens and of seen ones."""
    at = np.flatnonzero(h >= 0)
    if len(at):
        order = at[np.lexsort((h[at], d[at], batch[at]))]
        of = batch[order]
        cuts = np.flatnonzero(np.diff(of)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(of)], strict=True):
            x = order[a:b]
            yield int(of[a]), pack(np.diff(d[x], prepend=0), h[x], count[x], np.where(seen[x], count[x], 0))


def _add(total: np.ndarray, steps: np.ndarray, sums: np.ndarray, sign: int) -> None:
    total[np.cumsum(steps.astype(np.int64))] += sign * sums.astype(np.float64)


def _counted(bucket: int, rows: pd.DataFrame, buckets: int, hot: np.ndarray) -> Iterator[tuple]:
    """What a bucket makes of its pairs; see the module's text."""
    batches, parts = [], []
    for batch, blob in zip(rows["home"], rows["blob"], strict=True):
        mine, runs, theirs, which, d, count, held = unpack(blob)
        parts.append((np.repeat(mine, runs), theirs[which], np.full(len(d), len(batches), np.int32), d.astype(np.int32), count.astype(np.int32), held.astype(bool)[d]))
        batches.append(batch)
    u, v, batch, d, count, held = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts, mine, runs, theirs, which
    us, u = np.unique(u, return_inverse=True)
    vs, v = np.unique(v, return_inverse=True)
    key = u << 32 | v
    order = np.argsort(key, kind="stable").astype(np.int32)
    key, u, v, batch, d, count, held = (x[order] for x in (key, u.astype(np.int32), v.astype(np.int32), batch, d, count, held))
    first = np.flatnonzero(np.diff(key, prepend=-1))
    kind = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(key))))
    del key, order
    c = np.add.reduceat(np.where(held, 0, count), first)
    tu, tv = u[first], v[first]
    cu = _group_sum(tu, c, len(us)).astype(np.int64)
    low = np.zeros(len(us), bool)
    low[tu[(c > 0) & (c <= CUTOFF)]] = True
    full = cu + (~low & (cu > 0))  # contexts without a discounted pair leave one count for unseen words
    level, word = c[kind], us != BEGIN
    is_hot = _among(us, hot)
    own = is_hot < 0  # what a hot context's count decides is left to the end

    def logs() -> Iterator[np.ndarray]:
        yield np.where((level > 0) & own[u], count * (np.log10(np.maximum(full, 1))[u] - np.log10(np.maximum(level, 1))), 0)
        yield count * np.where(word & own, np.log10(cu + 1), 0)[u]
        yield np.where((level > 0) & ~own[u], count * np.log10(np.maximum(level, 1)), 0)

    def numbers() -> Iterator[np.ndarray]:
        yield count * (word & own & (cu > 0))[u]
        for r in range(1, CUTOFF + 1):
            yield np.where(level == r, count, 0)

    for j, blob in _by_document(batch, d, logs(), numbers()):
        yield "sums", -1 - batches[j], batches[j], blob, None
    for j, blob in _hot_tokens(is_hot[u], batch, d, count, level > 0):
        yield "hot", -1 - batches[j], batches[j], blob, None
    for i in np.flatnonzero(~own):
        yield "share", int(is_hot[i]), bucket, None, [int(cu[i]), int(low[i])]
    real = (cu > 0) & word & own
    yield "words", bucket, bucket, pack(us[real], cu[real]), None
    t = c > 0
    un = np.flatnonzero(level == 0)
    yield "state", bucket, bucket, pack(us, cu, full, np.bincount(tu[t], minlength=len(us)), tv[t], c[t], vs, u[un], v[un], batch[un], d[un], count[un], np.array(batches, np.int64)), None
    home = _bucket(vs, buckets)
    for b in np.unique(home):
        yield "ask", int(b), bucket, pack(vs[home == b]), None
    levels = lambda x: [int((x == r).sum()) for r in range(1, CUTOFF + 2)]
    yield "stats", bucket, bucket, None, [*levels(c), *levels(cu[real]), int(cu[real].sum()), int(real.sum()), int(cu[~word & own].sum())]


def _answered(rows: pd.DataFrame) -> Iterator[tuple]:
    """Counts of the words that were asked for."""
    words = rows[rows["kind"] == "words"]
    keys, counts = unpack(words["blob"].iloc[0]) if len(words) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for r in rows[rows["kind"] == "ask"].itertuples():
        (asked,) = unpack(r.blob)
        at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
        got = np.where(keys[at] == asked, counts[at], 0) if len(keys) else np.zeros(len(asked), np.int64)
        yield "told", r.home, r.key, pack(got), None


def discounts(levels: list[int]) -> np.ndarray:
    """d(1..CUTOFF) from the numbers of events with count 1..CUTOFF+1: Katz's, where those are between 0 and 1; else
    absolute discounting's, so that there always is mass for what was not seen."""
    n = [0, *levels]
    most = (CUTOFF + 1) * n[CUTOFF + 1] / n[1] if n[1] else 1.0
    share = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    out = []
    for r in range(1, CUTOFF + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - most) / (1 - most) if n[r] and most < 1 else 0
        out.append(d if 0 < d < 1 else (r - share) / r)
    return np.array(out)


class _Model:
    """The few global numbers, what follows from them, and the counts of hot contexts."""

    def __init__(self, stats: list[int], hot: np.ndarray, shares: dict[int, tuple[int, int]]):
        k = CUTOFF + 1
        self.hot, self.hot_counts = hot, np.array([shares.get(i, (0, 0))[0] for i in range(len(hot))], np.int64)
        low = np.array([shares.get(i, (0, 0))[1] > 0 for i in range(len(hot))], bool)
        self.hot_full = self.hot_counts + (~low & (self.hot_counts > 0))
        for h, n in zip(hot, self.hot_counts, strict=True):
            if h == BEGIN:
                stats[2 * k + 2] += int(n)
            elif n:
                stats[2 * k] += int(n)
                stats[2 * k + 1] += 1
                if n <= k:
                    stats[k + int(n) - 1] += 1
        self.hot_alpha = np.ones(len(hot))
        self.pairs, self.words = discounts(stats[:k]), discounts(stats[k : 2 * k])
        self.docs = stats[2 * k + 2]
        self.tokens, self.types = stats[2 * k] + self.docs, stats[2 * k + 1] + (self.docs > 0)
        levels = stats[k : 2 * k]
        if 0 < self.docs <= CUTOFF + 1:
            levels = [n + (r + 1 == self.docs) for r, n in enumerate(levels)]
            self.words = discounts(levels)
        low = sum(levels[:CUTOFF])
        self.total = self.tokens + (low == 0)  # no discounted word: one count is left for unknown ones
        taken = sum((r + 1) * n * (1 - self.words[r]) for r, n in enumerate(levels[:CUTOFF]))
        self.unknown = (taken + (low == 0)) / self.total

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, np.where((c > 0) & (c <= CUTOFF), self.words[np.clip(c, 1, CUTOFF) - 1], 1) * c / self.total, self.unknown)


def _finished(rows: pd.DataFrame, m: _Model, buckets: int) -> Iterator[tuple]:
    """Back-off weights of a bucket's contexts, and the unseen pairs' part of the scores."""
    us, cu, full, runs, tv, c, vs, u, v, batch, d, count, batches = unpack(rows[rows["kind"] == "state"]["blob"].iloc[0])
    counts = np.zeros(len(vs), np.int64)
    home = _bucket(vs, buckets)
    for r in rows[rows["kind"] == "told"].itertuples():
        counts[home == r.home] = unpack(r.blob)[0]
    counts[vs == END] = m.docs
    hot_v, hot_u = _among(vs, m.hot), _among(us, m.hot)
    if len(m.hot):
        counts = np.where(hot_v >= 0, m.hot_counts[hot_v], counts)
    p = m.unigram(counts)
    tu = np.repeat(np.arange(len(us)), runs.astype(np.int64))
    c, full = c.astype(np.int64), np.maximum(full.astype(np.int64), 1)
    kept = np.where(c <= CUTOFF, m.pairs[np.clip(c, 1, CUTOFF) - 1], 1) * c
    kept, taken = _group_sum(tu, kept, len(us)), _group_sum(tu, p[tv], len(us))
    for i in np.flatnonzero(hot_u >= 0):
        yield "part", int(hot_u[i]), int(rows["key"].iloc[0]), None, None, float(kept[i]), float(taken[i])
    alpha = np.where((cu > 0) & (hot_u < 0), (1 - kept / full) / np.maximum(1 - taken, 1e-300), 1.0)  # a hot one's is known at the end
    yield "weights", int(rows["key"].iloc[0]), int(rows["key"].iloc[0]), pack(us, alpha), None
    less = -count.astype(np.float64) * (np.log10(np.maximum(alpha[u], 1e-300)) + np.log10(p[v]))
    for j, blob in _by_document(batch, d, [less], []):
        yield "late", -1 - int(batches[j]), int(batches[j]), blob, None


def _frame(rows: Iterator[tuple]) -> pd.DataFrame:
    made = [(*r, *[None] * (len(_NAMES) - len(r))) for r in rows]
    release()
    return pd.DataFrame(made, columns=_NAMES)


def _hot_words(rows: DataFrame, buckets: int) -> np.ndarray:
    """Hashes of the context words that would overfill a bucket, ascending; at most buckets / HOT_SHARES of them."""
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < F.lit(1_000_000 if n <= HOT_SAMPLE else int(1e6 * HOT_SAMPLE / n)))
    words = F.concat(F.array(F.lit(None).cast("string")), F.filter(F.split(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    counts = some.select(F.explode(words).alias("w")).groupBy("w").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    found = [r["w"] for r in counts.where(F.col("count") * buckets > HOT_SHARES * total).collect()]
    return np.sort(np.array([BEGIN if w is None else word_hashes([w.encode()])[0] for w in found], np.uint64))


def score(documents: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    The model learns from the documents for which ``held_out`` is false. A null text is an empty one: its only token is the
    end. ``held_out`` null counts as false. Repeated rows are learnt from and scored each. Without training documents
    nothing is known: then the base is log10(1 / (0 + 1)) and the model gives all mass to the unknown word. Other columns
    are not carried. No documents give no rows.
    """
    bound_batches(documents.sparkSession)
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(text_col, F.lit("")).alias("t"))
    id_type = rows.schema["id"].dataType.simpleString()
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    buckets = max(1, math.ceil(chars / BUCKET_CHARS))
    hot = _hot_words(rows, buckets)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 24
        for b in batches:
            size = pc.binary_length(b.column("t")).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.cumsum(size) // CHUNK_CHARS * (1 << 32) + np.arange(b.num_rows) // CHUNK_TEXTS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j:
                    c = b.slice(i, j - i)
                    for row in _packed(c.column("id"), c.column("held").to_numpy(zero_copy_only=False).astype(bool), c.column("t"), made, buckets, hot):
                        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*row, None, None), _TYPES, strict=True)], _NAMES)
                    made += 1
            release()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf if pdf["key"].iloc[0] < 0 else _frame(_counted(int(pdf["key"].iloc[0]), pdf, buckets, hot))

    counted = materialize(rows.mapInArrow(ship, _ROW).groupBy("key").applyInPandas(count, _ROW), "lm-counts")
    stats = {r["pos"]: r["n"] for r in counted.where("kind = 'stats'").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).collect()}
    shares = counted.where("kind = 'share'").groupBy("key").agg(F.sum(F.get("stats", F.lit(0))).alias("n"), F.sum(F.get("stats", F.lit(1))).alias("low")).collect()
    m = _Model([stats.get(i, 0) for i in range(2 * CUTOFF + 5)], hot, {r["key"]: (r["n"], r["low"]) for r in shares})
    told = counted.where("kind in ('words', 'ask')").groupBy("key").applyInPandas(lambda pdf: _frame(_answered(pdf)), _ROW)
    both = told.unionByName(counted.where("kind = 'state'"))
    finished = materialize(both.groupBy("key").applyInPandas(lambda pdf: _frame(_finished(pdf, m, buckets)), _ROW), "lm-weights")

    for r in finished.where("kind = 'part'").groupBy("key").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect():  # a row per hot word
        if m.hot_counts[r["key"]]:
            m.hot_alpha[r["key"]] = (1 - r["x"] / m.hot_full[r["key"]]) / (1 - r["y"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, held, n = pickle.loads(pdf[pdf["kind"] == "head"]["blob"].iloc[0])
        base, total, known = np.zeros(len(n)), np.zeros(len(n)), np.full(len(n), float(m.docs > 0))
        for kind, blob in zip(pdf["kind"], pdf["blob"], strict=True):
            if kind == "sums":
                steps, s, b, more, k, *levels = unpack(blob)
                _add(total, steps, s * UNIT, -1)
                _add(total, steps, more * UNIT, 1)
                _add(base, steps, b * UNIT, 1)
                _add(known, steps, k, 1)
                for r, x in enumerate(levels):
                    _add(total, steps, np.log10(m.pairs[r]) * x, 1)
            elif kind == "hot":
                steps, h, n_all, n_seen = unpack(blob)
                at, h = np.cumsum(steps.astype(np.int64)), h.astype(np.int64)
                n_all, n_seen = n_all.astype(np.int64), n_seen.astype(np.int64)
                word = m.hot[h] != BEGIN
                np.add.at(base, at, np.where(word, n_all * np.log10(m.hot_counts[h] + 1), 0))
                np.add.at(known, at, np.where(word & (m.hot_counts[h] > 0), n_all, 0))
                np.add.at(total, at, (n_all - n_seen) * np.log10(m.hot_alpha[h]) - n_seen * np.log10(np.maximum(m.hot_full[h], 1)))
            elif kind == "late":
                steps, s = unpack(blob)
                _add(total, steps, s * UNIT, -1)
        base += math.log10(m.docs + 1) - n * math.log10(m.tokens + m.types + 1)
        return pd.DataFrame({"id": pd.Series(ids, dtype=object), "held_out": held, "n_tokens": n, "n_known": known.astype(np.int64), "train_tokens": m.tokens, "base_score": base, "score": total})

    ends = counted.where("kind in ('head', 'sums', 'hot')").unionByName(finished.where("kind = 'late'"))
    return ends.groupBy("key").applyInPandas(gather, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)

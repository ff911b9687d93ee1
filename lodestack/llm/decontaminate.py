"""Operator 4: benchmark passages in documents, found by winnowing.

Of every WINDOW - K + 1 consecutive k-gram hashes the smallest (the last one of equals) is kept, on both sides. A span of
WINDOW words that both share holds a whole such run, so both keep the same one of its k-grams: each shared window is found
by joining kept hashes. Hits are then extended word by word, which also discards equal hashes of different words.
Items shorter than WINDOW words are one window of their own length, for which every k-gram of that length counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import ALNUM_WORDS, BROADCAST_ROWS, Tokens, bound_batches, content_key, list_array, materialize, shingle_hashes, slices, small

WINDOW = 10
K = 5
#: Kept hashes of the benchmark up to which documents drop theirs before the join, and the join is a broadcast.
BROADCAST_HASHES = 2_000_000


def _winnow(t: Tokens, h: np.ndarray, k: int, run: int) -> np.ndarray:
    """Positions of the kept k-grams over all texts: per run of hashes within a text, the last of the smallest."""
    g = shingle_hashes(h, k)
    n = len(g) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    text = t.text_of()
    low, at = g[:n].copy(), np.arange(n)
    for j in range(1, run):
        take = g[j : j + n] <= low
        low[take] = g[j : j + n][take]
        at[take] = np.flatnonzero(take) + j
    inside = text[:n] == text[k + run - 2 : k + run - 2 + n]
    return np.unique(at[inside])


def _prints(texts: pa.Array, sizes: list[int], k: int, window: int) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
    """Kept (text, hash, word position) of a batch: winnowed for ``window``, and every k-gram of the shorter ``sizes``."""
    t = Tokens(texts, ALNUM_WORDS)
    h = t.hashes()
    text = t.text_of()
    found = [(_winnow(t, h, k, window - k + 1), k, 0)] + [(_winnow(t, h, s, 1), s, s) for s in sizes]
    at = np.concatenate([f[0] for f in found])
    hashes = np.concatenate([shingle_hashes(h, s)[a] + np.uint64(tag) for a, s, tag in found]).view(np.int64)
    owner = text[at]
    order = np.lexsort((at, owner))
    at, owner = at[order], owner[order]
    return t, owner, hashes[order], at - t.offsets[owner]


def _words(text: str) -> list[bytes]:
    t = Tokens(pa.array([text], pa.string()), ALNUM_WORDS)
    return [t.vocabulary[c] for c in t.codes]


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: id, text_hash, n_words, n_hit, items (sorted strings; null ids as "null").

    Null texts have no words, hits or items; so have empty ones. Repeated documents are searched once and have a row each
    (``content_key`` tells rows apart that only share an id); repeated items with other ids are all reported. No documents give no rows, no items give no hits.
    Other columns are not carried. A document with many hits is one group, which its own length bounds.
    """
    bound_batches(documents.sparkSession)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(item_text_col, F.lit("")).alias("item_text")).distinct()
    items = items.withColumn("no", F.xxhash64(F.coalesce("item", F.lit("\0null")), "item_text"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.unique(np.diff(Tokens(b.column(0), ALNUM_WORDS).offsets))
            yield pa.record_batch([pa.array(n[(n > 0) & (n < window)], pa.int64())], ["n"])

    sizes = sorted(r["n"] for r in items.select("item_text").mapInArrow(lengths, "n long").distinct().collect())  # under WINDOW

    def item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, owner, hashes, at = _prints(b.column("item_text"), sizes, k, window)
            n = np.diff(t.offsets)[owner]
            own = np.ones(len(at), bool)
            for s in sizes:  # a short item's only window is itself; k-grams of a short length are of use to such items alone
                short = np.isin(hashes, (shingle_hashes(t.hashes(), s) + np.uint64(s)).view(np.int64))
                own &= ~short | (n == s)
            own &= (n >= window) | np.isin(n, sizes) & (at == 0)
            yield pa.record_batch([b.column("no").take(pa.array(owner[own])), pa.array(hashes[own], pa.int64()), pa.array(at[own], pa.int32())], ["no", "hash", "item_at"])

    kept = materialize(items.mapInArrow(item_prints, "no long, hash long, item_at int"), "item-prints")
    bounded = kept.count() <= BROADCAST_HASHES
    # at most BROADCAST_HASHES numbers; beyond, every document hash goes to the join
    wanted = np.unique(np.array([r["hash"] for r in kept.select("hash").distinct().collect()], np.int64)) if bounded else None

    def document_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            t, owner, hashes, at = _prints(b.column("t"), sizes, k, window)
            if wanted is not None:
                hit = wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes if len(wanted) else np.zeros(len(hashes), bool)
                owner, hashes, at = owner[hit], hashes[hit], at[hit]
            counts = np.bincount(owner, minlength=b.num_rows)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            prints = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(hashes, pa.int64()), pa.array(at, pa.int32())], names=["hash", "at"]))
            yield pa.record_batch([b.column("doc"), b.column("text_hash"), pa.array(np.diff(t.offsets), pa.int64()), prints], ["doc", "text_hash", "n_words", "prints"])

    doc_type = documents.schema[id_col].dataType.simpleString()
    key = content_key(id_col, text_col)
    texts = documents.select(key[0].alias("doc"), key[1], F.coalesce(text_col, F.lit("")).alias("t"))
    printed = materialize(texts.mapInArrow(document_prints, f"doc {doc_type}, text_hash long, n_words long, prints array<struct<hash:long,at:int>>"), "prints")

    # (document, item) pairs with the shifts at which a kept hash of both is the same; texts join only then
    hits = printed.where(F.size("prints") > 0).select("doc", "text_hash", F.explode("prints").alias("p")).select("doc", "text_hash", F.col("p.hash").alias("hash"), F.col("p.at").alias("at"))
    hits = hits.join(small(kept, BROADCAST_HASHES) if bounded else kept, "hash")
    shifts = materialize(hits.groupBy("doc", "text_hash", "no").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("shifts")), "shifts")
    names = shifts.select("doc", "text_hash").distinct()
    own = texts.join(small(materialize(names, "names"), BROADCAST_ROWS).select(F.col("doc").alias("d"), F.col("text_hash").alias("h")), F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).groupBy("doc", "text_hash").agg(F.first("t").alias("t"))
    found = shifts.join(items, "no").groupBy("doc", "text_hash").agg(F.collect_list(F.struct("item", "item_text", "shifts")).alias("hits"))
    both = own.join(found.select(F.col("doc").alias("d"), F.col("text_hash").alias("h"), "hits"), F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            covered, names, offsets = [], [], [0]
            for text, hits in zip(b.column("t").to_pylist(), b.column("hits").to_pylist(), strict=True):
                hit, who = _extend(text, hits, window)
                covered.append(hit)
                names += who
                offsets.append(len(names))
            yield pa.record_batch([b.column("doc"), b.column("text_hash"), pa.array(covered, pa.int64()), list_array(np.array(names, object), np.array(offsets), pa.string())], ["d", "h", "n_hit", "items"])

    extended = both.select("doc", "text_hash", "t", "hits").mapInArrow(extend, f"d {doc_type}, h long, n_hit long, items array<string>")
    every = printed.select("doc", "text_hash", "n_words")
    out = every.join(extended, F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return out.select(F.col("doc").alias(id_col), "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _extend(text: str, found: list[dict], window: int) -> tuple[int, list[str]]:
    """Words covered, and the items found, of one document: each hit's run of equal words, if it holds a whole window."""
    ids: dict[bytes, int] = {}
    numbered = lambda t: np.array([ids.setdefault(w, len(ids)) for w in _words(t)], np.int64)
    doc = numbered(text)
    covered, names = np.zeros(len(doc), bool), set()
    for f in found:
        item = numbered(f["item_text"])
        need = min(window, len(item))
        for shift in f["shifts"]:
            lo, hi = max(0, shift), min(len(doc), shift + len(item))
            same = np.concatenate([[False], doc[lo:hi] == item[lo - shift : hi - shift], [False]])
            edges = np.flatnonzero(same[1:] != same[:-1]) + lo
            for begin, end in zip(edges[::2], edges[1::2], strict=True):
                if end - begin >= need:
                    covered[begin:end] = True
                    names.add("null" if f["item"] is None else f["item"])
    return int(covered.sum()), sorted(names)

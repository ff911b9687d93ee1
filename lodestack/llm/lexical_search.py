"""Operator 13: ranked lexical search with K2-treaps over the grid of terms and documents.

A first pass over the documents writes, for each, its length and how often the terms asked for occur in it; numbers of documents,
lengths and document frequencies are counted over all of them. The second pass cuts what was written into blocks of documents.
Each block is a grid: a row per term (in order of weight), a column per document (in order of length), in each cell the term's
share of the document's score. The grid is kept as a compressed quadtree: four bits a node say which quarters hold anything, a
node's children are found by counting bits before it, and each node has the greatest share within it, stored as what it lacks to
its parent's.

An item's terms are rows, and each row's path goes down two of the four quarters at a time. The paths of all terms of an item
descend together over ranges of documents: the sum of the maxima at which they stand bounds every score in the range. Of the
deepest open ranges those with the highest bounds are opened first; ranges whose bound is below the k-th best score so far are
closed unopened. That score is carried over all blocks of a task, whose best are then ranked against those of the others. No
document is left out but by a bound, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import ALNUM_WORDS, BROADCAST_ROWS, Tokens, bound_batches, list_array, materialize, slices, small

#: Terms of items (each item's distinct ones, summed) that are asked for in one pass over the documents.
QUERY_TERMS = 500_000
#: Documents of a block.
BLOCK = 4096
#: Items that descend at once, and ranges of each that are opened at once.
ITEMS, BEAM = 256, 256

ROW_BITS = np.array([[bin(n & ((1 << b) - 1)).count("1") for b in range(4)] for n in range(16)], np.int64)  # bits set below each of four
ALL_BITS = np.array([bin(n).count("1") for n in range(16)], np.int64)


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2**32, each followed by a zero bit, from the lowest."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """A compressed quadtree over cells (row, column, value > 0), each cell once, with maxima of all its squares."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, size: int):
        self.height = max(1, int(size - 1).bit_length())
        code = (_spread(rows) << np.uint64(1)) | _spread(cols)
        order = np.argsort(code)
        code, best = code[order], values[order].astype(np.int64)
        self.quarters: list[np.ndarray] = []  # by level, four bits a node
        self.lacks: list[np.ndarray] = []  # by level from 1 on: what a node lacks to its parent's maximum
        for _ in range(self.height):
            up = code >> np.uint64(2)
            first = np.flatnonzero(np.append(True, up[1:] != up[:-1]))
            bits = np.bitwise_or.reduceat(np.left_shift(1, (code & np.uint64(3)).astype(np.int64)), first)
            above = np.maximum.reduceat(best, first)
            lack = np.repeat(above, np.diff(np.append(first, len(code)))) - best
            self.quarters.append(bits.astype(np.uint8))
            self.lacks.append(lack.astype(np.min_scalar_type(int(lack.max()))))
            code, best = up[first], above
        self.quarters.reverse()
        self.lacks.reverse()
        self.best = int(best[0])
        self.firsts = [np.cumsum(ALL_BITS[q]) - ALL_BITS[q] for q in self.quarters]

    def down(self, level: int, nodes: np.ndarray, quarter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether there is such a child, its number) of nodes of a level."""
        bits = self.quarters[level][nodes]
        return (bits >> quarter.astype(np.uint8)) & 1 == 1, self.firsts[level][nodes] + ROW_BITS[bits, quarter]


@dataclass
class Ranges:
    """Open ranges of one level: their item, column band and bound; and of each the paths' rows, nodes and maxima, in runs."""

    item: np.ndarray
    band: np.ndarray
    bound: np.ndarray
    sizes: np.ndarray
    rows: np.ndarray
    nodes: np.ndarray
    best: np.ndarray

    def take(self, keep: np.ndarray) -> Ranges:
        paths = np.repeat(keep, self.sizes)
        return Ranges(self.item[keep], self.band[keep], self.bound[keep], self.sizes[keep], self.rows[paths], self.nodes[paths], self.best[paths])


class Best:
    """The k best documents of each item so far: highest score first, ties by ascending id, a null id first."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.score, self.doc, self.named = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.least = np.ones(items, np.int64)  # what a score must reach

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, named: np.ndarray) -> None:
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, score])
        doc, named = np.concatenate([self.doc, doc]), np.concatenate([self.named, named])
        order = np.lexsort((doc, named, -score, item))
        item = item[order]
        new = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
        place = np.arange(len(item)) - np.repeat(new, np.diff(np.append(new, len(item))))
        order = order[place < self.k]
        full = item[place == self.k - 1]
        self.item, self.score, self.doc, self.named = item[place < self.k], score[order], doc[order], named[order]
        self.least[full] = self.score[np.searchsorted(self.item, full, "right") - 1]


def _open(treap: Treap, level: int, r: Ranges) -> Ranges:
    """The halves of ranges, with every path one level further down; paths that end there are left out."""
    shift = treap.height - 1 - level
    owner = np.repeat(np.arange(len(r.item)), r.sizes)
    below = (r.rows >> shift) & 1
    parts = []
    for half in (0, 1):
        there, child = treap.down(level, r.nodes, 2 * below + half)
        some = np.flatnonzero(there)
        parts.append((2 * owner[some] + half, r.rows[some], child[some], r.best[some] - treap.lacks[level][child[some]].astype(np.int64)))
    key, rows, nodes, best = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, rows, nodes, best = key[order], rows[order], nodes[order], best[order]
    if not len(key):
        none = np.zeros(0, np.int64)
        return Ranges(none, none, none, none, none, none, none)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    own = key[first]
    return Ranges(r.item[own >> 1], 2 * r.band[own >> 1] + (own & 1), np.add.reduceat(best, first), np.diff(np.append(first, len(key))), rows, nodes, best)


def _beam(r: Ranges, most: int) -> np.ndarray:
    """Whether a range is among the ``most`` highest bounds of its item."""
    order = np.lexsort((-r.bound, r.item))
    item = r.item[order]
    new = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
    out = np.zeros(len(item), bool)
    out[order] = np.arange(len(item)) - np.repeat(new, np.diff(np.append(new, len(item)))) < most
    return out


def descend(treap: Treap, start: Ranges, best: Best, doc: np.ndarray, named: np.ndarray) -> int:
    """Adds the documents of a block to ``best``; returns how many scores were worked out in full."""
    open_, scored = {0: [start]}, 0
    while open_:
        level = max(open_)
        r = open_[level].pop()
        if not open_[level]:
            del open_[level]
        r = r.take(r.bound >= best.least[r.item])
        if not len(r.item):
            continue
        if level == treap.height:
            scored += len(r.item)
            best.add(r.item, r.bound, doc[r.band], named[r.band])
            continue
        if len(r.item) > BEAM:
            top = _beam(r, BEAM)
            if not top.all():
                open_.setdefault(level, []).append(r.take(~top))
                r = r.take(top)
        made = _open(treap, level, r)
        if len(made.item):
            open_.setdefault(level + 1, []).append(made)
    return scored


@dataclass
class Asked:
    """A block of items: terms by number, and each item's terms in runs; weights by term once they are known."""

    terms: list[bytes]
    sizes: np.ndarray
    numbers: np.ndarray
    weights: np.ndarray | None = None


def _counted(asked):
    """Per document: id, length and the asked terms with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {t: i for i, t in enumerate(asked.value.terms)}
        for b in slices(batches):
            words = Tokens(b.column(1), ALNUM_WORDS)
            n = np.diff(words.offsets)
            number = np.fromiter((of.get(w, -1) for w in words.vocabulary), np.int64, len(words.vocabulary))
            at = number[words.codes] if len(words.codes) else np.zeros(0, np.int64)
            some = at >= 0
            key, count = np.unique(words.text_of()[some] * len(of) + at[some], return_counts=True)
            edges = np.searchsorted(key, np.arange(len(n) + 1) * len(of))
            columns = [b.column(0), pa.array(n, pa.int64()), list_array(key % max(1, len(of)), edges, pa.int32()), list_array(count, edges, pa.int32())]
            out = pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(n > 0))

    return run


def _ranked(asked, n_docs: int, n_words: int, k: int):
    """The best k of a task's documents for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Asked = asked.value
        best = Best(len(q.sizes), k)
        rank = np.empty(len(q.terms), np.int64)
        rank[np.argsort(q.weights, kind="stable")] = np.arange(len(q.terms))
        for b in _regrouped(batches):
            _search(q, rank, best, b, n_docs, n_words)
        columns = [pa.array(best.item, pa.int32()), pa.array(best.score, pa.int64()), pa.array(best.doc, pa.int64(), mask=~best.named)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "score", "doc_id"])

    return run


def _regrouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches joined to blocks of about BLOCK rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _search(q: Asked, rank: np.ndarray, best: Best, b: pa.RecordBatch, n_docs: int, n_words: int) -> None:
    ids, n = b.column(0), b.column(1).to_numpy()
    sizes = b.column(2).value_lengths().to_numpy()
    term, tf = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy().astype(np.int64)
    column = np.empty(len(n), np.int64)
    column[np.argsort(n, kind="stable")] = np.arange(len(n))
    doc, named = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
    doc[column], named[column] = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
    m = 50 + (50 * n * n_docs) // n_words
    value = q.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, sizes)))
    cells = value > 0
    present, row = np.unique(rank[term[cells]], return_inverse=True)
    if not len(row):
        return
    treap = Treap(row, np.repeat(column, sizes)[cells], value[cells], max(len(present), len(n)))
    begin = np.cumsum(q.sizes) - q.sizes
    for a in range(0, len(q.sizes), ITEMS):
        size = q.sizes[a : a + ITEMS]
        asked = rank[q.numbers[begin[a] : begin[a] + size.sum()]]
        at = np.minimum(np.searchsorted(present, asked), len(present) - 1)
        there = present[at] == asked
        item = np.repeat(np.arange(a, a + len(size)), size)[there]
        rows = at[there]
        if not len(rows):
            continue
        first = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        counts = np.diff(np.append(first, len(item)))
        start = Ranges(item[first], np.zeros(len(first), np.int64), counts * treap.best, counts, rows, np.zeros(len(rows), np.int64), np.full(len(rows), treap.best))
        descend(treap, start, best, doc, named)


def _terms_of(items: DataFrame) -> DataFrame:
    """(item_id, terms) of items that have a term; rows that share an id are one item."""

    @F.arrow_udf("array<string>")
    def terms(texts: pa.Array) -> pa.Array:
        words = Tokens(texts, ALNUM_WORDS)
        lists = [np.unique(words.codes[a:b]) for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
        return pa.array([[words.vocabulary[i].decode() for i in x] for x in lists], pa.list_(pa.string()))

    found = items.select("item_id", F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).distinct()
    return materialize(found.groupBy("item_id").agg(F.collect_list("term").alias("terms")), "items")


def _item_blocks(items: DataFrame) -> Iterator[DataFrame]:
    """The items in so many parts, by hash, that each asks for QUERY_TERMS terms at most, or is one item."""
    total, n_items = items.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-total // QUERY_TERMS))
    of = lambda n: F.pmod(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit(""))), F.lit(n))
    while 1 < parts < n_items and items.groupBy(of(parts).alias("part")).agg(F.sum(F.size("terms")).alias("n")).agg(F.max("n")).first()[0] > QUERY_TERMS:
        parts *= 2
    for p in range(parts):
        yield items.where(of(parts) == p)


def search(documents: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each item.

    ``documents`` has doc_id (integer) and text, ``items`` item_id and text; other columns do not matter. Terms are runs of
    letters and digits, A-Z lower-cased, anything beyond ASCII included; an item's terms count once each. Equal scores are
    ranked by ascending doc_id, a null id first. Each row of documents is a document, repeated ones too; null texts and texts
    without a term are none, and do not count in N, L or df. Items of one id are one item; an item without terms, or of terms
    that no document has, has no rows. No documents or no items give none.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    results = [_search_items(docs, part, k) for part in _item_blocks(_terms_of(items))]
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def _search_items(docs: DataFrame, part: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    rows = part.collect()  # bounded by QUERY_TERMS
    of: dict[str, int] = {}
    numbers = np.array([of.setdefault(t, len(of)) for r in rows for t in r.terms], np.int64)
    q = Asked([t.encode() for t in of], np.array([len(r.terms) for r in rows], np.int64), numbers)
    shipped = spark.sparkContext.broadcast(q)
    counted = materialize(docs.mapInArrow(_counted(shipped), "doc_id long, n long, terms array<int>, counts array<int>"), "counted")
    n_docs, n_words = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2 * n_docs + 2) / (2 * F.col("df") + 1)))).cast("long")
    weights = np.zeros(len(of), np.int64)
    for r in frequency.select("term", weight.alias("w")).toLocalIterator():  # one row a term that was asked for
        weights[r.term] = r.w
    ready = spark.sparkContext.broadcast(Asked(q.terms, q.sizes, q.numbers, weights))
    best = counted.mapInArrow(_ranked(ready, n_docs, max(1, n_words), k), "item int, score long, doc_id long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {part.schema['item_id'].dataType.simpleString()}")
    return ranked.join(small(materialize(names, "names"), BROADCAST_ROWS), "item").select("item_id", "rank", "doc_id", "score")

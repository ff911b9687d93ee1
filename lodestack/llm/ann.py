"""Operator 6: nearest neighbours by multi-index hashing.

Vectors become binary codes under rotations learned on a bounded sample (PCA, then the rotation that brings the projections
closest to their signs). A code is split into substrings of PART bits, each indexed by value. Of codes within a Hamming radius
r, at least one of m substrings differs in r // m bits at most: probing those values' lists retrieves every code in the radius,
whose vectors are then ranked by cosine. The radius is calibrated on the sample.

Queries and vectors meet in blocks, a pair of blocks per task, which indexes its vectors and returns each query's nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import materialize

#: Vectors that rotations and radius are fitted on, at most (as expected, by a hash of the id).
SAMPLE = 4096
ROTATIONS = 4
#: Bits of a substring: a byte, so that a block's index has 256 lists per substring, and a probe at most 256 values.
PART = 8
#: Share of the sample's true neighbours that the radius has to cover.
COVER = 0.98
INDEX_BLOCK, QUERY_BLOCK = 16_384, 16_384


@dataclass
class Codes:
    """The mean, and the projections whose signs are the code's bits."""

    mean: np.ndarray
    planes: np.ndarray
    radius: int = 0

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes of unit vectors as rows of substrings."""
        bits = (x - self.mean) @ self.planes > 0
        return np.packbits(bits, axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(x: np.ndarray, k: int, rotations: int = ROTATIONS) -> Codes:
    """Codes from a sample of vectors; the radius covers COVER of the k nearest of sample queries."""
    x = _unit(x)
    mean, d = x.mean(0), x.shape[1]
    size = -(-d // PART) * PART
    made = np.random.default_rng(7)
    _, _, axes = np.linalg.svd(x - mean, full_matrices=len(x) < d)
    projected = (x - mean) @ axes.T
    planes = []
    for _ in range(rotations):
        r, _ = np.linalg.qr(made.normal(size=(d, d)))
        for _ in range(20):  # alternate between the signs and the rotation that fits them best
            u, _, v = np.linalg.svd(np.where(projected @ r > 0, 1.0, -1.0).T @ projected)
            r = (u @ v).T
        planes.append(np.pad(axes.T @ r, ((0, 0), (0, size - d))))
    codes = Codes(mean, np.concatenate(planes, axis=1))
    own = codes.of(x)
    q = np.arange(len(x))[:: max(1, len(x) // 256)]
    cosine = x[q] @ x.T
    cosine[np.arange(len(q)), q] = -2
    near = np.argsort(-cosine, axis=1)[:, : min(k, len(x) - 1)]
    far = [np.bitwise_count(own[i] ^ own[n]).sum(1, dtype=np.int64) for i, n in zip(q, near, strict=True)]
    codes.radius = int(np.quantile(np.concatenate(far), COVER)) if near.size else codes.planes.shape[1]
    return codes


class MultiIndex:
    """A block of codes: for each substring and value the list of its rows."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.lists = []
        for c in codes.T:
            ends = np.searchsorted(c[order := np.argsort(c, kind="stable")], np.arange(1, 1 << PART))
            self.lists.append(np.split(order, ends))

    def within(self, code: np.ndarray, radius: int, flips: np.ndarray) -> np.ndarray:
        """Rows with at most ``radius`` other bits; ``flips`` are the masks of up to radius // m bits."""
        hit = np.zeros(len(self.codes), bool)
        for value, lists in zip(code, self.lists, strict=True):
            hit[np.concatenate([lists[v] for v in value ^ flips])] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1, dtype=np.int64) <= radius]


def _flips(bits: int) -> np.ndarray:
    """All masks of a substring with up to so many bits."""
    masks = np.arange(1 << PART, dtype=np.uint8)
    return masks[np.bitwise_count(masks) <= bits]


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten()
    return np.asarray(flat, np.float64).reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of rows that take part: an id, and a finite, non-zero vector of the table's most frequent length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite)
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query by cosine, ties to the smaller id.

    ``is_query`` is a condition on the column ``id``. Vectors that are null, zero, of another length than most, or hold a
    null or non-finite number take no part, nor do rows without an id. Candidates are all rows with another id than the
    query's; repeated rows are one. Fewer than k rows in the radius of a block are filled up with the block's nearest codes,
    so a query gets k results if there are k candidates. No queries or no vectors give no rows.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vector_col), "vectors")
    n, asked = rows.count(), rows.where(is_query).count()
    out = "query_id long, vec_id long, score double"
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = 1_000_000 if n <= SAMPLE else int(1e6 * SAMPLE / n)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share).orderBy("id").collect()  # SAMPLE rows as expected
    codes = fit(np.array([r["v"] for r in sample] or [[1.0]], np.float64), k) if sample else fit(_matrix(pa.array([rows.first()["v"]])), k)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = codes.of(_unit(_matrix(b.column("v"))))
            yield pa.record_batch([b.column("id"), b.column("v"), pa.array([x.tobytes() for x in c], pa.binary())], ["id", "v", "code"])

    kind = rows.schema["v"].dataType.simpleString()
    index = materialize(rows.distinct().mapInArrow(code, f"id long, v {kind}, code binary"), "index")
    index_blocks, query_blocks = -(-n // INDEX_BLOCK), -(-asked // QUERY_BLOCK)
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    block = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    left = index.where(is_query).withColumns({"q": block(query_blocks), "x": each(index_blocks)})
    right = index.withColumns({"x": block(index_blocks), "q": each(query_blocks)})

    def nearest(queries: pa.Table, found: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if len(queries) and len(found):
            unpack = lambda t: np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(t), -1)
            mine, ids, own = unpack(queries), np.asarray(found.column("id")), unpack(found)
            a, b = _matrix(queries.column("v")), _matrix(found.column("v"))
            norms = np.linalg.norm(b, axis=1)
            multi, flips = MultiIndex(own), _flips(codes.radius // own.shape[1])
            for i, name in enumerate(np.asarray(queries.column("id"))):
                at = multi.within(mine[i], codes.radius, flips)
                at = at[ids[at] != name]
                if len(at) < k:
                    apart = np.bitwise_count(own ^ mine[i]).sum(1, dtype=np.int64)
                    apart[ids == name] = 1 << 30
                    at = np.lexsort((ids, apart))[: min(k, int((ids != name).sum()))]
                s = (b[at] @ a[i]) / (norms[at] * np.linalg.norm(a[i]))
                best = np.lexsort((ids[at], -s))[:k]
                out_q.append(np.full(len(best), name))
                out_v.append(ids[at][best])
                out_s.append(s[best])
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        return pa.table({"query_id": join(out_q, np.int64), "vec_id": join(out_v, np.int64), "score": join(out_s, np.float64)})

    met = left.groupBy("q", "x").cogroup(right.groupBy("q", "x")).applyInArrow(nearest, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

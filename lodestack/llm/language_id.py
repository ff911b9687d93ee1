"""Operator 7: language of whole texts by the nearest of several centroids per language.

A text is the TF-IDF vector of its byte trigrams (letters lower-cased, other ASCII a space), hashed to DIM places and
normalised. Spherical k-means gives CENTROIDS centroids per language; the language is that of the centroid with the largest
cosine. A text whose cosine is far below that of the language's own samples, for its length, is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import bound_batches, byte_table, raw_bytes, release

DIM = 4096
CENTROIDS = 4
#: Documents per language that the centroids are fitted on, at most (as expected, by a hash of the distinct texts).
SAMPLE_PER_LANGUAGE = 400
#: A text is rejected below this share of its language's first percentile of cosines: on sf0.01 those are 0.28 to 0.37, no clean
#: text has less than 0.2, and texts in other languages, hex dumps and random letters have 0.04 to 0.11.
REJECT_SHARE = 0.5
#: Distinct trigrams from which the floor holds in full; a shorter text's cosine goes with the square root of its trigrams, and so does its floor.
FULL_TRIGRAMS = 100
UNDETERMINED = "und"

LETTERS = byte_table(lambda b: not (65 <= b <= 90 or 97 <= b <= 122))
_CHUNK = 256  # texts that are counted at once: CHUNK * DIM floats


def _counts(texts: pa.Array) -> np.ndarray:
    """Trigram counts of each text, with a space before and after it."""
    raw, offsets = raw_bytes(texts)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    padded = np.full(len(raw) + 2 * n, 32, np.uint8)
    padded[np.arange(len(raw)) + 2 * doc + 1] = LETTERS[raw]
    owner = np.repeat(np.arange(n), np.diff(offsets) + 2)
    if len(padded) < 3:
        return np.zeros((n, DIM), np.float32)
    b = padded.astype(np.uint32)
    h = (((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)) >> np.uint32(20)
    same = (owner[:-2] == owner[2:]) & ~((b[:-2] == 32) & (b[1:-1] == 32))
    return np.bincount(owner[:-2][same] * DIM + h[same], minlength=n * DIM).reshape(n, DIM).astype(np.float32)


def _vectors(texts: pa.Array, idf: np.ndarray | None) -> Iterator[np.ndarray]:
    """Unit vectors (with ``idf``) or counts of the texts, a chunk at a time."""
    for i in range(0, len(texts), _CHUNK):
        x = _counts(texts.slice(i, _CHUNK))
        if idf is not None:
            np.log1p(x, out=x)
            x *= idf
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        yield x


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; deterministic for a given order of rows."""
    unit = lambda c: c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    seeds = [int(np.argmax(x @ x.mean(0)))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(1))))
    c = x[seeds]
    for _ in range(12):
        near = (x @ c.T).argmax(1)
        c = unit(np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))]))
    return c


@dataclass
class LanguageModel:
    """Languages by centroid, ascending; idf; centroids; the cosine below which a language rejects."""

    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    floors: np.ndarray

    def predict(self, text: Column) -> Column:
        """struct(lang, score, rejected) of a text column; a null text, or one without a letter, is ``und``, 0, rejected."""
        langs, idf, centroids, floors = self.langs, self.idf, self.centroids, self.floors

        @F.arrow_udf("lang string, score double, rejected boolean")
        def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                best, cosine, known = [], [], []
                for x in _vectors(texts, idf) if langs else ():
                    s = x @ centroids.T
                    best.append(s.argmax(1))
                    cosine.append(s.max(1))
                    known.append(np.sqrt(np.minimum(np.count_nonzero(x, axis=1) / FULL_TRIGRAMS, 1)))
                at = np.concatenate(best) if best else np.zeros(len(texts), int)
                score = np.clip(np.concatenate(cosine), 0, 1).astype(float) if best else np.zeros(len(texts))
                lang = [langs[i] for i in at] if langs else [UNDETERMINED] * len(texts)
                low = score < floors[at] * (np.concatenate(known) if known else 1) if langs else np.ones(len(texts), bool)
                yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.bool_())], names=["lang", "score", "rejected"])
                release()

        said = nearest(F.coalesce(text, F.lit("")))
        letters = F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))
        nothing = F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
        return F.when(letters, said).otherwise(nothing)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """A model from labelled rows; rows with a null text or label are passed over. No rows give a model that says ``und``.

    The sample per language is bounded and taken by a hash from its distinct texts, at least one, so that neither copies nor the
    size of a language matter. Each language's vectors are clustered in a task of their own.
    """
    bound_batches(labelled.sparkSession)
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("draw", F.pmod("hash", F.lit(1_000_000)))
    # copies are one text; the text drawn first is always in
    sizes = rows.select("lang", "hash", "draw").distinct().groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("first")).collect()  # one row per language
    if not sizes:
        return LanguageModel([], np.zeros(DIM, np.float32), np.zeros((0, DIM), np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], max(r["first"] + 1, int(1e6 * min(1, sample / r["n"]))))])
    some = rows.where(F.col("draw") < F.try_element_at(share, F.col("lang"))).groupBy("lang", "hash").agg(F.min("text").alias("text"))

    def frequencies(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum((x > 0).sum(0) for x in _vectors(pa.array(pdf["text"], pa.string()), None))
        return pd.DataFrame({"n": [len(pdf)], "df": [total.astype(np.float32).tobytes()]})

    parts = some.groupBy("lang").applyInPandas(frequencies, "n long, df binary").collect()
    n = sum(r["n"] for r in parts)
    idf = np.log((1 + n) / (1 + sum((np.frombuffer(r["df"], np.float32) for r in parts), np.zeros(DIM)))).astype(np.float32) + np.float32(0.01)

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate(list(_vectors(pa.array(pdf.sort_values("text")["text"], pa.string()), idf)))
        c = _cluster(x, CENTROIDS)
        floor = REJECT_SHARE * float(np.quantile((x @ c.T).max(1), 0.01))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "c": [v.astype(np.float32).tobytes() for v in c], "floor": floor})

    found = sorted(some.groupBy("lang").applyInPandas(centroids, "lang string, c binary, floor double").collect(), key=lambda r: (r["lang"], r["c"]))
    return LanguageModel([r["lang"] for r in found], idf, np.stack([np.frombuffer(r["c"], np.float32) for r in found]), np.array([r["floor"] for r in found]))

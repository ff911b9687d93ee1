"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a written table up to which it is broadcast: a few numbers a row, so some tens of MB.
BROADCAST_ROWS = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset in local mode. On a cluster it has to be set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = Path(tempfile.mkdtemp(prefix="lodestack-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/lodestack/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the gateway may be gone by then
        return


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint when ``df`` (a written table) has at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


#: Rows and bytes of an Arrow batch: texts may be long, and a batch is in memory whole, on both sides of a Python task.
BATCH_ROWS, BATCH_BYTES = 2048, 64 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's rows and bytes per Arrow batch to BATCH_ROWS and BATCH_BYTES; it stays so, as frames are lazy."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def release() -> None:
    """Gives freed memory back to the system: Python workers stay between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def content_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Rows with equal id and equal text count as one document; the hash tells apart rows that only share an id."""
    return [F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("\0null"))).alias("text_hash")]


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in either case: the given one, or one with underscores before it."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# ---- token arrays over Arrow buffers (inside tasks) ----


def byte_table(is_separator) -> np.ndarray:
    """Byte translation: A-Z to lower case, separators to a space."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    for b in range(128):
        if is_separator(b):
            t[b] = 32
    return t


#: Words are runs of anything but space and \\x09-\\x0D.
SPACE_WORDS = byte_table(lambda b: b == 32 or 9 <= b <= 13)
#: Words are runs of ASCII letters, digits and anything beyond ASCII.
ALNUM_WORDS = byte_table(lambda b: not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def encode_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Dictionary codes of the byte ranges (ascending, disjoint), and the distinct byte strings."""
    if not len(starts):
        return np.zeros(0, np.int32), []
    edges = np.empty(2 * len(starts), np.int64)
    edges[0::2], edges[1::2] = starts, ends
    both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    d = both.dictionary_encode()
    return d.indices.to_numpy()[0::2], d.dictionary.to_pylist()


class Tokens:
    """Words of a batch of texts: ``codes`` into ``vocabulary`` and, per text, ``offsets`` into ``codes``."""

    def __init__(self, texts: pa.Array, table: np.ndarray):
        raw, offsets = raw_bytes(texts)
        low = table[raw]
        n = len(low)
        inside = low != 32
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.starts = np.flatnonzero(inside & (cut[:-1] | ~before))
        self.ends = np.flatnonzero(inside & (cut[1:] | ~after)) + 1
        self.codes, self.vocabulary = encode_ranges(low, self.starts, self.ends)
        self.offsets = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, by position."""
        return word_hashes(self.vocabulary)[self.codes] if len(self.codes) else np.zeros(0, np.uint64)

    def text_of(self) -> np.ndarray:
        """Each word's text, as an index into the batch."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def word_hashes(words: list[bytes]) -> np.ndarray:
    from pandas.util import hash_array

    a = np.empty(len(words), object)
    a[:] = words
    return hash_array(a, categorize=False)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by first word; runs may cross texts, the caller masks those."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mix(h[j : j + n] + np.uint64(j + 1))
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows, which bounds the arrays that are held per token."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        release()


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

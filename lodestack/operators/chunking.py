"""Greedy packing of a document's lines into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


#: Documents whose lines and chunks are held at once in a task.
ROWS = 64


def pack_lines(lines: list[str], size: int) -> list[str]:
    """Adjacent lines joined while they fit; a longer line is a chunk of its own, whole. Table lines stay together apart."""
    chunks: list[str] = []
    now: list[str] = []
    used, was_table = 0, False
    for line in lines:
        if not line.strip():
            continue
        is_table = "|" in line
        if now and (used + 1 + len(line) > size or is_table != was_table):
            chunks.append("\n".join(now))
            now, used = [], 0
        now.append(line)
        used += len(line) + (used > 0)
        was_table = is_table
    return [*chunks, "\n".join(now)] if now else chunks


def packed(documents: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, chars, content) of each document; documents are independent, so there is no shuffle."""
    kind = documents.schema[id_col].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            rows = [(i, n, len(c), c) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, c in enumerate(pack_lines((t or "").split("\n"), size))]
            ids, number, chars, content = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.record_batch([pa.array(ids, b.schema.field(0).type), pa.array(number, pa.int64()), pa.array(chars, pa.int64()), pa.array(content, pa.string())], [id_col, "chunk", "chars", "content"])

    return documents.select(id_col, text_col).mapInArrow(walk, f"{id_col} {kind}, chunk long, chars long, content string")

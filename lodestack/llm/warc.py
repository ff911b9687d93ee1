"""Operator 5: WARC archives, written and read through Spark's own file access.

A record is its header, a blank line, the block, and a blank line: the text writer with CRLF CRLF as line separator writes
exactly that. Reading splits archives the same way, so each task sees whole pieces of its split in file order. From every
"WARC/1.x" after a blank line it emits a candidate and where its successor would begin. Split sizes give file offsets, and
pointer jumping from offset 0 of each file keeps the records that the chain of successors reaches; magic strings inside
payloads are no link of that chain.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm.common import BROADCAST_ROWS, materialize, small

BREAK = "\r\n\r\n"
#: Payloads of fewer bytes are never revisits.
MIN_REVISIT = 1000
#: Splits with cut records up to which their slices are broadcast (some 100 bytes each); beyond, pieces are shuffled to them.
BROADCAST_SPLITS = 200_000
_ID = "urn:lodestack:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record per page under ``path``, a file per partition. Payload: the html in UTF-8, a null one empty.

    Of pages with equal payloads of at least MIN_REVISIT bytes the largest id is the response and the others revisit it;
    a null id is smaller than any. Smaller payloads are all responses. Line breaks in urls are left out, a null url is
    empty. Repeated rows are records of their own. Other columns are not written.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.regexp_replace(F.coalesce(url_col, F.lit("")), r"[\r\n]", "").alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    digested = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    repeated = digested.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("origin")).where("n > 1").select("digest", "origin")
    repeated = small(materialize(repeated, "repeated"), BROADCAST_ROWS)
    named = digested.join(repeated.withColumn("again", F.lit(True)), "digest", "left").withColumn("revisit", F.coalesce("again", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("origin")))
    name = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html"), F.lit(BREAK))
    common = lambda kind: F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), name("id"), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"))
    response = F.concat(common("response"), F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(http) + F.octet_length("html"), F.lit(BREAK), http, F.col("html"))
    revisit = F.concat(common("revisit"), F.lit("WARC-Refers-To: "), name("origin"), F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nContent-Length: 0{BREAK}"))
    named.select(F.when(F.col("revisit"), revisit).otherwise(response).alias("value")).write.option("lineSep", BREAK).text(path)


_MAGIC = re.compile(rb"WARC/1\.[0-9]\r\n")
_SCAN = "file string, split long, at long, next long, kind string, id string, refers_to string, said_digest string, bytes long, digest string, block long, size long"
_FIELDS = [f.split()[0] for f in _SCAN.split(", ")]


def _payload(kind: str, block: bytes) -> bytes:
    """The block without the HTTP header, where it has one."""
    return block.partition(BREAK.encode())[2] if kind in ("response", "revisit", "request") and block.startswith(b"HTTP/") else block


def _header(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _candidates(file: str, split: int, data: bytes) -> Iterator[dict]:
    """A row per candidate of a split, offsets from the split's first piece; and one with at = -1 for the split's size."""
    yield dict.fromkeys(_FIELDS) | {"file": file, "split": split, "at": -1, "next": len(data)}
    for m in _MAGIC.finditer(data):
        at = m.start()
        if not (at == 0 or data[max(0, at - 4) : at] == BREAK.encode() or at == 2 and data[:2] == b"\r\n"):
            continue
        end = data.find(BREAK.encode(), at)
        head = _header(data[at:end])
        if not (size := head.get("content-length", "")).isdigit():
            continue
        block, size, kind = end + 4, int(size), head.get("warc-type", "")
        whole = block + size <= len(data)
        payload = _payload(kind, data[block : block + size]) if whole else b""
        yield {
            "file": file, "split": split, "at": at, "next": block + size + 4, "kind": kind, "id": head.get("warc-record-id"), "refers_to": head.get("warc-refers-to"), "said_digest": head.get("warc-payload-digest"),
            "bytes": len(payload) if whole else None, "digest": hashlib.sha1(payload).hexdigest() if whole else None, "block": block, "size": size,
        }


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The bytes of each split, of which a task holds one at a time, between its file and offset and any further columns."""
    key, more, pieces = None, [], []
    for b in batches:
        for value, file, split, *rest in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if (file, split) != key:
                if key:
                    yield *key, BREAK.encode().join([*pieces, b""]), *more
                key, more, pieces = (file, split), rest, []
            pieces.append(value)
    if key:
        yield *key, BREAK.encode().join([*pieces, b""]), *more


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", BREAK).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def _reached(candidates: DataFrame) -> DataFrame:
    """(file, at) of the records on the chains from offset 0, by pointer jumping: each round doubles the reach."""
    jump = candidates.select("file", "at", "next").distinct()
    reached = jump.where("at = 0").select("file", "at")
    known = reached.count()
    while True:
        jumped = reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        reached = materialize(reached.unionByName(jumped).distinct(), "reached")
        now = reached.count()
        if now == known:
            return reached
        known = now
        step = jump.select("file", F.col("at").alias("next"), F.col("next").alias("further"))
        jump = materialize(jump.join(step, ["file", "next"]).select("file", "at", F.col("further").alias("next")).distinct(), "jumps")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of uncompressed archives: file, at (byte offset), kind, id, refers_to, said_digest (as in the header),
    bytes and digest (lower-case hex SHA-1) of the payload that was read.

    What follows a break in a file's chain (a length that leads nowhere) is not read. Empty files have no records.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(f, pa.string() if t == "string" else pa.int64()) for f, t in (x.split() for x in _SCAN.split(", "))])
        for file, split, data in _by_split(batches):
            yield pa.RecordBatch.from_pylist(list(_candidates(file, split, data)), kinds)

    scanned = materialize(_pieces(spark, path).mapInArrow(scan, _SCAN), "candidates")
    sizes = scanned.where("at = -1").select("file", "split", F.col("next").alias("length"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(sizes.withColumn("base", F.coalesce(F.sum("length").over(before), F.lit(0))), "splits")
    found = scanned.where("at >= 0").join(bases, ["file", "split"]).withColumns({c: F.col(c) + F.col("base") for c in ("at", "next", "block")})
    found = materialize(found, "candidates")
    chain = found.join(_reached(found), ["file", "at"])
    whole = chain.select("file", "at", "kind", "id", "refers_to", "said_digest", "bytes", "digest")
    cut = chain.where("digest is null").select("file", "at", "kind", "block", "size")
    wanted = cut.withColumnRenamed("at", "record").join(bases, "file").where("base < block + size and base + length > block")
    slices = wanted.groupBy("file", "split").agg(F.collect_list(F.struct("record", "kind", (F.col("block") - F.col("base")).alias("a"), (F.col("block") + F.col("size") - F.col("base")).alias("b"))).alias("slices"))
    slices = materialize(slices, "slices")  # a row per split, with what few records that split cuts want of it
    pieces = _pieces(spark, path)
    if slices.count() <= BROADCAST_SPLITS:
        ordered = pieces.join(F.broadcast(slices), ["file", "split"])  # the order of the scan stays
    else:
        numbered = pieces.withColumn("no", F.monotonically_increasing_id()).join(slices, ["file", "split"])
        ordered = numbered.repartition("file", "split").sortWithinPartitions("file", "split", "no")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, split, data, slices in _by_split(batches):
            for x in slices:
                yield pa.record_batch([[file], [x["record"]], [x["kind"]], [split], [data[max(0, x["a"]) : x["b"]]]], ["file", "at", "kind", "split", "part"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        payload = _payload(pdf["kind"].iloc[0], b"".join(pdf.sort_values("split")["part"]))
        return pd.DataFrame({"file": pdf["file"].iloc[:1], "at": pdf["at"].iloc[:1], "b": [len(payload)], "d": [hashlib.sha1(payload).hexdigest()]})

    joined = ordered.select("value", "file", "split", "slices").mapInArrow(parts, "file string, at long, kind string, split long, part binary").groupBy("file", "at").applyInPandas(join, "file string, at long, b long, d string")
    return whole.join(joined, ["file", "at"], "left").withColumns({"bytes": F.coalesce("bytes", "b"), "digest": F.coalesce("digest", "d")}).drop("b", "d")


def pages_of(records: DataFrame, id_type: str = "long") -> DataFrame:
    """Per record that ``write`` made: page_id, payload_bytes and payload_digest of the full payload (a revisit's: that of
    the record it refers to), record_type, refers_to (a page id; null for responses)."""
    page = lambda c: F.nullif(F.regexp_extract(c, f"^<{_ID}(.*)>$", 1), F.lit("null")).cast(id_type)
    rows = records.select(page("id").alias("page_id"), F.col("kind").alias("record_type"), page("refers_to").alias("refers_to"), "bytes", "digest", F.regexp_replace("said_digest", "^sha1:", "").alias("said"))
    origins = rows.where(f"record_type = 'response' and bytes >= {MIN_REVISIT}").select(F.col("page_id").cast("string").alias("origin"), F.col("bytes").alias("full_bytes"), F.col("digest").alias("full")).distinct()
    # most rows refer to nothing: these get keys of their own, no page's, that spread them
    key = F.coalesce(F.col("refers_to").cast("string"), F.concat(F.lit("none of "), F.xxhash64("page_id", "said")))
    both = rows.withColumn("origin", key).join(origins, "origin", "left")
    revisit = F.col("record_type") == "revisit"
    return both.select("page_id", F.when(revisit, F.col("full_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"), F.when(revisit, F.coalesce("full", "said")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to")

import hashlib
import uuid

import pytest

from lodestack.llm import warc

TRAP = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:lodestack:page:666>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
LONG = "x" * 1500
PAGES = [
    (1, "http://a/", LONG), (2, "http://b/", LONG), (3, None, LONG), (4, "u\r\nX: y", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "é" * 600), (9, "u", "é" * 600),
    (10, "u", "before" + TRAP + "after" + LONG), (11, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n"), (12, "u", "ends\r\n"), (13, "u", "ends\r\n\r\n"), (14, "u", "ends\r\n\r\nWARC/1.1\r\n"), (15, "u", "\r"), (16, "u", "a" * 999), (17, "u", "a" * 999), (18, "u", "y\r\n\r\n" * 3000),
    (19, "u", "\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n" * 40), (19, "u", "again"), (None, "u", LONG),
]


def brute(pages):
    origin = {}
    for i, _, html in pages:
        b = (html or "").encode()
        if len(b) >= 1000:
            origin.setdefault(b, []).append(i)
    out = []
    for i, _, html in pages:
        b = (html or "").encode()
        same = origin.get(b, [i])
        best = max((x for x in same if x is not None), default=None)
        again = len(same) > 1 and i != best
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", best if again else None))
    return sorted(out, key=str)


def round_trip(spark, tmp_path, pages, files=2):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    df = spark.createDataFrame([(*p, "x", 0) for p in pages], "page_id long, url string, html string, digest string, id int").repartition(files)
    warc.write(df, path)
    return path, sorted(map(tuple, warc.pages_of(warc.read(spark, path)).collect()), key=str)


@pytest.mark.parametrize("files", [1, 3])
def test_round_trip(spark, tmp_path, files):
    assert round_trip(spark, tmp_path, PAGES, files)[1] == brute(PAGES)


def test_records_over_many_splits(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert round_trip(spark, tmp_path, PAGES, 1)[1] == brute(PAGES)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_traps_are_candidates_but_not_records(spark, tmp_path):
    path, _ = round_trip(spark, tmp_path, PAGES, 1)
    assert warc.read(spark, path).where("id like '%:666>'").count() == 0
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / path.rsplit("/", 1)[1]).glob("part-*")))
    assert data.count(b"page:666>") == 1


def test_empty(spark, tmp_path):
    assert round_trip(spark, tmp_path, [])[1] == []


def test_cut_records_by_a_shuffle_when_splits_are_too_many_to_broadcast(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://a.org/{i}", f"<p>{i}</p>\r\n\r\n" * 400) for i in range(40)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        want = sorted(tuple(r) for r in warc.pages_of(warc.read(spark, str(tmp_path / "w"))).collect())
        monkeypatch.setattr(warc, "BROADCAST_SPLITS", 0)
        assert sorted(tuple(r) for r in warc.pages_of(warc.read(spark, str(tmp_path / "w"))).collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r[0], r[1]) for r in want] == [(i, len(h.encode())) for i, _, h in rows]

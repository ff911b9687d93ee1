import hashlib
import zlib
from itertools import groupby

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestack.llm import entries, merkle

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """(root, siblings of each leaf), level by level."""
    level, below, proofs = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(level) > 1:
        up, members = [], []
        for k in range(0, len(level), 2):
            run = level[k : k + 2]
            for j, other in enumerate(reversed(run)):
                if len(run) == 2:
                    for m in below[k + j]:
                        proofs[m].append((other, j == 1))
            up.append(sha("".join(run)))
            members.append(sum(below[k : k + 2], []))
            if len(run) == 1:
                for m in members[-1]:
                    proofs[m].append(None)
        level, below = up, members
    return level[0], proofs


def climb(node, proof):
    for step in proof:
        node = sha(node) if step is None else sha(step[0] + node) if step[1] else sha(node + step[0])
    return node


def brute(rows):
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(text(r[c]) for c in entries.LEAF))
    key = lambda r: (r["lang"] is not None, (r["lang"] or "").encode())
    order = lambda r: (*key(r), r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))
    groups = [list(g) for _, g in groupby(sorted(rows, key=order), key)]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    root, tops = tree([t[0] for t in trees]) if trees else (None, [])
    out = []
    for g, (subroot, proofs), top in zip(groups, trees, tops, strict=True):
        for r, proof in zip(g, proofs, strict=True):
            steps = proof + top
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            folded = climb(leaf(r | {"n_chars": r["n_chars"] + 1}) if bad else leaf(r), steps)
            out.append((r["doc_id"], leaf(r), subroot, root, sha("".join(s[0] for s in steps if s)), folded, folded == root))
    return sorted(out, key=str)


def run(spark, tmp_path, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    names = [c.split()[0] for c in schema.split(", ")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in entries.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    return got, brute([dict(zip(names, r, strict=True)) for r in rows])


def test_whole_table(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in entries.op12_merkle_manifest(spark, SF).collect()), key=str)
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(entries.ORACLES["op12_merkle_manifest"])
    got = entries.op12_merkle_manifest(spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("log", [1, 2, 3])
def test_small_blocks(spark, tmp_path, monkeypatch, log):
    """Blocks of 2 to 8 leaves: several rounds of blocks of blocks, with sizes around the powers."""
    monkeypatch.setattr(merkle, "LOG", log)
    rows = [(i * 3 + k, f"text {i}", lang, None if i % 5 else "s", i if i % 3 else None) for k, (lang, n) in enumerate([("aa", 17), ("b", 8), ("é", 9), (None, 7), ("", 1), ("z", 2)]) for i in range(n)]
    got, want = run(spark, tmp_path, [(1000 * k + i, *r[1:]) for k, (i, *r) in enumerate((j, *r) for j, r in enumerate(rows))])
    assert got == want


EDGES = [(1, None, None, None, None), (None, "", "en", "s", 0), (None, "x", "en", None, 1), (5, "é" * 100_000, "en", "s", 7), (2, "a", "de", "b", 1), (2, "a", "de", "b", 1), (2, "c", "de", "b", 1), (12, "1:a", "de", "-", -4)]


def test_edges(spark, tmp_path):
    got, want = run(spark, tmp_path, EDGES)
    assert got == want


@pytest.mark.parametrize("rows", [[], [(9, "one", "en", "s", 3)]])
def test_tiny_tables(spark, tmp_path, rows):
    got, want = run(spark, tmp_path, rows)
    assert got == want


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "t", i, "x", "y") for i in range(5)], "doc_id long, tree string, pos long, witness string, ord string")
    made = merkle.manifest(docs, F.col("tree"), F.col("doc_id"), merkle.leaf_of([F.col("doc_id"), F.col("tree")]), {c: F.col(c) for c in ("doc_id", "tree", "ord")})
    assert sorted((r.doc_id, r.tree, r.ord) for r in made.collect()) == [(i, "t", "y") for i in range(5)]
    assert merkle.verified(made, F.col("leaf")).where("folded_root = root").count() == 5


def test_frontier_appends_subtrees():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(11)]
    whole, parts = merkle.Frontier(), merkle.Frontier()
    for x in leaves:
        whole.append(x)
    for k in range(0, 8, 4):
        block = merkle.Frontier()
        for x in leaves[k : k + 4]:
            block.append(x)
        parts.append(block.close(), 2)
    for x in leaves[8:]:
        parts.append(x)
    root = whole.close()
    assert root == parts.close()
    assert all(merkle.fold(x, i, 11, b"".join(w)) == root for i, (x, w) in enumerate(zip(leaves, whole.witnesses, strict=True)))

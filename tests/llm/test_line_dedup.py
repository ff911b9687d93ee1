import random
import re

import duckdb
import pandas as pd
import pytest

from lodestack.llm import line_dedup
from lodestack.llm.entries import op9_line_dedup

SF = "/root/testdata/sf0.001"


def normal(line):
    return re.sub(r"[\W\d_]+", " ", line.lower()).strip()


def alike(lines):
    """All pairs of lines with an edit similarity of 0.8 or more, by comparing every pair of fitting lengths."""
    made = pd.DataFrame({"i": range(len(lines)), "t": lines})  # noqa: F841
    return duckdb.sql("select x.i, y.i from made x join made y on x.i < y.i and 5 * length(x.t) >= 4 * length(y.t) and 5 * length(y.t) >= 4 * length(x.t) where 5 * levenshtein(x.t, y.t) <= greatest(length(x.t), length(y.t))").fetchall()


def brute(docs):
    """{(id, text): text without repeated lines}; docs by id. Edit similarity alone, no blocks."""
    lines = sorted({normal(x) for _, t in docs for x in (t or "").split("\n")} - {""})
    up = {x: x for x in lines}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in alike(lines):
        up[root(lines[i])] = root(lines[j])
    seen, out = set(), {}
    for i, t in docs:
        if t is None:
            out[i] = None
            continue
        kept = []
        for line in t.split("\n"):
            n = normal(line)
            if not n or root(n) not in seen:
                kept.append(line)
            if n:
                seen.add(root(n))
        out[i] = "\n".join(kept)
    return out


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    want = brute(docs)
    rows = op9_line_dedup(spark, SF).collect()
    assert len(rows) == len(docs)
    text_of, dropped, should = dict(docs), 0, 0
    for r in rows:
        n = 0 if text_of[r.doc_id] is None else len(text_of[r.doc_id].split("\n"))
        kept = 0 if r.text is None else len(r.text.split("\n"))
        assert r.n_lines == n and r.n_dropped in (n - kept, n - kept + 1)
        ours = iter((r.text or "").split("\n"))
        assert not want[r.doc_id] or all(x in ours for x in want[r.doc_id].split("\n"))  # only what repeats goes
        dropped, should = dropped + r.n_dropped, should + n - (0 if text_of[r.doc_id] is None else len(want[r.doc_id].split("\n")))
    assert dropped >= 0.95 * should > 0


def test_fuzzy_groups_longer_than_a_short_list(spark):
    made = random.Random(4)
    bag = ["".join(made.choices("abcdefghij", k=6)) for _ in range(500)]
    base = made.choices(bag, k=80)
    docs = []
    for i in range(40):
        w = list(base)
        for _ in range(made.randint(0, 2)):
            w[made.randrange(80)] = made.choice(bag)
        docs.append((i, f"own {bag[i]} line {bag[i + 1]}\n" + ", ".join(w) + f" {i}\n\n12 34"))
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == brute(docs)


EDGES = [(1, None), (2, ""), (3, "\n\n"), (4, "A b!\n a  B\n1 2\n1 2"), (5, "a, b"), (6, "Ünïcode\nünïcode"), (7, "x" * 60_000 + " y\n" + "x" * 60_000 + " z"), (8, "w " * 70_000)]


def test_edges(spark):
    docs = spark.createDataFrame([(i, t, "k", 5, 6) for i, t in EDGES], "doc_id long, text string, places string, n_lines int, doc int")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert out[1].text is None and (out[1].n_lines, out[1].n_dropped) == (0, 0)
    assert [out[i].text for i in (2, 3, 4, 5, 6, 8)] == ["", "\n\n", "A b!\n1 2\n1 2", "", "Ünïcode", "w " * 70_000]
    assert (out[4].n_lines, out[4].n_dropped, out[4].places, out[4].doc) == (4, 1, "k", 6)


@pytest.mark.parametrize("rows", [[(1, "a\na"), (1, "a\na"), (None, "a")], []])
def test_repeated_rows_null_ids_and_empty_tables(spark, rows):
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == ([(1, ""), (1, ""), (None, "a")] if rows else [])


def test_recall_against_edit_similarity_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = sorted({normal(x) for r in docs.collect() for x in (r.text or "").split("\n")} - {""})
    pairs = [(a, b) for a, b in alike(texts) if len(texts[a]) <= 800]
    lines = line_dedup.line_table(docs)
    name = dict(lines.select("normal", "line").distinct().collect())
    group = dict(line_dedup.line_groups(lines).collect())
    found = sum(group.get(name[texts[a]], 0) == group.get(name[texts[b]], 1) for a, b in pairs)
    assert len(pairs) >= 20 and found >= 0.95 * len(pairs)


def test_a_changed_word_or_letter_in_short_lines(spark):
    docs = [(1, "annual report of the northern office for march"), (2, "annual report of the northern offices for march"), (3, "abcdefgh"), (4, "abxdefgh"), (5, "home page news"), (6, "home pages new"), (7, "zz")]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [out[i] for i in (2, 4, 6)] == ["", "", ""] and out[7] == "zz"


def test_clashing_names_long_lines_without_spaces_and_lines_of_few_words(spark):
    made = random.Random(5)
    han = "".join(chr(0x4E00 + made.randrange(2000)) for _ in range(200))
    docs = [(1, han, "H", "s"), (2, han[:100] + "\u4e00" + han[101:], "I", "t"), (3, "a-b " * 3, "J", "u")]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string, hash string, _hash string")).collect()}
    assert (out[1].text, out[2].text, out[2].hash, out[2]["_hash"]) == (han, "", "I", "t")


def test_members_of_long_lists_are_drawn_in_one_round(spark, monkeypatch):
    """Lines that share a passage and are not alike: components are made once for first candidates, drawn ones, and what is left, at most."""
    made = random.Random(6)
    word = lambda: "".join(made.choices("abcdefghij", k=6))
    passage = " ".join(word() for _ in range(20))
    docs = [(i, " ".join([*(word() for _ in range(8)), passage, *(word() for _ in range(8))])) for i in range(40)]
    docs += [(100 + i, docs[i][1].replace(passage[:6], "zz")) for i in range(12)]
    rounds, components = [], line_dedup.components
    monkeypatch.setattr(line_dedup, "components", lambda links: rounds.append(1) or components(links))
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == brute(docs) and len(rounds) <= 3


def test_lines_that_cannot_be_alike_by_their_letters_are_not_paired(spark, monkeypatch):
    """Lines that share a passage only: those whose own words are of other letters meet in first candidates at most."""
    made = random.Random(7)
    said = lambda letters, n: " ".join("".join(made.choices(letters, k=6)) for _ in range(n))
    passage = said("abcdefghij", 30)
    docs = [(i, " ".join([said(kind, 9), passage, said(kind, 9)])) for i, kind in enumerate(["abcdefghij", "klmnopqrst"] * 40)]
    rounds, similar = [], line_dedup._similar
    monkeypatch.setattr(line_dedup, "_similar", lambda pairs, *rest: rounds.append(pairs.collect()) or similar(pairs, *rest))
    lines = line_dedup.line_table(spark.createDataFrame(docs, "doc_id long, text string"))
    group, name = dict(line_dedup.line_groups(lines).collect()), dict(lines.select("line", "doc").collect())
    assert not group and not alike([t for _, t in docs])
    later = [(name[r.a] - name[r.b]) % 2 for pairs in rounds[1:] for r in pairs]
    assert len(later) > 50 and not any(later)

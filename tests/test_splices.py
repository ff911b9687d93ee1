"""Edits of texts against plain slicing, and their edge cases."""

import random

from lodestack.operators import splices

EDIT = "k int, start int, end int, with string, no int"


def by_hand(text, edits):
    out, at, made, outside = "", 0, 0, 0
    for start, end, word, _ in sorted((e for e in edits if None not in e[:2]), key=lambda e: (e[0], e[1], e[3])):
        if not 0 <= start <= end <= len(text):
            outside += 1
        elif start >= at:
            out, at, made = out + text[at:start] + (word or ""), end, made + 1
    outside += sum(None in e[:2] for e in edits)
    return out + text[at:], made, outside, len(edits) - made - outside


def test_random_edits_equal_slicing(spark):
    made = random.Random(71)
    texts = {i: "".join(made.choices("abé\n ", k=made.randint(0, 30))) for i in range(200)}
    edits = {i: [(made.randint(-2, 33), 0, made.choice(["", "X", "yy", None]), no) for no in range(made.randint(0, 8))] for i in texts}
    edits = {i: [(a, a + made.choice([0, 0, 1, 3, -1]), w, no) for a, _, w, no in e] for i, e in edits.items()}
    edits[3] = [(None, 1, "x", 0), (0, None, "y", 1)]
    rows = spark.createDataFrame([(i, *e) for i, es in edits.items() for e in es] + [(999, 0, 0, "none", 1)], EDIT)
    got = {r.k: tuple(r)[1:] for r in splices.spliced(spark.createDataFrame(list(texts.items()), "k int, text string"), rows, "k").collect()}
    assert got == {i: by_hand(t, edits[i]) for i, t in texts.items()}


def test_long_null_and_empty(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (4, "as it is")], "k int, text string")
    edits = spark.createDataFrame([(1, 0, 0, "a", 1), (2, 0, 0, "a", 2), (2, 0, 0, "b", 1)] + [(3, i, i + 1, "y", i) for i in range(0, 2000, 2)], EDIT)
    got = {r.k: tuple(r)[1:] for r in splices.spliced(texts, edits, "k").collect()}
    assert got[1] == (None, 0, 1, 0) and got[2] == ("ba", 2, 0, 0) and got[4] == ("as it is", 0, 0, 0)
    assert got[3] == ("yx" * 1000 + "x" * 98_000, 1000, 0, 0)


def test_anchors(spark):
    texts = spark.createDataFrame([(1, "Table 1\ntext\n Table 1 \nlast"), (2, "")], "k int, text string")
    tables = spark.createDataFrame([(1, 1, " Table 1", "|a|"), (1, 2, None, "|b|"), (1, 3, "last", "|c|"), (2, 1, "", "|d|")], "k int, no int, anchor string, table string")
    got = {r.k: r.text for r in splices.spliced(texts, splices.below_anchors(texts, tables, "k"), "k").collect()}
    assert got == {1: "Table 1\n\n|a|\n\ntext\n Table 1 \nlast\n\n|b|\n\n\n|c|\n", 2: "\n\n|d|\n"}


def test_anchored_tables_with_digits_and_spaces_at_the_ends_of_lines(spark, tmp_path):
    """The middle line begins with the digit that is its index; others have spaces of other kinds at their ends."""
    import duckdb

    from lodestack import registry

    made = [(7, "first\n1 second 1\nthird"), (8, "0 a 0\n b\n c　\n2 d"), (9, "\n\n"), (10, " x\nx\n \nx")]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.QUERIES["anchored_tables"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(registry.ORACLES["anchored_tables"]).fetchall())

import json
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestack.llm import token_count
from lodestack.llm.entries import op11_token_count

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(list(texts), add_special_tokens=False)]


@pytest.fixture(scope="module")
def machine():
    return token_count.compile_tokenizer(FILE)


def test_whole_table_equals_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), n, n > 512) for r, n in zip(docs, library(r.text or "" for r in docs), strict=True))
    assert sorted(map(tuple, op11_token_count(spark, SF).collect())) == want


PARTS = ["a", "e", "t", "s", "'s", "'ll", "'re", "'v", "'", "''", "l", "r", "v", "m", " ", "  ", "\n", "\t", "　", "\xa0", "\x85", "1", "23", "²", "Ⅷ", "é", "☃", "日本", "привет", "==", "--", "_", "\U0001f600", "<|endoftext|>", "<|endof", "text|>", "the", " quick", "QUICK", "\x00"]
LONG = ["a" * 30_000, " " * 5000, "the " * 9999, "é" * 3000, "'" * 500, "ab" * 9000, "x" * 127 + " y", "x" * 128 + "'s", "\n" * 129 + "z"]


def test_random_texts_equal_library(library, machine):
    made = random.Random(5)
    texts = ["".join(made.choices(PARTS, k=made.randint(0, 30))) for _ in range(8000)] + LONG
    assert token_count.TokenCounter(machine).count(pa.array(texts)).tolist() == library(texts)


def test_chunks_and_forgotten_states_do_not_matter(library, machine, monkeypatch):
    monkeypatch.setattr(token_count, "STEP", 3)
    monkeypatch.setattr(token_count, "STATES", 20)
    monkeypatch.setattr(token_count, "WORDS", 5)
    made = random.Random(6)
    texts = ["".join(made.choices(PARTS, k=made.randint(0, 20))) for _ in range(500)]
    counter = token_count.TokenCounter(machine)
    assert [n for t in texts for n in counter.count(pa.array([t])).tolist()] == library(texts)


def test_scan_of_chunk_maps_equals_one_reading(machine, monkeypatch):
    """The cutter's answer does not depend on where chunks end, and equals that of reading character by character."""
    counter = token_count.TokenCounter(machine)
    made = random.Random(8)
    text = "".join(made.choices(PARTS, k=3000)).encode()
    symbols, _ = counter.symbols(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    state, want = token_count.START, []
    for s in symbols.tolist():
        want.append(bool(counter.begins[s, state]))
        state = counter.to[s, state]
    for step in (1, 2, 7, 64, 128, 5000):
        monkeypatch.setattr(token_count, "STEP", step)
        assert counter.words(symbols).tolist() == want


def test_special_tokens_do_not_cross_texts(library, machine):
    texts = ["a <|endof", "text|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "  <|endoftext|>  x", "<|<|endoftext|>"]
    assert token_count.TokenCounter(machine).count(pa.array(texts)).tolist() == library(texts)


def test_edges(spark, library, machine):
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "two words"), (4, "x" * 100_000), (5, " \n ")]
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, n_tokens int, N_BYTES string")
    out = token_count.token_counts(docs, machine, limit=1)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n, n > 1) for (i, t), n in zip(rows, library(t or "" for _, t in rows), strict=True)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert token_count.token_counts(docs.limit(0), machine, limit=1).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_count.compile_tokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_two_tokenizers_in_one_session(spark, machine, tmp_path):
    """Workers stay between queries, and must not count with the tokenizer of the one before."""
    spec = json.load(open(FILE, encoding="utf-8"))
    spec["added_tokens"] = []
    (tmp_path / "plain.json").write_text(json.dumps(spec), encoding="utf-8")
    plain = token_count.compile_tokenizer(str(tmp_path / "plain.json"))
    docs = spark.createDataFrame([(i, "a <|endoftext|> b") for i in range(8)], "doc_id long, text string")
    for m, n in ((machine, 4), (plain, 9), (machine, 4)):
        assert {r.n_tokens for r in token_count.token_counts(docs, m, limit=1).collect()} == {n}

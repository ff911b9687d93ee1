"""Operator 11: token counts by compiled finite-state transducers, without building the tokens.

Two deterministic transducers are compiled from the file of a byte-level BPE tokenizer:

* The cutter reads characters, each as a symbol of its class and of what follows it, and emits 1 where a word (a unit that
  the merges never cross) begins. It has ten states. Texts are cut into chunks of STEP characters; every chunk's map from
  state to state is computed at once for all chunks, the maps are composed by a parallel prefix scan, and each chunk is read
  again from the state in which it really begins. The first character of a text maps every state to the same one, so one
  scan serves all texts of a batch.
* The counter reads a word's bytes. Its transitions emit by how much one more byte changes the number of tokens (this may be
  negative, as tokens merge). A state holds, for each suffix that may still become a token, the last token before it and the
  count there, as far as they differ; nothing else of the past matters, so there are finitely many. States and transitions
  are made when they are first met, and each distinct word of a batch is read once.

A sequence of tokens is what the merges make of its bytes exactly if this holds for each two neighbours; so among the suffixes
one token alone can be the last one of a prefix.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import bound_batches, raw_bytes, release

#: Characters of a chunk.
STEP = 128
#: Bytes of text that are cut at once.
SLICE_BYTES = 4 << 20
#: States of the counter that a worker keeps; then it starts over, which changes no count.
STATES = 300_000
#: Words whose counts a worker keeps.
WORDS = 500_000

# ---- symbols of characters, and the cutter's states ----

LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)  # classes of characters
(S_LETTER, S_NUMBER, S_OTHER, S_ENDS_1, S_ENDS_2, S_JOINS, S_LONE, S_RUN, S_SPECIAL, S_WITHIN) = range(10)
FIRST = 10  # added to the symbol of a text's first character
(START, LETTERS, NUMBERS, OTHERS, WHITES, JOINED, ONE_MORE, TWO_MORE, SPECIAL) = range(9)
N_STATES = 9


def _cutter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a word begins here) by symbol and state."""
    to, begins = np.zeros((2 * FIRST, N_STATES), np.uint8), np.ones((2 * FIRST, N_STATES), np.uint8)
    for symbol, goes, stays in ((S_LETTER, LETTERS, {LETTERS, JOINED}), (S_NUMBER, NUMBERS, {NUMBERS, JOINED}), (S_OTHER, OTHERS, {OTHERS, JOINED}), (S_RUN, WHITES, {WHITES}), (S_JOINS, JOINED, set()), (S_LONE, START, set()), (S_SPECIAL, SPECIAL, set()), (S_WITHIN, SPECIAL, {SPECIAL})):
        to[symbol] = goes
        begins[symbol, list(stays)] = 0
    for symbol, goes in ((S_ENDS_1, ONE_MORE), (S_ENDS_2, TWO_MORE)):  # an apostrophe before s, t, m, d or re, ve, ll
        to[symbol] = goes
        within = [OTHERS, JOINED]
        to[symbol, within], begins[symbol, within] = OTHERS, 0
    for state, goes in ((ONE_MORE, START), (TWO_MORE, ONE_MORE)):
        to[:FIRST, state], begins[:FIRST, state] = goes, 0
    to[FIRST:] = to[:FIRST, START : START + 1]
    return to, begins


# ---- compilation ----


@dataclass
class Machine:
    """What the transducers need of a tokenizer: classes of all characters, merges as (left, right, made) by rank, the bytes of
    the tokens that occur."""

    classes: np.ndarray
    merges: np.ndarray
    tokens: list[bytes]
    special: list[str]
    name: str  # tells machines apart


def _classes() -> np.ndarray:
    """Classes of all code points, asked of the library's own patterns."""
    from tokenizers import Regex, normalizers

    out = np.full(0x110000, OTHER, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for pattern, cls, other in ((r"\p{L}", LETTER, "1"), (r"\p{N}", NUMBER, "a"), (r"\s", WHITE, "a")):
        replace = normalizers.Replace(Regex(pattern), other)
        for low in range(0, len(points), 4096):
            some = "".join(map(chr, points[low : low + 4096]))
            before, after = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (some, replace.normalize_str(some)))
            out[before[before != after]] = cls
    out[ord(" ")] = SPACE
    return out


def _printable() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _occurs(i: int, tokens: list[bytes], of: dict[bytes, int], ranks: dict[tuple[int, int], int]) -> bool:
    """Whether the merges make this very token of its bytes; others never occur."""
    parts = [of[tokens[i][j : j + 1]] for j in range(len(tokens[i]))]
    while len(parts) > 1:
        rank, at = min((ranks.get(p, 1 << 40), j) for j, p in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 40:
            return False
        parts[at : at + 2] = [of[tokens[parts[at]] + tokens[parts[at + 1]]]]
    return parts == [i]


def compile_tokenizer(path: str) -> Machine:
    """Reads a byte-level BPE tokenizer (.json of the tokenizers library) that cuts by the usual pattern and normalises nothing.

    Raises ValueError for others. Special tokens must not be prefixes of each other; they are found in texts as the library does.
    """
    with open(path, "rb") as f:
        data = f.read()
    spec = json.loads(data)
    model, cut, added = spec["model"], spec["pre_tokenizer"] or {}, spec.get("added_tokens", [])
    plain = not spec["normalizer"] and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    usual = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or not usual or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("only plain byte-level BPE tokenizers are supported")
    byte, ids = _printable(), model["vocab"]
    tokens = [b""] * (max(ids.values()) + 1)
    for name, i in ids.items():
        if all(c in byte for c in name):
            tokens[i] = bytes(byte[c] for c in name)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int32).reshape(-1, 3)
    of, ranks = {t: i for i, t in enumerate(tokens) if t}, {(a, b): r for r, (a, b, _) in enumerate(merges.tolist())}
    occurring = [t if t and _occurs(i, tokens, of, ranks) else b"" for i, t in enumerate(tokens)]
    return Machine(_classes(), merges, occurring, [t["content"] for t in added], hashlib.sha256(data).hexdigest())


class Counter:
    """The second transducer; see the module's text."""

    def __init__(self, m: Machine):
        self.made = {(a, b): rank for rank, (a, b, _) in enumerate(m.merges.tolist())}
        self.parts = {t: (rank, a, b) for rank, (a, b, t) in reversed(list(enumerate(m.merges.tolist())))}
        self.trie, self.token, self.opens = {}, [-1], [False]  # node and byte to node; token at a node; whether one goes on
        for i, text in enumerate(m.tokens):
            node = 0
            for b in text:
                key = node << 8 | b
                if key not in self.trie:
                    self.trie[key] = len(self.token)
                    self.token.append(-1)
                    self.opens.append(False)
                self.opens[node] = True
                node = self.trie[key]
            if text:
                self.token[node] = i
        self.known: dict[tuple[int, int], bool] = {}
        self.read: dict[bytes, int] = {}
        self._empty()

    def _empty(self) -> None:
        self.ids, self.states, self.steps = {}, [], []
        self._state(((0, -1, 0),))

    def _state(self, state: tuple) -> int:
        k = self.ids.setdefault(state, len(self.states))
        if k == len(self.states):
            self.states.append(state)
            self.steps.append({})
        return k

    def apart(self, a: int, b: int) -> bool:
        """Whether two tokens side by side stay as they are: whichever was merged last is taken apart, and at each stage the
        two parts that then touch must not have merged earlier than what has just been undone."""
        if (a, b) in self.known:
            return self.known[a, b]
        key, before, tie, out = (a, b), 1 << 40, True, True
        while True:
            rank = self.made.get((a, b))
            if rank is not None and (rank < before or rank == before and tie):
                out = False
                break
            left, right = self.parts.get(a), self.parts.get(b)
            if left is None and right is None:
                break
            if right is None or left is not None and left[0] > right[0]:
                before, a, tie = left[0], left[2], False  # of equal ranks the leftmost merges first
            else:
                before, b, tie = right[0], right[1], True
        if len(self.known) > 4 * STATES:
            self.known.clear()
        self.known[key] = out
        return out

    def _step(self, s: int, byte: int) -> tuple[int, int]:
        """The transition from a state by a byte: next state, change of the count."""
        last, count, live = -1, 0, []
        for node, before, at in self.states[s]:
            child = self.trie.get(node << 8 | byte)
            if child is None:
                continue
            token = self.token[child]
            if last < 0 and token >= 0 and (before < 0 or self.apart(before, token)):
                last, count = token, at + 1
            if self.opens[child]:
                live.append((child, before, at))
        made = self._state((*((node, before, at - count) for node, before, at in live), (0, last, 0)))
        self.steps[s][byte] = (made, count)
        return made, count

    def counts(self, words: list[bytes]) -> Iterator[int]:
        """Tokens of each word; words that were read lately are not read again."""
        if len(self.states) > STATES:
            self._empty()
        if len(self.read) > WORDS:
            self.read.clear()
        steps, read = self.steps, self.read
        for word in words:
            total = read.get(word)
            if total is None:
                state = total = 0
                for b in word:
                    state, change = steps[state].get(b) or self._step(state, b)
                    total += change
                read[word] = total
            yield total


# ---- counting a batch ----


class TokenCounter:
    def __init__(self, m: Machine):
        self.m, self.counter = m, Counter(m)
        self.to, self.begins = _cutter()
        roles = np.zeros(0x110000, np.uint8)  # letters of the contractions
        for letters, role in (("stmd", 1), ("rv", 2), ("l", 3), ("e", 4), ("'", 5)):
            roles[[ord(c) for c in letters]] = role
        self.roles = roles

    def _special(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Byte ranges of special tokens, from left to right, within one text each."""
        data, out = raw.tobytes(), []
        for name in self.m.special:
            text, at = name.encode(), 0
            while text and (at := data.find(text, at)) >= 0:
                inside = np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(text) - 1, "right")
                out += [(at, at + len(text))] * bool(inside)
                at += len(text) if inside else 1
        return sorted(out)

    def symbols(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of each character and the byte at which it begins."""
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        n = len(points)
        special = self._special(raw, offsets)
        first = np.zeros(n + 1, bool)  # of a text
        first[np.searchsorted(at, offsets)] = True
        ends = first.copy()  # where nothing of the character before can be joined
        for a, b in special:
            ends[np.searchsorted(at, [a, b])] = True
        cls, role = self.m.classes[points], self.roles[points]
        white = np.append(cls >= SPACE, False)
        follows = ~ends[1:] & ~white[1:]  # what comes next is no white space, and there is something
        out = cls.copy()  # letters, numbers and others are their own symbols
        out[white[:-1]] = S_RUN
        out[(cls == SPACE) & follows] = S_JOINS
        out[(cls == WHITE) & follows] = S_LONE
        quote = np.flatnonzero((role == 5) & ~ends[1:])
        one, two = role[quote + 1], role[np.minimum(quote + 2, n - 1)]
        pair = ~ends[np.minimum(quote + 2, n)] & (((one == 2) & (two == 4)) | ((one == 3) & (two == 3)))
        out[quote[one == 1]] = S_ENDS_1
        out[quote[pair]] = S_ENDS_2
        for a, b in special:
            a, b = np.searchsorted(at, [a, b])
            out[a], out[a + 1 : b] = S_SPECIAL, S_WITHIN
        out[first[:-1]] += FIRST
        return out, at

    def words(self, symbols: np.ndarray) -> np.ndarray:
        """Whether a word begins, by character: chunk maps, their prefix scan, and a second reading."""
        n = len(symbols)
        rows = -(-n // STEP)
        grid = np.full(rows * STEP, S_WITHIN, np.uint8)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(rows, STEP).T)
        to, begins = self.to.ravel(), self.begins.ravel()
        maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
        for s in grid:
            maps = to[(s[:, None].astype(np.uint16) * N_STATES) + maps]
        reach = 1
        while reach < rows:  # maps[i] becomes that of all chunks up to i
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], 1)
            reach *= 2
        state = np.zeros(rows, np.uint8)
        state[1:] = maps[:-1, START]
        out = np.empty((STEP, rows), np.uint8)
        for k, s in enumerate(grid):
            key = s.astype(np.uint16) * N_STATES + state
            out[k], state = begins[key], to[key]
        return out.T.ravel()[:n].astype(bool)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null counts as empty."""
        raw, offsets = raw_bytes(texts)
        if not len(raw):
            return np.zeros(len(offsets) - 1, np.int64)
        symbols, at = self.symbols(raw, offsets)
        begin = self.words(symbols)
        special = symbols[begin] % FIRST == S_SPECIAL
        starts = at[begin]
        edges = np.append(starts, len(raw)).astype(np.int64)
        d = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        each = np.fromiter(self.counter.counts(d.dictionary.to_pylist()), np.int64, len(d.dictionary))
        tokens = np.where(special, 1, each[d.indices.to_numpy()])
        total = np.concatenate([[0], np.cumsum(tokens)])
        where = np.searchsorted(starts, offsets)
        return total[where[1:]] - total[where[:-1]]


_COUNTERS: dict[str, TokenCounter] = {}


def _counter_of(m: Machine) -> TokenCounter:
    """One per worker, of the machine that it was last asked for."""
    if m.name not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[m.name] = TokenCounter(m)
    return _COUNTERS[m.name]


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about SLICE_BYTES; a longer text is a run of its own."""
    sizes = np.diff(raw_bytes(texts)[1])
    a, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > SLICE_BYTES:
            yield texts.slice(a, i - a)
            a, total = i, 0
        total += n
    if a < len(texts):
        yield texts.slice(a)


def n_tokens(spark: SparkSession, text: Column, m: Machine) -> Column:
    """Tokens (long) of a text, as many as the library's encoder gives; null and empty texts have 0."""
    bound_batches(spark)
    shipped = spark.sparkContext.broadcast(m)

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter_of(shipped.value)
        for texts in batches:
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *[counter.count(s) for s in _slices(texts)]]), pa.int64())
            release()

    return counted(F.coalesce(text, F.lit("")))


def token_counts(documents: DataFrame, m: Machine, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents``' ids with n_bytes (of UTF-8), n_tokens (long) and over_limit (n_tokens > limit).

    One row per row, in any order: repeated rows, null ids and extra columns are no matter; a null or an empty text has no
    bytes and no tokens. Texts of any length are read whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = documents.select(F.col(id_col).alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(documents.sparkSession, text, m).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

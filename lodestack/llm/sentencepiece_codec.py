"""Operator 10: SentencePiece BPE encoding by suffix-array matching, and decoding.

No piece of such a model holds a space after another character, so texts fall apart into segments (spaces, then the rest)
that are encoded on their own; each distinct segment of a batch once. The distinct segments are concatenated and indexed by
a suffix array (suffixes sorted by as many bytes as the longest piece has); every piece is looked up by binary search, which
gives its range of occurrences. These are the lattice's edges. Sorted by position, they are relaxed from left to right: the
encoding of each prefix ends in exactly one piece, the one that stays separate from the last piece before it under the
model's merges. So the result is that of greedy merging. Characters without a piece become their UTF-8 bytes' pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import bound_batches, list_array, raw_bytes, release

SPACE = "▁"
#: Bytes of distinct segments that one suffix array covers; the next ones get another.
INDEX_BYTES = 1 << 16
#: Bytes of text that are cut into segments at once.
SLICE_BYTES = 1 << 20
#: Texts that are encoded or decoded at once; fewer where both are done, as more is held.
ROWS, CHECKED_ROWS = 4096, 1024
_NONE = -1


@dataclass
class Vocabulary:
    """What encoding needs of a model: pieces by id (spaces as such), ranks of merges, ids of bytes."""

    pieces: list[bytes]
    ranks: np.ndarray  # by id; a smaller one merges first; characters -1; pieces that do not match -2
    byte_ids: np.ndarray


def load(model_file: str) -> Vocabulary:
    """Reads a BPE model with byte fallback, an identity normaliser and a dummy prefix (checked)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
    pieces = [names[i].replace(SPACE, " ").encode() if normal[i] else b"" for i in range(n)]
    if any(" " in p.lstrip(SPACE).replace(SPACE, " ") for p, ok in zip(names, normal, strict=True) if ok) or sp.encode("  a", out_type=str)[-1] != SPACE + "a":
        raise ValueError("only models whose spaces start a piece are supported")
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    ranks = np.full(n, -2, np.int64)
    long = [i for i in range(n) if normal[i] and len(names[i]) > 1]
    for r, i in enumerate(sorted(long, key=lambda i: (-sp.get_score(i), i))):
        ranks[i] = r
    for i in range(n):
        if normal[i] and len(names[i]) == 1:
            ranks[i] = -1
    return Vocabulary(pieces, ranks, byte_ids)


def _slot(key: np.ndarray) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)


class _Merges:
    """Merges between pieces: which piece two make, and the two that each was last made of."""

    def __init__(self, v: Vocabulary):
        of = {p: i for i, p in enumerate(v.pieces) if p}
        self.left, self.right = np.full(len(v.pieces), _NONE), np.full(len(v.pieces), _NONE)
        self.rank = v.ranks
        pairs = [(of[p[:c]], of[p[c:]], i) for p, i in of.items() for c in range(1, len(p)) if p[:c] in of and p[c:] in of]
        a = np.array(pairs, np.int64).reshape(-1, 3)
        key = a[:, 0] << 32 | a[:, 1]
        order = np.argsort(key)
        self.keys, self.made = key[order], v.ranks[a[order, 2]]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[_slot(self.keys)] = True
        by_pair = {(x, y): v.ranks[i] for x, y, i in pairs}
        self.whole = np.zeros(len(v.pieces), bool)
        for p, i in of.items():
            parts = [of.get(c.encode(), _NONE) for c in p.decode()]
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda j: by_pair.get((parts[j], parts[j + 1]), 1 << 40))
                if (parts[best], parts[best + 1]) not in by_pair:
                    break
                if len(parts) == 2:
                    self.left[i], self.right[i] = parts
                parts[best : best + 2] = [of[v.pieces[parts[best]] + v.pieces[parts[best + 1]]]]
            self.whole[i] = parts == [i]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        out = np.full(len(key), 1 << 40)
        may = np.flatnonzero(self.filter[_slot(key)])  # most pairs make nothing, and one look tells
        at = np.minimum(np.searchsorted(self.keys, key[may]), len(self.keys) - 1)
        out[may] = np.where(self.keys[at] == key[may], self.made[at], 1 << 40)
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b, side by side, stay as they are.

        Both are unmade, latest merge first, and at each state it is asked whether the parts that then touch would have
        merged before the merge that has just been undone.
        """
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), 1 << 39)
        last_left = np.zeros(len(a), bool)
        while len(live):
            made = self.rank_of(a, b)
            # of equal ranks the leftmost merges first: the touching pair lies right of a's inside and left of b's
            joins = (made < limit) | ((made == limit) & ~last_left)
            out[live[joins]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~joins & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb)
            last_left = undo_a
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return out


def _columns(pieces: list[bytes], width: int) -> np.ndarray:
    """Byte strings as rows of big-endian numbers, padded with zeros, so that they compare as the strings do."""
    return np.array(pieces, f"S{8 * width}").view(np.uint8).reshape(-1, width, 8).view(">u8")[:, :, 0].astype(np.uint64)


class Encoder:
    def __init__(self, v: Vocabulary):
        self.v, self.merges = v, _Merges(v)
        self.lines = any(b"\n" in p for p in v.pieces)
        self.ids = np.array([i for i, p in enumerate(v.pieces) if p and self.merges.whole[i]])
        self.sizes = np.array([len(v.pieces[i]) for i in self.ids])
        self.width = -(-int(self.sizes.max()) // 8)
        self.low = _columns([v.pieces[i] for i in self.ids], self.width)
        self.long_heads = np.unique(self.low[self.sizes > 8, 0])
        self.high = _columns([v.pieces[i].ljust(8 * self.width, b"\xff") for i in self.ids], self.width)

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, id) of every occurrence of every piece."""
        padded = np.concatenate([text, np.zeros(8 * self.width + 8, np.uint8)])
        word = np.zeros(len(text) + 8 * self.width, np.uint64)
        for j in range(8):
            word = word << np.uint64(8) | padded[j : j + len(word)]
        cols = [word[8 * j : 8 * j + len(text)] for j in range(self.width)]
        suffixes = np.argsort(cols[0])
        first = cols[0][suffixes]
        # only where a longer piece begins with the same 8 bytes does the order of the bytes behind them matter
        if len(self.long_heads):
            at = np.minimum(np.searchsorted(self.long_heads, first), len(self.long_heads) - 1)
            more = np.flatnonzero(self.long_heads[at] == first)
            some = suffixes[more]
            suffixes[more] = some[np.lexsort([c[some] for c in cols[::-1]])]
        cols = [c[suffixes] for c in cols]
        first = self._search(cols, self.low, False)
        last = self._search(cols, self.high, True)
        count = last - first
        which = np.repeat(np.arange(len(self.ids)), count)
        at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        return suffixes[at], self.sizes[which], self.ids[which]

    @staticmethod
    def _search(cols: list[np.ndarray], keys: np.ndarray, after: bool) -> np.ndarray:
        """For each key the number of suffixes below it (``after``: not above it), by binary search."""
        lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), len(cols[0]))
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = np.minimum(mid, len(cols[0]) - 1)
            less, same = np.zeros(len(keys), bool), np.ones(len(keys), bool)
            for j, c in enumerate(cols):
                x = c[at]
                less |= same & (x < keys[:, j])
                same &= x == keys[:, j]
            go = open_ & (less | (same & after))
            lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
        return lo

    def segments(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the encodings of distinct segments."""
        ids, sizes = [], []
        for a, b in _runs([len(s) for s in found], INDEX_BYTES):
            i, n = self._relax(found[a:b])
            ids.append(i)
            sizes.append(n)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), offsets

    def _relax(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        text = np.frombuffer(b"\xff".join(found) + b"\xff", np.uint8)
        lengths = np.array([len(s) for s in found])
        begin = np.cumsum(lengths + 1) - lengths - 1
        start, size, piece = self._edges(text)
        # characters without a piece: a run of bytes that never merges
        head = (text & 0xC0) != 0x80
        single = np.zeros(len(text), bool)
        single[start[self.v.ranks[piece] == -1]] = True
        lone = np.flatnonzero(head & ~single & (text != 0xFF))
        heads = np.append(np.flatnonzero(head), len(text))
        lone_size = heads[np.searchsorted(heads, lone) + 1] - lone
        start, size = np.concatenate([start, lone]), np.concatenate([size, lone_size])
        piece = np.concatenate([piece, np.full(len(lone), _NONE)])
        owner_begin = np.repeat(begin, lengths + 1)
        order = np.argsort((start - owner_begin[start]), kind="stable")
        start, size, piece = start[order], size[order], piece[order]
        depth = start - owner_begin[start]
        last = np.full(len(text) + 1, -2, np.int64)  # the piece that ends before a position; -1: a lone character or none
        came = np.zeros(len(text) + 1, np.int64)
        last[begin] = -1
        for lo, hi in _equal_runs(depth):
            s, n, p = start[lo:hi], size[lo:hi], piece[lo:hi]
            before = last[s]
            ok = before >= -1
            ask = ok & (before >= 0) & (p >= 0)
            ok[ask] = self.merges.apart(before[ask], p[ask])
            last[s[ok] + n[ok]] = p[ok]
            came[s[ok] + n[ok]] = n[ok]
        return self._trace(text, begin, begin + lengths, last, came, len(found))

    def _trace(self, text, begin, end, last, came, n):
        """Back from the ends of all segments at once; lone characters as bytes."""
        rows, steps, out = [], [], []
        live, at = np.arange(n), end.copy()
        live, at = live[at > begin], at[at > begin]
        step = 0
        while len(live):
            rows.append(live)
            p, size = last[at], came[at]
            out.append(np.where(p >= 0, p, -at))
            steps.append(np.full(len(live), step))
            at = at - size
            go = at > begin[live]
            live, at, step = live[go], at[go], step + 1
        if not rows:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        rows, steps, out = np.concatenate(rows), np.concatenate(steps), np.concatenate(out)
        order = np.lexsort((-steps, rows))
        rows, out = rows[order], out[order]
        lone = out < 0
        size = np.where(lone, came[np.where(lone, -out, 0)], 1)
        total = np.bincount(rows, size, minlength=n).astype(np.int64)
        ids = np.repeat(out, size)
        if lone.any():
            within = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
            byte = ids < 0
            first = -ids[byte] - np.repeat(size, size)[byte]
            ids[byte] = self.v.byte_ids[text[first + within[byte]]]
        return ids.astype(np.int32), total

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """(codes, distinct segments) of a slice of texts, and where each text's codes begin."""
        raw, offsets = raw_bytes(texts)
        n = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, np.int32), [], np.zeros(n + 1, np.int64)
        sizes = np.diff(offsets)
        full = sizes > 0
        shift = np.cumsum(full)  # a dummy space before each text that is not empty
        padded = np.full(len(raw) + int(shift[-1]), 32, np.uint8)
        padded[np.arange(len(raw)) + np.repeat(shift, sizes)] = raw
        edges = offsets + np.concatenate([[0], shift])
        cut = np.zeros(len(padded) + 1, bool)
        cut[edges] = True
        space = padded == 32
        cut[1:-1] |= space[1:] & ~space[:-1]
        if not self.lines:  # a line break without a piece stays alone, which only shortens segments
            line = padded == 10
            cut[1:-1] |= line[1:] | line[:-1]
        begin = np.flatnonzero(cut[:-1])
        codes, distinct = _ranges(padded, begin, np.append(begin[1:], len(padded)))
        return codes, distinct, np.searchsorted(begin, edges)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; a null text counts as empty and has none."""
        texts = pc.replace_substring(texts, SPACE, " ")  # to the model they are one character
        index: dict[bytes, int] = {}
        cut = []
        for a, b in _runs(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE_BYTES):
            codes, distinct, edges = self._cut(texts.slice(a, b - a))
            known = np.array([index.setdefault(s, len(index)) for s in distinct], np.int64)
            cut.append((known[codes].astype(np.int32), edges))
        ids, at = self.segments(list(index))
        out = []
        for codes, edges in cut:
            count = (at[1:] - at[:-1])[codes]
            total = np.concatenate([[0], np.cumsum(count)])
            pick = np.arange(total[-1]) - np.repeat(total[:-1] - at[:-1][codes], count)
            out.append(list_array(ids[pick], total[edges], pa.int32()))
        return pa.concat_arrays(out) if out else list_array(np.zeros(0, np.int32), np.zeros(1), pa.int32())


def _ranges(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Codes of adjacent ranges."""
    edges = np.append(begin, end[-1:])
    d = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
    return d.indices.to_numpy(), d.dictionary.to_pylist()


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def _equal_runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(x)) + 1
    return zip([0, *cuts], [*cuts, len(x)], strict=True) if len(x) else iter(())


_ENCODERS: dict[int, Encoder] = {}


def _encoder_of(v: Vocabulary) -> Encoder:
    """One per worker and vocabulary."""
    key = hash((tuple(v.pieces), v.ranks.tobytes()))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(v)
    return _ENCODERS[key]


def encode(spark: SparkSession, text: Column, v: Vocabulary) -> Column:
    """array<int> of ids, those of the library's encoder. Null and empty texts give an empty array."""
    bound_batches(spark)
    shipped = spark.sparkContext.broadcast(v)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder_of(shipped.value)
        for texts in batches:
            for i in range(0, len(texts), ROWS):
                yield encoder.encode(texts.slice(i, ROWS))
            release()

    return ids(F.coalesce(text, F.lit("")))


def encode_checked(spark: SparkSession, text: Column, v: Vocabulary) -> Column:
    """struct(ids, round_trip): as ``encode``, and whether the ids decode to the text, in which U+2581 is a space. One worker does both."""
    bound_batches(spark)
    shipped = spark.sparkContext.broadcast(v)

    @F.arrow_udf("ids array<int>, round_trip boolean")
    def checked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, table = _encoder_of(shipped.value), _piece_table(shipped.value)
        for texts in batches:
            for i in range(0, len(texts), CHECKED_ROWS):
                some = texts.slice(i, CHECKED_ROWS)
                ids = encoder.encode(some)
                same = pc.equal(_joined(ids, table), pc.replace_substring(some, SPACE, " "))
                yield pa.StructArray.from_arrays([ids, same], names=["ids", "round_trip"])
                release()

    return checked(F.coalesce(text, F.lit("")))


def _piece_table(v: Vocabulary) -> pa.Array:
    """The bytes of each id, and none for the number after the last."""
    pieces = list(v.pieces)
    for b, i in enumerate(v.byte_ids):
        pieces[i] = bytes([b])
    return pa.array([*pieces, b""], pa.large_binary())


def decode(spark: SparkSession, ids: Column, v: Vocabulary) -> Column:
    """The text of an id array, without the dummy space. Null gives null, an empty array an empty text; ids out of range,
    null or of control pieces add nothing. Bytes that are no UTF-8 become U+FFFD."""
    bound_batches(spark)
    shipped = spark.sparkContext.broadcast(v)

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _piece_table(shipped.value)
        for lists in batches:
            for i in range(0, len(lists), ROWS):
                yield _joined(lists.slice(i, ROWS), table)
            release()

    return texts(ids)


def _joined(lists: pa.ListArray, table: pa.Array) -> pa.Array:
    n = len(table) - 1
    flat = pc.fill_null(lists.flatten(), n)
    parts = table.take(pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, n)), flat, n))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    at = np.concatenate([[0], np.cumsum(sizes)])
    data, edges = b"", np.zeros(1, np.int64)
    if len(parts):
        edges = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
        data = memoryview(parts.buffers()[2]) if parts.buffers()[2] is not None else b""
    edges = edges[at]
    valid = lists.is_valid().to_pylist()
    return pa.array([bytes(data[a:b]).decode("utf-8", "replace").removeprefix(" ") if ok else None for a, b, ok in zip(edges[:-1], edges[1:], valid, strict=True)], pa.string())

"""Operator 2: secrets in whole texts, by fixed patterns and by two character Markov models.

The patterns give the base spans. On long tokens outside of them, a model of random strings and one of ordinary
identifiers (character bigrams, trained from labelled samples) are compared by their log-likelihood ratio. DataFrame
functions only; both models together are one table of 128 x 128 numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns. The word list matches letters in either case.
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = f"""({_WORDS})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # runs of 20 or more; shorter ones would be dropped
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
MIN_VALUE = 6

#: Documents that the Markov models learn from, at most (as expected, by a hash of the id).
SAMPLE_DOCUMENTS = 4000
#: Mean log-likelihood ratio of a character pair, in nats, from which a token counts as random.
THRESHOLD = 0.7
#: Pairs with a letter that a token needs to be judged. Only they count: digits and signs side by side look random in any text, so
#: dates, times and numbers of any length would pass for secrets.
LETTER_PAIRS = 8
#: Weight of a single character's probability in that of a pair.
PRIOR = 4.0

_KINDS = ("assign", "access", "hex", "markov")


def _spans(text: Column, pattern: str, kind: str, keep: Column | None = None) -> Column:
    """Leftmost matches as array of (start, kind number, end); positions are sums of the lengths of pieces and matches."""
    p = F.lit(pattern)
    found, pieces = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)
    rows = F.arrays_zip(F.transform(found, F.length).alias("size"), F.transform(F.slice(pieces, 1, F.size(found)), F.length).alias("gap"), (F.transform(keep, lambda v: F.length(v) >= MIN_VALUE) if keep is not None else F.transform(found, lambda _: F.lit(True))).alias("good"))
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        span = F.struct(start.alias("start"), F.lit(_KINDS.index(kind)).alias("kind"), (start + m["size"]).alias("end"))
        return F.struct((start + m["size"]).alias("at"), F.when(m["good"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)["spans"]
    return F.when(F.regexp_like(text, p), spans).otherwise(empty)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in _KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def labelled_samples(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(text, is_random): values that base patterns found, and the words around them, of about ``sample`` documents at most."""
    n = documents.count()
    part = documents.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < F.lit(1_000_000 if n <= sample else int(1e6 * sample / n))).select(F.coalesce(text_col, F.lit("")).alias("t"))
    values = F.flatten(F.array(*[F.regexp_extract_all("t", F.lit(p), F.lit(g)) for p, g in ((ASSIGN, 2), (ACCESS, 0), (HEX, 0))]))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = F.regexp_extract_all(rest, F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0))
    both = F.concat(F.transform(F.filter(values, lambda v: F.length(v) >= 12), lambda v: F.struct(v.alias("text"), F.lit(True).alias("is_random"))), F.transform(words, lambda v: F.struct(v.alias("text"), F.lit(False).alias("is_random"))))
    return part.select(F.explode(both).alias("s")).select("s.*")


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs (a * 128 + b), random against ordinary.

    A pair's probability is smoothed by its second character's own (weight PRIOR), and that by add-one over the 67 token
    characters and all others as one.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.ascii(F.substring(F.col("text"), i, F.lit(1))) * 128 + F.ascii(F.substring(F.col("text"), i + 1, F.lit(1))))
    counts = samples.where("length(text) > 1").select("is_random", F.explode(pairs).alias("pair")).groupBy("is_random", "pair").count().where("pair between 0 and 16383")
    got = {(r["is_random"], r["pair"]): r["count"] for r in counts.collect()}  # 2 * 128 * 128 rows at most
    first: dict = {}
    last: dict = {}
    for (kind, pair), n in got.items():
        first[kind, pair // 128] = first.get((kind, pair // 128), 0) + n
        last[kind, pair % 128] = last.get((kind, pair % 128), 0) + n
    total = {k: sum(n for (kind, _), n in got.items() if kind is k) for k in (True, False)}

    def log_p(kind: bool, pair: int) -> float:
        alone = (last.get((kind, pair % 128), 0) + 1) / (total[kind] + 68)
        return math.log((got.get((kind, pair), 0) + PRIOR * alone) / (first.get((kind, pair // 128), 0) + PRIOR))

    return [round(log_p(True, p) - log_p(False, p), 4) for p in range(128 * 128)]


def scan(documents: DataFrame, ratios: list[float], threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: its id, ``base`` and ``found`` spans (start, kind, end; code points, end exclusive).

    ``found`` holds the base spans and tokens of 20 or more characters, outside of all base spans, with LETTER_PAIRS pairs of
    characters of which one is a letter at least, whose mean ratio over those pairs is at least ``threshold``. A null text counts as empty and has no spans. Repeated rows each get a row;
    other columns are not carried.
    """
    text = F.col("t")
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    rows = documents.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("t"))
    base = F.concat(_spans(text, ASSIGN, "assign", F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex"))
    rows = rows.select(id_col, "t", F.array_sort(base).alias("base"), _spans(text, TOKEN, "markov").alias("tokens"))

    def is_random(s: Column) -> Column:
        w = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        pairs = F.sequence(F.lit(1), F.length(w) - 1)
        code = lambda i: F.ascii(F.substring(w, i, F.lit(1)))
        letter = lambda c: c.between(65, 90) | c.between(97, 122)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

        def add(acc: Column, i: Column) -> Column:
            counts = letter(code(i)) | letter(code(i + 1))
            ratio = F.get(table, code(i) * 128 + code(i + 1))
            return F.struct((acc["sum"] + F.when(counts, ratio).otherwise(0.0)).alias("sum"), (acc["n"] + counts.cast("int")).alias("n"))

        return F.aggregate(pairs, start, add, lambda acc: (acc["n"] >= LETTER_PAIRS) & (acc["sum"] >= threshold * acc["n"]))

    outside = F.filter("tokens", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    return rows.select(id_col, "base", F.array_sort(F.concat("base", F.filter(outside, is_random))).alias("found"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the base spans' SHA-256 and all spans as text."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == _KINDS.index(k))).cast("long").alias(f"n_{k}")
    return scanned.select(id_col, n("assign"), n("access"), n("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))

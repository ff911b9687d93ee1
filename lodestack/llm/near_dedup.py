"""Operator 8: near-duplicate documents by a signature-coordinate inverted join.

A document is the set of its word shingles; equal sets are one class, represented once. Each class posts itself under the
(coordinate, value) pairs of its MinHash signature. Two classes with at least MATCHES of SIGNATURE equal coordinates must
meet within the SIGNATURE - MATCHES + 1 rarest coordinates of each (prefix), so only those are posted; coordinates that
nobody shares are skipped, and with them classes that have too few shared ones left. Pairs that met are kept if their
signatures agree in MATCHES coordinates, and become links if the full sets are similar enough.

A small posting list gives all its pairs, a long one the pairs with its centre, the member whose values are the most
frequent. After these links have been verified, members of the long lists of one centre that are still in
different components are compared block by block inside tasks that emit links only. So no link between different components
is lost, and copies are never expanded into all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import BROADCAST_ROWS, SPACE_WORDS, Tokens, bound_batches, list_array, materialize, mix, shingle_hashes, slices, small
from lodestack.llm.components import components

SIGNATURE = 64
#: Equal coordinates of a candidate pair. A pair with similarity 0.8 has fewer with a probability of about one in a million.
MATCHES = 36
#: Posting lists up to this length give all their pairs.
SMALL_LIST = 12
#: Members of one verification group.
GROUP = 32
#: Members of a block, when what is left between components of a long list is compared.
BLOCK = 512

_made = np.random.default_rng(20240501).integers(0, 1 << 63, (2, SIGNATURE), np.int64).view(np.uint64)
_TIMES, _PLUS = _made[0] | np.uint64(1), _made[1]


def _sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and offsets. Texts of fewer words: the whole sequence as one."""
    t = Tokens(texts, SPACE_WORDS)
    h = t.hashes()
    g = shingle_hashes(h, shingle)
    owner = t.text_of()
    inside = owner[: len(g)] == owner[shingle - 1 : shingle - 1 + len(g)] if len(g) else np.zeros(0, bool)
    g, doc = g[inside], owner[: len(inside)][inside]
    n = len(t.offsets) - 1
    words = np.diff(t.offsets)
    for size in range(1, shingle):
        short = np.flatnonzero(words == size)
        if len(short):
            whole = shingle_hashes(h, size)[t.offsets[short]] + np.uint64(size)
            g, doc = np.concatenate([g, whole]), np.concatenate([doc, short])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[first], np.searchsorted(doc[first], np.arange(n + 1))


def _signatures(g: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minimum of each coordinate's hash over each set; all zero for empty sets."""
    out = np.zeros((len(offsets) - 1, SIGNATURE), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    for part in np.array_split(full, max(1, len(g) // 50_000)):
        if len(part):
            lo, hi = offsets[part[0]], offsets[part[-1] + 1]
            x, starts = g[lo:hi], offsets[part] - lo
            for j in range(SIGNATURE):
                out[part, j] = np.minimum.reduceat(((x * _TIMES[j] + _PLUS[j]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def signed(documents: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n (set size), two hashes of the set, signature (array of int)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            g, offsets = _sets(b.column("t"), shingle)
            n = np.diff(offsets)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(g + np.uint64(s)), dtype=np.uint64)]) for s in (1, 2)]
            ones, twos = ((s[offsets[1:]] - s[offsets[:-1]]).view(np.int64) for s in sums)
            signature = _signatures(g, offsets).view(np.int32).ravel()
            yield pa.record_batch([b.column("id"), pa.array(n, pa.int64()), pa.array(ones), pa.array(twos), list_array(signature, np.arange(len(n) + 1) * SIGNATURE, pa.int32())], ["id", "n", "set1", "set2", "signature"])

    return documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("t")).mapInArrow(sign, "id long, n long, set1 long, set2 long, signature array<int>")


def _postings(classes: DataFrame) -> DataFrame:
    """(item, cid): the shared coordinates of each class's prefix."""
    item = F.transform("signature", lambda v, i: F.shiftleft(i.cast("long"), 32) + v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    items = classes.where("n > 0").select(F.col("id").alias("cid"), F.explode(item).alias("item"))
    often = items.groupBy("item").agg(F.count("*").alias("often")).where("often > 1")
    own = Window.partitionBy("cid")
    shared = items.join(often, "item").withColumn("m", F.count("*").over(own)).where(F.col("m") >= MATCHES)
    ranked = shared.withColumn("at", F.row_number().over(own.orderBy("often", "item"))).withColumn("weight", F.sum("often").over(own))
    return ranked.where(F.col("at") <= F.col("m") - (MATCHES - 1)).select("item", "cid", "weight")


def _agree(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures have enough equal coordinates."""
    s = classes.select("id", "signature")
    both = pairs.join(s.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
    return both.where(_equal(F.col("sa"), F.col("sb")) >= MATCHES).select("a", "b")


def _equal(x, y):
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda acc, v: acc + v)


def _verified(pairs: DataFrame, documents: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b), distinct, whose full sets are similar: 100 * intersection >= percent * union.

    The texts of up to GROUP partners follow their ``a`` in one sorted run of a partition.
    """
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("salts"))
    salted = pairs.join(size, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b")
    members = salted.unionByName(salted.select("a", "salt", F.col("a").alias("b"))).distinct()
    members = materialize(members, "members")
    texts = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("b"), F.coalesce(text_col, F.lit("")).alias("t"))
    runs = texts.join(small(members, BROADCAST_ROWS), "b").repartition("a", "salt").withColumn("second", F.col("a") != F.col("b")).sortWithinPartitions("a", "salt", "second")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left = None, None
        for b in batches:
            g, offsets = _sets(b.column("t"), shingle)
            first, salt, second = (b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "salt", "b"))
            good = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                own = g[offsets[i] : offsets[i + 1]]
                if first[i] == second[i]:
                    key, left = (first[i], salt[i]), own
                elif key == (first[i], salt[i]):
                    both = len(np.intersect1d(left, own, assume_unique=True))
                    good[i] = 100 * both >= percent * (len(left) + len(own) - both)
            at = np.flatnonzero(good)
            yield pa.record_batch([pa.array(first[at], pa.int64()), pa.array(second[at], pa.int64())], ["a", "b"])

    return runs.select("a", "salt", "b", "t").mapInArrow(similar, "a long, b long")


def _between_components(rest: DataFrame, documents: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between members of one (centre, size, cid, component) list that are in different components.

    A list is cut into blocks, and each pair of blocks compared in one task, which emits links only.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = rest.withColumns({"own": F.pmod(F.xxhash64("cid"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    members = materialize(own.select("centre", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", F.col("cid").alias("b"), "component"), "members")
    texts = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("b"), F.coalesce(text_col, F.lit("")).alias("t"))

    def compare(t: pa.Table) -> pa.Table:
        g, offsets = _sets(t.column("t"), shingle)
        signature, n = _signatures(g, offsets), np.diff(offsets)
        name, component, block = (t.column(c).to_numpy() for c in ("b", "component", "own"))
        out: list[tuple[int, int]] = []
        for i in np.flatnonzero(block == t.column("x")[0].as_py()):
            others = np.flatnonzero((block == t.column("y")[0].as_py()) & (component != component[i]))
            others = others[(signature[others] == signature[i]).sum(1) >= MATCHES]
            others = others[100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])]
            if len(others):
                own = g[offsets[i] : offsets[i + 1]]
                at = np.repeat(offsets[others], n[others]) + np.arange(n[others].sum()) - np.repeat(np.cumsum(n[others]) - n[others], n[others])
                inside = own[np.minimum(np.searchsorted(own, g[at]), len(own) - 1)] == g[at]
                both = np.add.reduceat(inside.astype(np.int64), np.cumsum(n[others]) - n[others])
                good = others[100 * both >= percent * (n[i] + n[others] - both)]
                _, first = np.unique(component[good], return_index=True)  # one link between two components is enough
                out += [(name[i], name[j]) for j in good[first]]
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    run = texts.join(small(members, BROADCAST_ROWS), "b")
    return run.groupBy("centre", "x", "y").applyInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc id, n_shingles, component_id (smallest id reachable) and kept (it is the smallest).

    Ids are integers. Null and empty texts have no shingles and are linked with nothing; so are rows with a null id, whose
    component_id is null and which are kept. Texts of fewer words than a shingle are one shingle. Repeated rows each get
    their row, and are all kept if their id is the smallest. Rows that share an id but not the text are compared by their
    own sets, and by both in a verification. Other columns are not carried. No documents give no rows.
    """
    bound_batches(documents.sparkSession)
    table = materialize(signed(documents, shingle, id_col, text_col), "signed")
    named = table.where("id is not null and n > 0")
    classes = materialize(named.groupBy("n", "set1", "set2").agg(F.min("id").alias("id"), F.first("signature").alias("signature")), "classes")
    posted = materialize(_postings(classes), "postings")
    lists = posted.groupBy("item").agg(F.count("*").alias("size"), F.max(F.struct("weight", (-F.col("cid")).alias("cid"))).alias("top")).where("size > 1").select("item", "size", (-F.col("top.cid")).alias("centre"))
    listed = posted.join(lists, "item")
    few = listed.where(F.col("size") <= SMALL_LIST).groupBy("item").agg(F.array_sort(F.collect_set("cid")).alias("c"))
    pairs_of = F.flatten(F.transform("c", lambda x, i: F.transform(F.slice(F.col("c"), i + 2, F.greatest(F.size("c") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = few.select(F.explode(pairs_of).alias("p")).select("p.a", "p.b").unionByName(listed.where((F.col("size") > SMALL_LIST) & (F.col("cid") != F.col("centre"))).select(F.col("centre").alias("a"), F.col("cid").alias("b")))
    pairs = materialize(_agree(pairs.distinct(), classes), "pairs")
    links = materialize(_verified(pairs, documents, shingle, percent, id_col, text_col), "links")
    found = materialize(components(links), "components")

    # long lists around one centre whose members are in several components yet
    around = listed.where(F.col("size") > SMALL_LIST).select("centre", "cid").distinct()
    where = around.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    several = where.groupBy("centre").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("centre", "size")
    rest = materialize(where.join(several, "centre"), "rest")
    if not rest.isEmpty():
        more = materialize(_between_components(rest, documents, shingle, percent, id_col, text_col), "links")
        if not more.isEmpty():
            found = materialize(components(links.unionByName(more)), "components")

    of_class = classes.select("n", "set1", "set2", F.col("id").alias("cid")).join(found.withColumnRenamed("node", "cid"), "cid", "left").select("n", "set1", "set2", F.coalesce("component", "cid").alias("component"))
    out = table.join(of_class, ["n", "set1", "set2"], "left").withColumn("component", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))

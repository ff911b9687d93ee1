"""Operator 12: a Merkle manifest of a dataset, with a witness for each row, built by incremental witnesses.

Rows of one tree are its leaves, in order. ``Frontier`` takes them one by one, as a log is appended to: complete subtrees
whose right sibling is still to come stay open, each with the partial witnesses of its leaves; when the sibling is complete,
its root extends the witnesses of the left half, and the left root those of the right half. A tree is cut into aligned blocks
of 2**LOG leaves, which tasks build independently; the roots of the blocks are in turn appended to a tree of blocks, and so on,
until each tree is one block. A leaf's witness is its block's, then that of the block's root among the blocks above. The roots
of all trees are, in order, the leaves of one more tree, whose root stands for the dataset.

Every two consecutive nodes become the hash of both; a last node without a partner becomes the hash of itself alone. So where
a sibling stands, and whether there is one, follows from position and size, and a witness is nothing but digests.

Positions come from a range sort: counts of each tree in each sorted partition are summed, so no task sees a whole tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lodestack.llm.common import BROADCAST_ROWS, bound_batches, materialize, small

#: Logarithm of a block's leaves: the most that one group holds.
LOG = 12
BYTES = 32


def node_of(*parts: bytes) -> bytes:
    """The digest of digests, which are hashed as lower-case hex text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


class Frontier:
    """The open subtrees of an append-only tree, tallest first, and the witnesses of all leaves so far."""

    def __init__(self) -> None:
        self.open: list[tuple[int, bytes, list[int]]] = []
        self.witnesses: list[list[bytes]] = []

    def append(self, digest: bytes, height: int = 0) -> None:
        """The next complete subtree of 2**height leaves, as one member; heights never rise above the last open one."""
        members = [len(self.witnesses)]
        self.witnesses.append([])
        self._complete(height, digest, members)

    def _complete(self, height: int, digest: bytes, members: list[int]) -> None:
        while self.open and self.open[-1][0] == height:
            _, left, before = self.open.pop()
            for m in before:
                self.witnesses[m].append(digest)
            for m in members:
                self.witnesses[m].append(left)
            height, digest, members = height + 1, node_of(left, digest), before + members
        self.open.append((height, digest, members))

    def close(self, height: int | None = None) -> bytes:
        """The root when nothing follows: nodes without a partner are hashed alone, until one node is left, of ``height`` if given."""
        while len(self.open) > 1 or height is not None and self.open[-1][0] < height:
            at, digest, members = self.open.pop()
            self._complete(at + 1, node_of(digest), members)
        return self.open[0][1]


def fold(node: bytes, pos: int, size: int, witness: bytes) -> bytes:
    """The root that a leaf at ``pos`` of ``size`` and its witness give."""
    at = 0
    while size > 1:
        if pos ^ 1 < size:
            other = witness[at : at + BYTES]
            at += BYTES
            node = node_of(other, node) if pos & 1 else node_of(node, other)
        else:
            node = node_of(node)
        pos, size = pos >> 1, size + 1 >> 1
    return node


@F.arrow_udf(BinaryType())
def folded(node: pa.Array, pos: pa.Array, size: pa.Array, witness: pa.Array) -> pa.Array:
    """``fold``, by rows."""
    rows = zip(node.to_pylist(), pos.to_pylist(), size.to_pylist(), witness.to_pylist(), strict=True)
    return pa.array([fold(*r) for r in rows], pa.binary())


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with pos (within the tree, by ``order``) and size (of the tree)."""
    sorted_ = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("mid", F.monotonically_increasing_id())
    ordered = materialize(sorted_.withColumn("part", F.shiftright("mid", 33)), "ordered")
    by_tree = Window.partitionBy("tree")
    before = by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = ordered.groupBy("tree", "part").agg(F.min("mid").alias("first"), F.count("*").alias("n"))
    runs = runs.select("tree", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(by_tree).alias("size"))
    joined = ordered.join(small(materialize(runs, "runs"), BROADCAST_ROWS), ["tree", "part"])
    return joined.withColumn("pos", F.col("before") + F.col("mid") - F.col("first")).drop("mid", "part", "first", "before")


def _blocks(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, pos, size, digest and others) with block, the witness within it, and at its first node the block's root."""

    def build(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        tree = Frontier()
        for digest in block.column("digest").to_pylist():
            tree.append(digest)
        root = tree.close(LOG if block.column("size")[0].as_py() > 1 << LOG else None)
        block = block.append_column("witness", pa.array([b"".join(w) for w in tree.witnesses], pa.binary()))
        return block.append_column("block_root", pa.array([root] + [None] * (len(block) - 1), pa.binary()))

    keyed = nodes.withColumn("block", F.shiftright("pos", LOG))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields)
    return keyed.groupBy("tree", "block").applyInArrow(build, f"{schema}, witness binary, block_root binary")


def witnessed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree string, pos, size, digest binary, and others) with witness and root (binary) of each.

    Blocks are built level by level; the number of rounds is that of the digits of the largest tree in base 2**LOG.
    """
    built = materialize(_blocks(nodes), "blocks")
    roots = built.where("block_root is not null").select("tree", F.col("block").alias("pos"), F.ceil(F.col("size") / (1 << LOG)).cast("long").alias("size"), F.col("block_root").alias("digest"))
    if roots.where("size > 1").isEmpty():
        above = roots.select("tree", F.col("pos").alias("block"), F.lit(b"").alias("upper"), F.col("digest").alias("root"))
    else:
        above = witnessed(roots).select("tree", F.col("pos").alias("block"), F.col("witness").alias("upper"), "root")
    joined = built.drop("block_root").join(small(materialize(above, "above"), BROADCAST_ROWS), ["tree", "block"])
    return joined.withColumn("witness", F.concat("witness", "upper")).drop("block", "upper")


def leaf_text(columns: list[Column]) -> Column:
    """A row as text, without ambiguity: each value as its UTF-8 byte count, a colon and itself, or - if it is null."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def leaf_of(columns: list[Column]) -> Column:
    """The digest (binary) of a row's values."""
    return F.unhex(F.sha2(leaf_text(columns).cast("binary"), 256))


def manifest(rows: DataFrame, tree: Column, order: Column, leaf: Column, carried: dict[str, Column]) -> DataFrame:
    """One row per row: the ``carried`` columns, leaf, pos, size, witness, subroot, root (binary), tree_pos, tree_size and tree_witness.

    Rows are grouped into trees by ``tree`` (nulls are a tree of their own, the first; others by UTF-8 bytes) and stand in each by
    ``order`` (nulls first), ties by leaf. Rows that repeat are leaves of their own, next to each other. A tree of one row has
    its leaf as root, a dataset of one tree that tree's; no rows give none. Texts are hashed where they are read; only digests move.
    """
    named = {f"c_{k}": c for k, c in carried.items()}
    key = F.when(tree.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), tree.cast("string")))
    leaves = rows.select(key.alias("tree"), order.alias("ord"), leaf.alias("digest"), F.monotonically_increasing_id().alias("row"), *[c.alias(k) for k, c in named.items()])
    leaves = _placed(materialize(leaves, "leaves"), ["ord", "digest", "row"]).drop("row", "ord")
    within = materialize(witnessed(leaves), "witnesses")
    subroots = within.where("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    top = witnessed(_placed(materialize(subroots, "subroots"), ["name"]))
    top = small(materialize(top.select(F.col("name").alias("tree"), F.col("pos").alias("tree_pos"), F.col("size").alias("tree_size"), F.col("witness").alias("tree_witness"), F.col("root").alias("dataset_root")), "top"), BROADCAST_ROWS)
    return within.withColumnRenamed("root", "subroot").join(top, "tree").select(
        *[F.col(k).alias(k.removeprefix("c_")) for k in named], F.col("digest").alias("leaf"), "pos", "size", "witness", "subroot", F.col("dataset_root").alias("root"), "tree_pos", "tree_size", "tree_witness",
    )


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def verified(made: DataFrame, claim: Column) -> DataFrame:
    """``made`` (of ``manifest``) with folded_root: the root that the claimed leaf gives with the row's witness."""
    bound_batches(made.sparkSession)
    inner = made.withColumn("folded_root", folded(claim, "pos", "size", "witness"))
    return inner.withColumn("folded_root", folded("folded_root", "tree_pos", "tree_size", "tree_witness"))


def digests(made: DataFrame) -> Iterator[Column]:
    """leaf, subroot, root as hex text, and the digest of all siblings from leaf to root."""
    yield from (hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root"))
    yield F.sha2(hexed(F.concat("witness", "tree_witness")).cast("binary"), 256).alias("proof_sha256")

"""Merkle manifests of datasets: trees of rows by group, a tree of the groups' roots above them, and proofs.

Rows of a group are leaves in a given order. While a level has several nodes, every eight consecutive ones become one node,
the SHA-256 of their digests (lower-case hexadecimal text, one after another); the last run may have fewer, even one. What
remains is the group's subroot (a lone leaf is its own). Subroots in order of their group form a tree in the same way.

How many children a parent has follows from the size of its level, so that a parent can be built wherever its children
meet. Tasks take leaves as events: each goes into its partial parent, kept by place; when a parent's arity is met its node is
sent on as an event of the level above, and so forth. A task that ends hands over the children of what it couldn't finish:
its frontier. Frontiers are dealt by the ancestor that covers them all and folded again, until none is left. A task holds
at most `held` partial parents; beyond that it hands over all of them early.

Finished parents keep their children's digests. These reverse links, followed from the roots down, give each node its
proof: the places and siblings on its way up. A group that holds most rows is many ranges of leaves as any other.

Groups may be null (first). Rows that are equal in the order are leaves of their own, in no particular order, which matters
only where their digests differ (give them the digest as last order). No rows, no tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import written
from .order import ranked

ARITY = 8
BITS = 3
NODES = "done boolean, grp string, level int, idx long, size long, digest string, children array<string>"
PROOF = "array<struct<pos:int,siblings:array<string>>>"


def field(value: Column) -> Column:
    """A value as hashed: `-` if null, else its length in UTF-8 bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """SHA-256 in lower-case hexadecimal of texts one after another."""
    return F.sha2(F.concat(*values).cast("binary"), 256)


def nodes_at(size: int, level: int) -> int:
    """How many nodes a tree of `size` leaves has at a level."""
    return -(-size // (1 << BITS * level))


def fold(held: int = 1 << 16):
    """A task's events: nodes in, finished parents and the frontier out. Nodes in order keep one partial parent open a level,
    so that 64 are enough for any tree."""
    held = max(held, 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial: dict[tuple, dict[int, str]] = {}
        out: list[tuple] = []

        def take(grp: str | None, level: int, idx: int, size: int, own: str) -> None:
            while nodes_at(size, level) > 1:
                key = (grp, level + 1, idx >> BITS, size)
                children = partial.setdefault(key, {})
                children[idx & (ARITY - 1)] = own
                if len(children) < min(ARITY, nodes_at(size, level) - (idx >> BITS) * ARITY):
                    return
                del partial[key]
                level, idx = level + 1, idx >> BITS
                links = [children[i] for i in range(len(children))]
                own = hashlib.sha256("".join(links).encode()).hexdigest()
                out.append((True, grp, level, idx, size, own, links))

        def frontier() -> None:
            for (grp, level, idx, size), children in partial.items():
                out.extend((False, grp, level - 1, idx * ARITY + i, size, own, None) for i, own in children.items())
            partial.clear()

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["done", "grp", "level", "idx", "size", "digest", "children"])
            out.clear()
            return made

        for rows in batches:
            for node in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                take(*node)
                if len(partial) > held:
                    frontier()
            if out:
                yield batch()
        frontier()
        if out:
            yield batch()

    return run


def parents(leaves: DataFrame, held: int = 1 << 16) -> DataFrame:
    """All inner nodes (grp, level from 1, idx, size, digest, children) of the trees whose leaves are (grp, idx, size, digest)."""
    events = leaves.select("grp", F.lit(0).alias("level"), "idx", "size", "digest")
    told = written(events.mapInArrow(fold(held), NODES), "merkle-nodes")
    every, top = told.where("done"), None
    while True:
        opened = told.where(~F.col("done"))
        highest = opened.agg(F.max("level")).first()[0]
        if highest is None:
            return every.drop("done")
        # all that a parent lacks lies under the same ancestor; later rounds climb four levels at a time
        top = highest + 1 if top is None else max(highest + 1, top + 4)
        above = F.expr(f"shiftright(idx, {BITS} * ({top} - level))")
        # in order of the leaves below, so that parents are finished one after another
        first = F.expr(f"shiftleft(idx, {BITS} * level)")
        dealt = opened.select("grp", "level", "idx", "size", "digest").repartition("grp", above).sortWithinPartitions("grp", first)
        told = written(dealt.mapInArrow(fold(held), NODES), "merkle-nodes")
        every = every.unionByName(told.where("done"))


def subroots(leaves: DataFrame, inner: DataFrame) -> DataFrame:
    """(grp, root) of every tree: the node of a level that has no other, a lone leaf where there is no level above."""
    last = inner.where(F.col("size") <= F.expr(f"shiftleft(1L, {BITS} * level)")).select("grp", "level", "size", F.col("digest").alias("root"))
    return last.unionByName(leaves.where("size = 1").select("grp", F.lit(0).alias("level"), "size", F.col("digest").alias("root")))


def _below(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """nodes (grp, idx, ...) with the proof, subroot and root that their parents in `above` hand down. A stand-in above a
    tree's top node hands on the proof that it holds; a true parent puts the node's siblings before its own proof."""
    up = above.select(F.col("grp").alias("__grp"), F.col("idx").alias("__idx"), F.col("children").alias("__children"), "only", "proof", "subroot", "root")
    both = nodes.join(up, F.col("grp").eqNullSafe(F.col("__grp")) & (F.shiftright("idx", BITS) == F.col("__idx")))
    pos = F.col("idx").bitwiseAND(ARITY - 1).cast("int")
    others = F.concat(F.slice("__children", F.lit(1), pos), F.slice("__children", pos + 2, F.lit(ARITY)))
    step = F.array(F.struct(pos.alias("pos"), others.alias("siblings")))
    proof = F.when(F.col("only"), F.col("proof")).otherwise(F.concat(step, "proof")).cast(PROOF)
    return both.select(*nodes.columns, proof.alias("proof"), "subroot", "root")


def handed_down(leaves: DataFrame, inner: DataFrame, tops: DataFrame) -> DataFrame:
    """leaves (grp, idx, size, ...) with proof, subroot and root. tops: (grp, level, proof, subroot, root), one row a tree:
    what a tree's top node, at that level, has above it."""
    stand_in = tops.select("grp", (F.col("level") + 1).alias("level"), F.lit(0).cast("long").alias("idx"), F.array().cast("array<string>").alias("children"), F.lit(True).alias("only"), "proof", "subroot", "root")
    highest = tops.agg(F.max("level")).first()[0]
    if highest is None:
        return _below(leaves, stand_in)
    above = stand_in.where(F.col("level") == highest + 1).drop("level")
    for level in range(highest, 0, -1):
        own = _below(inner.where(F.col("level") == level).select("grp", "idx", "children"), above)
        above = own.withColumn("only", F.lit(False)).select(*above.columns).unionByName(stand_in.where(F.col("level") == level).drop("level"))
    return _below(leaves, above)


def manifest(rows: DataFrame, grp: Column, order: list[Column], leaf: Column, held: int = 1 << 16) -> DataFrame:
    """row (a struct of all columns of rows), leaf, proof (from the leaf up to the root: place and siblings of each run),
    subroot and root of every row. Leaves of a group ascend by `order`, nulls first, then by `leaf`."""
    keys = {f"by{i}": o for i, o in enumerate(order)}
    named = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), grp.cast("string").alias("grp"), leaf.alias("digest"), *(o.alias(k) for k, o in keys.items()))
    placed = ranked(named, ["grp"], [*(F.asc_nulls_first(k) for k in keys), F.asc("digest")], "idx", "size")
    placed = written(placed.select("row", "grp", "idx", "size", "digest"), "merkle-leaves")
    inner = written(parents(placed, held), "merkle-inner")
    ends = written(subroots(placed, inner), "merkle-subroots")
    # the tree of subroots: one group, its leaves in order of their groups
    top = ranked(ends.select(F.col("grp").alias("of"), F.col("level").alias("height"), F.col("root").alias("digest")), [], [F.asc_nulls_first("of")], "idx", "size")
    top = written(top.withColumn("grp", F.lit(None).cast("string")), "merkle-tops")
    upper = written(parents(top, held), "merkle-upper")
    crown = subroots(top, upper).select("grp", "level", F.array().cast(PROOF).alias("proof"), F.col("root").alias("subroot"), "root")
    tops = handed_down(top, upper, crown).select(F.col("of").alias("grp"), F.col("height").alias("level"), "proof", F.col("digest").alias("subroot"), "root")
    return handed_down(placed, inner, written(tops, "merkle-crowns")).select("row", F.col("digest").alias("leaf"), "proof", "subroot", "root")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""

    def up(own: Column, step: Column) -> Column:
        left, right = F.slice(step["siblings"], F.lit(1), step["pos"]), F.slice(step["siblings"], step["pos"] + 1, F.lit(ARITY))
        return F.sha2(F.concat(F.array_join(left, ""), own, F.array_join(right, "")).cast("binary"), 256)

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, one after another."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: s["siblings"])), "").cast("binary"), 256)

"""Near duplicates by an exact prefix-tree join on sets of word shingles.

Sets are ordered by one global order: shingles known to be frequent last, by frequency, all others by hash.
Two sets at the threshold must share one of their first n - ceil(t n) + 1 shingles. Equal sets are one node.
Nodes that share a prefix shingle form a group; groups of the same nodes count once, under their first
shingle.

The joins run in blocks of bounded size. Members' ordered shingles are stored in a trie whose edges hold runs
of shingles; a probe walks it, so that members with a common start share their partial overlap, and leaves a
subtree as soon as overlap plus what can still come on either side misses the threshold for its shortest
set. Candidates are walked on prefixes alone (what comes after the prefix is counted as if it were common),
then on whole sets.

First each group's leader is held against the others that share enough prefix shingles with it, and the components of
those links are contracted. The leader is the node that holds the largest share of frequent shingles, which of a group of near
copies is one that lies amid them; ties go by a hash of the set. Nodes are known by a row number and texts by their hashes: what a
join costs doesn't hang on ids, nor on the order of rows. Only groups that still hold two components are joined, block
by block: a pair is met in the group of its first common shingle, and pairs between components are checked
in rounds, a few for each node and component first, those left only while their sides are still apart. So a
large group of near copies costs about one walk a member, and no link that joins two components is lost.

Joins of which both sides grow with the documents are merge joins at every size, so that a small table goes the way of a large one.

Shingles are 62-bit hashes of five words (of the whole sequence where there are fewer). Null and empty texts
have no shingles and link with nothing. Repeated rows and equal texts are one node. Rows without doc_id take part and are
answered: their component is that of the smallest doc_id they reach, null if there is none. One doc_id may stand for several
texts; each is a document of its own. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import small_batches, text_blocks, written
from .components import components

HEAVY = 1 << 62
MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


@dataclass(frozen=True)
class Params:
    words: int = 5
    percent: int = 80
    heavy: int = 1 << 17
    heavy_from: int = 2
    block: int = 256
    flush: int = 1 << 21
    chars: int = 1 << 20
    bits: int = 2048
    broadcast: int = 1 << 20
    first_checks: int = 2


_POWERS: dict[str, np.ndarray] = {}
BASE = 0x9E3779B97F4A7C55
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = n + (n >> 2) + 1
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, one after another, and how many words each text has.

    A word's hash is a polynomial over its bytes, taken from one running sum over all bytes."""
    data = [(t or "").encode().lower() for t in texts]
    raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    ends = np.cumsum([len(d) + 1 for d in data])
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, stop = edge[::2], edge[1::2]
    up, down = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    h = _mixed((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return h, np.diff(np.searchsorted(start, ends), prepend=0)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct 62-bit hashes of its k-word shingles."""
    h, sizes = word_hashes(texts)
    x = np.full(max(0, len(h) - k + 1), k, np.uint64)
    for i in range(k):
        x = _mixed(x + h[i : len(h) - k + 1 + i] * MULT[i % 5])
    x = (x >> np.uint64(2)).astype(np.int64)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= k:
            out.append(np.unique(x[at : at + n - k + 1]))
        elif n:
            y = np.full(1, n, np.uint64)
            for i in range(n):
                y = _mixed(y + h[at + i : at + i + 1] * MULT[i % 5])
            out.append((y >> np.uint64(2)).astype(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        at += n
    return out


def set_bits(s: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of the set. Two sets' bitmaps differ in no more bits than the sets in members."""
    at = (s & (bits - 1)).astype(np.int64)
    out = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out.view(np.int64)


def ordered(s: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The set's keys in the global order: the hash, or HEAVY + rank by frequency."""
    keys, ranks = heavy
    if not len(keys) or not len(s):
        return s
    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    hit = keys[at] == s
    return np.sort(np.where(hit, HEAVY + ranks[at], s)) if hit.any() else s


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def heavy_shingles(docs: DataFrame, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and ranks of the most frequent shingles; the table is bounded by p.heavy. Any choice
    gives the same links: the order only has to be the same everywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= p.heavy_from
            return pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(n[keep])], names=["h", "n"])

        for batch in batches:
            for block in text_blocks(batch.column(0), p.chars):
                held += shingle_sets(block, p.words)
                size += sum(map(len, held[-len(block) :]))
                if size > p.flush:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    rows = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = rows.orderBy(F.col("n").desc(), "h").limit(p.heavy).toArrow()
    keys, n = top["h"].to_numpy(), top["n"].to_numpy()
    by = np.lexsort((keys, n))
    ranks = np.empty(len(keys), np.int64)
    ranks[by] = np.arange(len(keys))
    order = np.argsort(keys)
    return keys[order], ranks[order]


ENTRIES = "doc_id long, t1 long, t2 long, n long, fa long, fb long, prefix array<long>, bits array<long>, rank long"


def _entries(shared, p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            rows = []
            for s in (s for block in text_blocks(batch.column(3), p.chars) for s in shingle_sets(block, p.words)):
                n = len(s)
                if not n:
                    rows.append((0, 0, 0, None, None, None))
                    continue
                data = s.tobytes()
                a, b = (xxhash.xxh3_64_intdigest(data, seed) - (1 << 63) for seed in (1, 2))
                prefix = bits = rank = None
                if (a, b) not in seen:
                    seen.add((a, b))
                    keys = ordered(s, shared.value)
                    prefix, bits = keys[: prefix_size(n, p.percent)], set_bits(s, p.bits)
                    # the share of frequent shingles, then a hash of the set
                    rank = ((n - int(np.searchsorted(keys, HEAVY))) * 1023 // n << 52) + (a & (1 << 52) - 1)
                rows.append((n, a, b, prefix, bits, rank))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "t1", "t2", "n", "fa", "fb", "prefix", "bits", "rank"])

    return run


def _sets(shared, p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [ordered(s, shared.value).tobytes() for block in text_blocks(batch.column(1), p.chars) for s in shingle_sets(block, p.words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "keys"])

    return run


class Trie:
    """Ordered lists (dense, rising shingle numbers) as a radix tree; each node knows its subtree's set sizes,
    its longest list and the one component that holds its subtree, if there is one."""

    __slots__ = ("edge", "depth", "kids", "ends", "low", "high", "longest", "comp")

    def __init__(self, items: list[int], lists: list[np.ndarray], sizes: list[int], comps: list, start: int) -> None:
        first, last = lists[items[0]], lists[items[-1]]
        n = min(len(first), len(last))
        differ = np.flatnonzero(first[start:n] != last[start:n])
        self.depth = start + int(differ[0]) if len(differ) else n
        self.edge = first[start : self.depth]
        own = [sizes[i] for i in items]
        self.low, self.high = min(own), max(own)
        self.longest = max(len(lists[i]) for i in items)
        self.comp = comps[items[0]] if all(comps[i] == comps[items[0]] for i in items) else None
        self.ends = [i for i in items if len(lists[i]) == self.depth]
        self.kids, group = [], []
        for i in items:
            if len(lists[i]) == self.depth:
                continue
            if group and lists[group[0]][self.depth] != lists[i][self.depth]:
                self.kids.append(Trie(group, lists, sizes, comps, self.depth))
                group = []
            group.append(i)
        if group:
            self.kids.append(Trie(group, lists, sizes, comps, self.depth))


def walk(root: Trie, x: np.ndarray, n: int, has: np.ndarray, sizes: list[int], percent: int, unseen, first: int, skip) -> Iterator[int]:
    """Members that can be linked with the probe (list x, set size n). has marks x's shingles; unseen(n) is how
    many shingles of a set of n the lists leave out; first must be the first in common, unless it is -1;
    skip(component, None) and skip(None, member) say what needn't be looked at."""
    todo = [(root, 0)]
    while todo:
        node, overlap = todo.pop()
        if 100 * node.high < percent * n or percent * node.low > 100 * n or node.comp is not None and skip(node.comp, None):
            continue
        if len(node.edge):
            hits = has[node.edge]
            got = int(np.count_nonzero(hits))
            if got and not overlap and first >= 0 and node.edge[int(hits.argmax())] != first:
                continue
            overlap += got
            left = len(x) - int(np.searchsorted(x, node.edge[-1], side="right"))
            most = overlap + min(left, node.longest - node.depth) + unseen(max(n, node.high))
            if (100 + percent) * most < percent * (n + node.low):
                continue
        for i in node.ends:
            m = sizes[i]
            if overlap and (100 + percent) * (overlap + unseen(max(n, m))) >= percent * (n + m) and not skip(None, i):
                yield i
        todo += [(kid, overlap) for kid in node.kids]


def block_pairs(nodes: list[int], lists: list[np.ndarray], sizes: list[int], comps: list, probes: list[int], members: list[int], p: Params, token: int | None, rising: bool, every_link: bool = False) -> list[tuple[int, int]]:
    """Pairs of probes and members (places in nodes) of different components. With a token the lists are
    prefixes and all pairs that may be linked come out; without, they are whole sets, and only as many links
    as are needed to connect what they connect. With every_link components don't count: no pair is passed over."""
    flat = np.concatenate(lists)
    every, dense = np.unique(flat, return_inverse=True)
    lists = np.split(dense, np.cumsum([len(k) for k in lists])[:-1])
    first, unseen = -1, lambda n: 0
    if token is not None:
        first = int(np.searchsorted(every, token))
        unseen = lambda n: n - prefix_size(n, p.percent)
    parent = {c: c for c in comps}

    def find(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    members = sorted(members, key=lambda i: lists[i].tolist())
    root = Trie(members, lists, sizes, comps, 0)
    has, out = np.zeros(len(every), bool), []
    for i in probes:
        x = lists[i]
        has[x] = True

        def skip(comp, member, i=i):
            if member is None:
                return not every_link and find(comp) == find(comps[i])
            return member == i or rising and nodes[member] < nodes[i] or not every_link and find(comps[member]) == find(comps[i])

        for j in walk(root, x, sizes[i], has, sizes, p.percent, unseen, first, skip):
            out.append((nodes[i], nodes[j]))
            if token is None and not every_link:
                parent[find(comps[j])] = find(comps[i])
        has[x] = False
    return out


EDGES = "a long, b long"


def _frame(pairs: list) -> pd.DataFrame:
    return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")


def _candidates(p: Params, every_link: bool = False):
    """Over rows sorted by group: the pairs of each group that prefixes and bitmaps leave."""

    def group(token: int, row: int, col: int, rows: list[tuple]) -> list[tuple[int, int]]:
        probes = [i for i, r in enumerate(rows) if r[5]]
        members = [i for i, r in enumerate(rows) if r[6]]
        if not probes or not members:
            return []
        nodes, sizes = [r[0] for r in rows], [r[1] for r in rows]
        pairs = block_pairs(nodes, [r[3] for r in rows], sizes, [r[2] for r in rows], probes, members, p, token, row == col, every_link)
        by = {r[0]: r for r in rows}

        def fits(a: tuple, b: tuple) -> bool:
            differ = int(np.bitwise_count(a[4] ^ b[4]).sum())
            return (100 + p.percent) * (a[1] + b[1] - differ) >= 2 * p.percent * (a[1] + b[1])

        return [(a, b) for a, b in pairs if fits(by[a], by[b])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_pylist() for i in range(7)]
            lists, bits = (batch.column(i) for i in (7, 8))
            flat, cut = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            maps = bits.flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            for i, (token, row, col, node, n, comp, sides) in enumerate(zip(*cols, strict=True)):
                if (token, row, col) != key:
                    if len(rows) > 1:
                        out += group(*key, rows)
                    key, rows = (token, row, col), []
                rows.append((node, n, comp, flat[cut[i] : cut[i + 1]], maps[i], sides & 1, sides & 2))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if len(rows) > 1 and (out := group(*key, rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


def _check(p: Params, every_link: bool = False):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lists = [np.frombuffer(k, np.int64) for k in rows["keys"]]
        probes, members = (np.flatnonzero(rows["probe"] == c).tolist() for c in (True, False))
        if not probes or not members:
            return _frame([])
        return _frame(block_pairs(rows["node"].tolist(), lists, [len(x) for x in lists], rows["comp"].tolist(), probes, members, p, None, False, every_link))

    return run


def text_hashes(text: Column) -> tuple[Column, Column]:
    """Two hashes that name a text, whatever its row's id."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def with_hashes(docs: DataFrame) -> DataFrame:
    t1, t2 = text_hashes(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), "text")


def _checked(pairs: DataFrame, docs: DataFrame, places: DataFrame, heavy, p: Params, every_link: bool = False) -> DataFrame:
    """The links among pairs (a, ca, b, cb), by walking whole sets: a probes the b's in blocks. places (node, doc_id, t1, t2) says
    which rows of docs hold a node's text."""
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ids = written(places.join(ids, "node").select("node", F.col("doc_id").alias("of"), F.col("t1").alias("h1"), F.col("t2").alias("h2")), "nd-ids")
    # broadcast below a fixed number of ids, shuffled beyond
    wanted = F.broadcast(ids) if ids.count() <= p.broadcast else ids
    text = docs.join(wanted, (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2")) & F.col("doc_id").eqNullSafe(F.col("of")))
    sets = text.select("node", "text").mapInArrow(_sets(heavy, p), "node long, keys binary").groupBy("node").agg(F.min("keys").alias("keys"))
    sets = written(sets, "nd-sets")
    sizes = pairs.groupBy("a", "ca").agg(F.ceil(F.count("*") / p.block).cast("int").alias("blocks"))
    members = pairs.join(sizes.drop("ca"), "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.col("b").alias("node"), F.col("cb").alias("comp"), F.lit(False).alias("probe")
    )
    probes = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("a").alias("node"), F.col("ca").alias("comp"), F.lit(True).alias("probe"))
    return written(members.unionByName(probes).join(sets.hint("merge"), "node").groupBy("a", "block").applyInPandas(_check(p, every_link), EDGES), "nd-links")


def clusters(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document."""
    return grouped(docs, p).select("doc_id", "n_shingles", "component_id")


@dataclass(frozen=True)
class Prepared:
    """What the joins start from: texts by their hashes, entries (a row each document), nodes (a row each different set), groups
    (a row each node and prefix shingle that another has)."""

    docs: DataFrame
    heavy: object
    entries: DataFrame
    nodes: DataFrame
    groups: DataFrame

    @property
    def places(self) -> DataFrame:
        return self.nodes.select("node", "doc_id", "t1", "t2")

    @property
    def bits(self) -> DataFrame:
        return self.nodes.select("node", "bits").join(self.groups.select("node").distinct().hint("merge"), "node", "left_semi")


def prepared(docs: DataFrame, p: Params) -> Prepared:
    docs = with_hashes(small_batches(docs))
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_shingles(docs, p))
    entries = docs.mapInArrow(_entries(heavy, p), ENTRIES)
    entries = written(entries.withColumn("uid", F.monotonically_increasing_id()), "nd-entries")

    # of equal sets that several tasks saw, the first row stands for all
    own = Window.partitionBy("fa", "fb").orderBy("uid")
    again = written(entries.where(F.col("prefix").isNotNull()).select("uid", F.row_number().over(own).alias("turn")).where("turn > 1").select("uid"), "nd-again")
    nodes = entries.where(F.col("prefix").isNotNull()).join(F.broadcast(again) if again.count() <= p.broadcast else again, "uid", "left_anti").withColumnRenamed("uid", "node")

    # one row for each prefix shingle and node, of groups that hold two nodes at least, with the group's leader
    group = Window.partitionBy("token")
    rows = nodes.select(F.explode("prefix").alias("token"), "node", F.col("n").cast("int").alias("n"), "rank")
    first = F.max(F.struct("rank", "node", "n")).over(group).alias("first")
    rows = rows.select("token", "node", "n", F.count("*").over(group).alias("size"), first, F.bit_xor(F.xxhash64("node")).over(group).alias("same")).where("size > 1")
    rows = written(rows.select("token", "node", "n", "size", F.col("first.node").alias("leader"), F.col("first.n").alias("leader_n"), "same"), "nd-groups")
    return Prepared(docs, heavy, entries, nodes, rows)


def _cells(groups: DataFrame, left: DataFrame, bits: DataFrame, p: Params) -> DataFrame:
    """left (token, node, n, comp, size) dealt to the cells of each group, blocks of bounded size held against each other."""
    left = left.withColumn("blocks", F.ceil(F.col("size") / p.block).cast("int"))
    left = left.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, "own").alias("row"), F.greatest(i, "own").alias("col")))
    left = left.select("token", "node", "n", "comp", "own", F.explode(cells).alias("cell"))
    left = left.select(
        "token", F.col("cell.row").alias("row"), F.col("cell.col").alias("col"), "node", "n", "comp",
        F.expr("if(cell.row = own, 1, 0) + if(cell.col = own, 2, 0)").alias("sides"),
    )
    lists = groups.groupBy("node").agg(F.sort_array(F.collect_list("token")).alias("list")).join(bits.hint("merge"), "node")
    return left.join(lists.hint("merge"), "node").select(*left.columns, "list", "bits").repartition("token", "row", "col").sortWithinPartitions("token", "row", "col")


def _first(groups: DataFrame) -> DataFrame:
    """The groups that count: of those with the same nodes the one of the smallest shingle."""
    first = groups.where(F.col("node") == F.col("leader")).groupBy("same", "size", "leader").agg(F.min("token").alias("token")).select("token")
    return groups.join(first.hint("merge"), "token", "left_semi")


def links(docs: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """The join itself: (members, pairs). members: doc_id, t1, t2, n_shingles, node (null without shingles) and copies (rows of the
    node's set) of every document; pairs: a < b, every two nodes that link, once. Nothing is left out for being connected
    already, so that a group of k different near copies gives up to k(k-1)/2 pairs."""
    own = prepared(docs, p)
    cells = _cells(own.groups, _first(own.groups).withColumn("comp", F.col("node")), own.bits, p)
    maybe = cells.mapInArrow(_candidates(p, True), EDGES).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    maybe = written(maybe.withColumns({"ca": F.col("a"), "cb": F.col("b")}), "nd-every")
    pairs = _checked(maybe, own.docs, own.places, own.heavy, p, every_link=True)
    node = F.min(F.when(F.col("prefix").isNotNull(), F.col("uid"))).alias("node")
    sets = own.entries.where(F.col("n") > 0).groupBy("fa", "fb").agg(node, F.count("*").alias("copies"))
    members = own.entries.join(sets, ["fa", "fb"], "left").select("doc_id", "t1", "t2", F.col("n").alias("n_shingles"), "node", "copies")
    return members, pairs


def link_counts(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """members with n_links: how many other documents each is linked with, copies of its own set among them."""
    copies = members.where(F.col("node").isNotNull()).groupBy("node").agg(F.first("copies").alias("c"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = both.join(copies, both["b"] == copies["node"]).groupBy("a").agg(F.sum("c").alias("beside"))
    rows = members.join(beside, members["node"] == beside["a"], "left")
    return rows.select(*(members[c] for c in members.columns), F.coalesce(F.coalesce("beside", F.lit(0)) + F.col("copies") - 1, F.lit(0)).alias("n_links"))


def grouped(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, t1, t2 (text_hashes), n_shingles, component_id and group, a number that the documents of a component share (null
    without shingles), of every document."""
    own = prepared(docs, p)
    docs, heavy, entries, rows, places, bits = own.docs, own.heavy, own.entries, own.groups, own.places, own.bits

    # the leaders' links, of pairs with enough prefix shingles in common
    need = lambda n, m: F.expr(f"{p.percent} * ({n} + {m}) - {100 + p.percent} * (ceil({p.percent} * greatest({n}, {m}) / 100) - 1)")
    near = rows.where((F.col("node") != F.col("leader")) & (100 * F.least("n", "leader_n") >= p.percent * F.greatest("n", "leader_n")))
    near = near.groupBy("leader", "node").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("leader_n").alias("m"))
    near = near.where((100 + p.percent) * F.col("c") >= need("n", "m"))
    # the sets differ in as many members at least as their bitmaps in bits
    near = near.join(bits.hint("merge"), "node").join(bits.hint("merge").select(F.col("node").alias("leader"), F.col("bits").alias("leader_bits")), "leader")
    differ = F.aggregate(F.zip_with("bits", "leader_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = near.where((100 + p.percent) * (F.col("n") + F.col("m") - differ) >= 2 * p.percent * (F.col("n") + F.col("m"))).select(F.col("leader").alias("a"), F.col("leader").alias("ca"), F.col("node").alias("b"), F.col("node").alias("cb"))
    links = _checked(written(near, "nd-near"), docs, places, heavy, p)
    roots = written(components(links), "nd-roots")

    # what may be linked across components: groups that hold two, each under its first shingle
    left = _first(rows).join(roots.hint("merge"), "node", "left").withColumn("comp", F.coalesce("root", "node"))
    mixed = left.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi")).select("token")
    cells = _cells(rows, left.join(mixed.hint("merge"), "token"), bits, p)
    pairs = cells.mapInArrow(_candidates(p), EDGES).distinct()
    pending, checks = written(pairs, "nd-pairs"), p.first_checks
    while True:
        a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("ca")), roots.select(F.col("node").alias("b"), F.col("root").alias("cb"))
        apart = pending.select("a", "b").join(a, "a", "left").join(b, "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where(F.col("ca") != F.col("cb"))
        turn = F.row_number().over(Window.partitionBy("a", "cb").orderBy("b"))
        pending = written(apart.withColumn("turn", turn), "nd-pairs")
        if pending.isEmpty():
            break
        links = links.unionByName(_checked(pending.where(F.col("turn") <= checks).select("a", "ca", "b", "cb"), docs, places, heavy, p))
        roots = written(components(links), "nd-roots")
        pending, checks = pending.where(F.col("turn") > checks), checks * 8

    sets_of = entries.where(F.col("n") > 0).groupBy("fa", "fb").agg(F.min("doc_id").alias("least"), F.min(F.when(F.col("prefix").isNotNull(), F.col("uid"))).alias("node"))
    sets_of = sets_of.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = sets_of.groupBy("root").agg(F.min("least").alias("component_id")).join(sets_of.hint("merge"), "root").select("fa", "fb", "component_id", F.col("root").alias("group"))
    out = entries.join(ids.hint("merge"), ["fa", "fb"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "t1", "t2", F.col("n").alias("n_shingles"), own.alias("component_id"), F.when(F.col("n") > 0, F.col("group")).alias("group"))

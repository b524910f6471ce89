"""Packing by minimum bin slack.

A document's ids are cut into full windows and one remainder; a window of exactly `capacity` ids fills a
sequence alone. The remainders' lengths form a multiset of at most capacity - 1 distinct values, whose counts
are all that the driver sees. There, window after window, a subset-sum programme over bitsets finds the
multiset of remaining lengths that comes closest to the capacity; backtracking through the stored bitsets
gives how many of each length to take, and the pattern is applied as often as the counts allow. Each
remainder then finds its place by its rank among the remainders of its length, ranked in salted groups so
that a length that many documents share is never sorted in one task.

Null texts are empty: they hold the end id alone. Repeated rows are packed one by one. An empty table gives
an empty result; extra columns are ignored. Pieces tie on length; ties go by salt, then row.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import small_batches, written
from .bpe import byte_symbols

#: How byte-level vocabularies of this kind split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SALTS = 64


#: The faster library's expressions run out of stack on longer runs of white space.
LONG_SPACE = re.compile(r"\s{20000}")


@lru_cache(2)
def plain_encoder(path: str) -> tokenizers.Tokenizer:
    return tokenizers.Tokenizer.from_file(path)


def ids_of(path: str, text: str) -> list[int]:
    """The ids of a text. Texts with a long run of white space go to the tokenizers library itself, which takes them."""
    if len(text) >= 20000 and LONG_SPACE.search(text):
        plain = plain_encoder(path)
        plain.no_truncation()
        plain.no_padding()
        return plain.encode(text, add_special_tokens=False).ids
    enc, special = encoder(path)
    return enc.encode(text, allowed_special=special)


@lru_cache(2)
def encoder(path: str) -> tuple[tiktoken.Encoding, set[str]]:
    """The byte-level vocabulary of a tokenizers file, run by the faster library; ids are the same."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    code = {c: b for b, c in enumerate(byte_symbols())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(code[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), set(special)


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[int]] = [[], [], [], [], []]
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(np.asarray(ids_of(path, text or ""), np.uint32), np.uint32(end_id))
                data, total = ids.astype("<u4").tobytes(), len(ids)
                for start in range(0, total, capacity):
                    n = min(capacity, total - start)
                    for col, v in zip(rows, (i, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), total), strict=True):
                        col.append(v)
            cols = [batch.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(c, pa.int64()) for c in rows[1:])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def best_fill(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """How many of each length to take to fill up to capacity as far as can be; counts[l] are left of length l.

    reach[k] has bit s where the k longest lengths can sum to s. Multiples of a length go in by doubling."""
    lengths = [int(x) for x in np.flatnonzero(counts)[::-1]]
    full = (1 << (capacity + 1)) - 1
    reach, used = [1], []
    for length in lengths:
        bits, left, step = reach[-1], min(int(counts[length]), capacity // length), 1
        while left:
            take = min(step, left)
            bits |= (bits << (take * length)) & full
            left -= take
            step *= 2
        reach.append(bits)
        used.append(length)
        if bits >> capacity & 1:
            break
    rest, taken = reach[-1].bit_length() - 1, {}
    for k in range(len(used) - 1, -1, -1):
        length, n = used[k], 0
        while not reach[k] >> rest & 1:
            rest -= length
            n += 1
        if n:
            taken[length] = n
    return taken


def plan(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> count) with how many sequences use each, until no remainder is left."""
    counts, out = counts.copy(), []
    while counts.any():
        first = int(np.flatnonzero(counts)[-1])
        counts[first] -= 1
        taken = best_fill(counts, capacity - first)
        counts[first] += 1
        taken[first] = taken.get(first, 0) + 1
        times = min(int(counts[x]) // n for x, n in taken.items())
        for x, n in taken.items():
            counts[x] -= n * times
        out.append((taken, times))
    return out


def places(patterns: list[tuple[dict[int, int], int]], base: int = 0) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, per sequence, offset in a sequence)."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    for taken, times in patterns:
        offset = 0
        for length in sorted(taken, reverse=True):
            out.setdefault(length, []).append((ranks.get(length, 0), base, taken[length], offset))
            ranks[length] = ranks.get(length, 0) + times * taken[length]
            offset += length * taken[length]
        base += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = shared.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            seq, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for v in np.unique(length):
                at, t = np.flatnonzero(length == v), spots[int(v)]
                row = t[np.searchsorted(t[:, 0], rank[at], side="right") - 1]
                local = rank[at] - row[:, 0]
                seq[at] = row[:, 1] + local // row[:, 2]
                offset[at] = row[:, 3] + local % row[:, 2] * v
            names = [f.name for f in batch.schema if f.name not in ("rank", "salt", "uid")]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = dict(docs.dtypes)["doc_id"]
    cols = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = small_batches(docs).select("doc_id", "text").mapInArrow(_cut(path, capacity, end_id), cols)
    pieces = pieces.withColumn("uid", F.monotonically_increasing_id())
    pieces = written(pieces.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")), "pack-pieces")
    # at most capacity x SALTS rows, whatever the input
    sizes = pieces.groupBy("length", "salt").agg(F.count("*").alias("n")).toArrow().to_pandas().sort_values(["length", "salt"])
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in sizes.groupby("length")["n"].sum().items():
        counts[length] = n
    patterns = plan(counts, capacity)
    sizes["before"] = sizes.groupby("length")["n"].cumsum() - sizes["n"]
    before = np.zeros((capacity + 1, SALTS), np.int64)
    before[sizes["length"], sizes["salt"]] = sizes["before"]
    spark = docs.sparkSession
    start = spark.sparkContext.broadcast(before)
    shared = spark.sparkContext.broadcast(places(patterns))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            rank = get("rank").to_numpy() + start.value[get("length").to_numpy(), get("salt").to_numpy()]
            i = batch.schema.get_field_index("rank")
            yield batch.set_column(i, "rank", pa.array(rank))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _place(shared)(ranked(batches))

    order = Window.partitionBy("length", "salt").orderBy("uid")
    rank = (F.row_number().over(order) - 1).cast("long")
    return pieces.withColumn("rank", rank).mapInArrow(both, cols + ", sequence_id long, offset long")

"""Exact top-k inner products by a vector-approximation file.

The file is a table of its own, written beside the exact vectors: blocks of bounded size in which every component is one of
2^bits cells, cut by the least and greatest value of its dimension, one byte each (two to a byte at four bits or fewer, whose
bounds are too wide to rule much out where vectors have many dimensions). A scan of the
cells alone bounds each query's inner product with each vector from below and above. The kth highest lower bound over all
blocks is every query's floor; vectors whose upper bound lies below it are out. Of those left the exact vectors are read
in order of their upper bounds, in two waves: first the k best by bound, whose kth exact score raises the floor, then
whatever may still reach it. No vector outside can then be among the k best.

Query blocks meet blocks of the file by an equi join on the block's number; exact vectors are read by row number only for
the candidates. Every row is a candidate for every other row's query, also where rows share vec_id or all of a vector.
Rows without vec_id, with a null vector or with null or non-finite components take no part; only vectors of equal length
are compared. Equal scores go to the smaller vec_id. No rows in, none out; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import written


def as_integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x): components as floor(scale * component), rows that take no part left out."""
    e = F.col("embedding")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    x = F.transform(e, lambda v: F.floor(v.cast("double") * scale))
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & fine).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def pack(cells: np.ndarray, bits: int) -> np.ndarray:
    """Cells of a block as bytes: two a byte where four bits hold them."""
    cells = cells.astype(np.uint8)
    if bits > 4:
        return cells
    if cells.shape[1] % 2:
        cells = np.pad(cells, ((0, 0), (0, 1)))
    return cells[:, ::2] << 4 | cells[:, 1::2]


def unpack(data: np.ndarray, dim: int, bits: int) -> np.ndarray:
    if bits > 4:
        return data
    out = np.empty((len(data), 2 * data.shape[1]), np.uint8)
    out[:, ::2], out[:, 1::2] = data >> 4, data & 15
    return out[:, :dim]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least and greatest value of every dimension among a task's vectors, by their length."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        dims = batch.column(0).value_lengths().to_numpy()
        for dim in map(int, np.unique(dims)):
            if dim:
                x = _matrix(batch.column(0).take(pa.array(np.flatnonzero(dims == dim))))
                low, high = x.min(0), x.max(0)
                if dim in held:
                    low, high = np.minimum(low, held[dim][0]), np.maximum(high, held[dim][1])
                held[dim] = low, high
    for dim, (low, high) in held.items():
        cols = [np.full(dim, dim, np.int32), np.arange(dim, dtype=np.int32), low, high]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["dim", "at", "low", "high"])


def marks(vectors: DataFrame, bits: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each vector length the least value of every dimension and the width of its cells: two numbers a dimension."""
    ends = vectors.select("x").mapInArrow(_ends, "dim int, at int, low long, high long").groupBy("dim", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in ends.toArrow().to_pylist():
        low, step = out.setdefault(r["dim"], (np.zeros(r["dim"], np.int64), np.ones(r["dim"], np.int64)))
        low[r["at"]], step[r["at"]] = r["low"], max(1, -(-(r["high"] - r["low"] + 1) // (1 << bits)))
    return out


def approximations(vectors: DataFrame, cuts: dict[int, tuple[np.ndarray, np.ndarray]], bits: int) -> DataFrame:
    """(row, dim, cells) of every vector (row, x)."""
    shared = vectors.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).value_lengths().to_numpy()
            for dim in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == dim))
                rows = batch.take(at)
                if dim:
                    low, step = shared.value[int(dim)]
                    cells = [c.tobytes() for c in pack((_matrix(rows.column(1)) - low) // step, bits)]
                else:
                    cells = [b""] * len(at)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(at), dim, np.int32)), pa.array(cells, pa.binary())], names=["row", "dim", "cells"])

    return vectors.select("row", "x").mapInArrow(run, "row long, dim int, cells binary")


def bounds(q: np.ndarray, cells: np.ndarray, low: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (candidates x queries) of the inner products of queries with what the cells hold."""
    top = float(np.abs(q).max(initial=0)) * float((np.abs(low) + (int(cells.max(initial=0)) + 1) * step).max(initial=0)) * max(1, len(low))
    kind = np.float64 if top < 2**53 else object
    corner = (low + cells.astype(np.int64) * step).astype(kind)
    base = corner @ q.T.astype(kind)
    below, above = (np.minimum(q, 0) * (step - 1)).sum(1), (np.maximum(q, 0) * (step - 1)).sum(1)
    return base + below, base + above


def _scan(shared, k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, held = batch.column(0)[i].values, batch.column(1)[i].values
                rows_q, q = asked.field("row").to_numpy(), asked.field("x")
                rows = held.field("row").to_numpy()
                dim = int(q.value_lengths()[0].as_py())
                if dim:
                    data = np.frombuffer(b"".join(held.field("cells").to_pylist()), np.uint8).reshape(len(rows), -1)
                    lower, upper = bounds(_matrix(q), unpack(data, dim, bits), *shared.value[dim])
                else:
                    lower = upper = np.zeros((len(rows), len(rows_q)))
                out = [], [], [], []
                for j, own in enumerate(rows_q):
                    other = np.flatnonzero(rows != own)
                    if not len(other):
                        continue
                    lo, up = lower[other, j], upper[other, j]
                    floor = np.partition(lo, len(lo) - k)[len(lo) - k] if len(lo) > k else lo.min()
                    keep = np.flatnonzero(up >= floor)
                    for col, v in zip(out, (np.full(len(keep), own), rows[other[keep]], lo[keep], up[keep]), strict=True):
                        col.append(v)
                cols = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["q", "row", "lower", "upper"])

    return run


def _blocks(rows: DataFrame, size: int, name: str, n: int, *columns: str) -> DataFrame:
    """Rows in blocks of about `size`, by vector length."""
    blocks = max(1, math.ceil(n / size))
    number = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long").alias(name)
    return rows.groupBy("dim", number).agg(F.collect_list(F.struct("row", *columns)).alias(f"{name}_rows"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, bits: int = 8, block: int = 8192, queries: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score for the vectors that is_query (on vec_id) picks; vectors: (vec_id, x)."""
    vectors = written(vectors.select("vec_id", "x").withColumn("row", F.monotonically_increasing_id()), "va-vectors")
    cuts = marks(vectors, bits)
    cells = written(approximations(vectors, cuts, bits), "va-cells")
    n = cells.count()
    asked = vectors.where(is_query).select("row", "x", F.size("x").alias("dim"))
    held = written(_blocks(cells, block, "c", n, "cells"), "va-blocks")
    keys = held.groupBy("dim").agg(F.collect_set("c").alias("cs"))
    pairs = _blocks(asked, queries, "q", asked.count(), "x").join(keys, "dim").select("dim", "q_rows", F.explode("cs").alias("c")).join(held, ["dim", "c"])
    shared = vectors.sparkSession.sparkContext.broadcast(cuts)
    seen = written(pairs.select("q_rows", "c_rows").mapInArrow(_scan(shared, k, bits), "q long, row long, lower long, upper long"), "va-bounds")
    # the kth highest lower bound over all blocks, then what can reach it, best bound first
    low = Window.partitionBy("q").orderBy(F.col("lower").desc(), "row")
    ranked = seen.withColumn("n", F.row_number().over(low)).where(F.col("n") <= k)
    floors = ranked.groupBy("q").agg(F.when(F.count("*") == k, F.min("lower")).alias("floor"))
    high = Window.partitionBy("q").orderBy(F.col("upper").desc(), "row")
    maybe = seen.join(floors, "q").where(F.col("floor").isNull() | (F.col("upper") >= F.col("floor")))
    maybe = written(maybe.withColumn("place", F.row_number().over(high)).select("q", "row", "upper", "place"), "va-candidates")
    query = vectors.where(is_query).select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), F.col("x").alias("y"))

    def exact(rows: DataFrame) -> DataFrame:
        read = rows.join(vectors.select("row", "vec_id", "x"), "row").join(query, "q")
        score = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0).cast("long"), lambda acc, v: acc + v)
        return read.select("q", "query_id", "row", "vec_id", score.alias("score"))

    first = written(exact(maybe.where(F.col("place") <= k).select("q", "row")), "va-first")
    sure = first.groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    rest = maybe.where(F.col("place") > k).join(sure, "q").where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))).select("q", "row")
    every = first.unionByName(exact(rest))
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id", "row")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

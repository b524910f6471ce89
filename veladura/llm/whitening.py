"""Whitening of embeddings from an exact integer scatter.

Components become whole numbers x (as_integers). The fit list is each distinct vector once: n vectors with sums S. Around a
whole-number shift near the mean, tasks add up cross-products of what is left of each vector in machine integers (in floats
where every sum stays below 2^53), in Python's unbounded ones where those would not hold them; the partial rows are summed
in unbounded integers as well. From them n·XᵀX − SSᵀ is formed exactly, whatever the shift. Only this is turned into
floats: divided by n² it is the covariance, which the driver decomposes by eigh (dimensions squared, whatever the rows).

Vectors of different lengths are fitted apart, each length by its own list. Components without variance (an eigenvalue not
above 1e-12 of the trace) can't be brought to variance 1 and are left out, all of them where only one vector is distinct.
Rows whose vector is null or holds null, NaN or infinite entries are dropped; those that repeat are answered each, null
ids stay. Entries whose 256-fold lies beyond a long count as the nearest long. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written

ROWS = "dim int, at int, width int, sums binary"


def as_integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x): components as floor(scale * component), rows that are dropped left out."""
    e = F.col("embedding")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    x = F.transform(e, lambda v: F.floor(v.cast("double") * scale))
    return vectors.where(e.isNotNull() & fine & (F.size(e) > 0)).select("vec_id", x.alias("x"))


def packed(values: list[int] | np.ndarray) -> tuple[int, bytes]:
    """Whole numbers of any size as bytes: (bytes a number, little-endian two's complement)."""
    if isinstance(values, np.ndarray) and values.dtype == np.int64:
        return 8, values.astype("<i8").tobytes()
    whole = [int(v) for v in values]
    width = max(8, *((abs(v).bit_length() + 8) // 8 for v in whole)) if whole else 8
    return width, b"".join(v.to_bytes(width, "little", signed=True) for v in whole)


def unpacked(width: int, data: bytes) -> np.ndarray:
    """What packed() wrote, as an array of Python integers."""
    if width == 8:
        return np.frombuffer(data, "<i8").astype(object)
    return np.array([int.from_bytes(data[i : i + width], "little", signed=True) for i in range(0, len(data), width)], object)


def rows_of(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, places in the batch, matrix) for each length of vectors."""
    column = batch.column(at)
    dims = column.value_lengths().to_numpy()
    for dim in np.unique(dims):
        places = np.flatnonzero(dims == dim)
        yield int(dim), places, column.take(pa.array(places)).flatten().to_numpy().reshape(len(places), int(dim))


def less(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x - shift, exactly."""
    top = int(max(abs(int(x.min())), abs(int(x.max())))) + int(max(abs(int(s)) for s in shift))
    return x - shift.astype(np.int64) if top < 2**63 else x.astype(object) - shift


def scatter(x: np.ndarray) -> np.ndarray:
    """xᵀx, exactly, as Python integers."""
    top = max(abs(int(x.min())), abs(int(x.max())))
    bound = top * top * len(x)
    if bound < 2**53:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    y = x.astype(np.int64 if bound < 2**63 else object)
    return (y.T @ y).astype(object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each length's vectors of a task: how many, and the sum of every dimension."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, _, x in rows_of(batch, 0):
            wide = np.abs(x.astype(np.float64)).max() * len(x) >= 2**62
            own = np.concatenate(([len(x)], (x.astype(object) if wide else x).sum(0).astype(object)))
            held[dim] = held[dim] + own if dim in held else own
    yield _table([(dim, -1, *packed(v)) for dim, v in held.items()])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["dim", "at", "width", "sums"])


def _products(shifts, block: int = 4096):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in rows_of(batch, 0):
                for i in range(0, len(x), block):
                    own = scatter(less(x[i : i + block], shifts.value[dim]))
                    held[dim] = held[dim] + own if dim in held else own
        for dim, m in held.items():
            yield _table([(dim, i, *packed(m[i])) for i in range(dim)])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial rows summed up by length and place, one running row of each held."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for dim, at, width, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = unpacked(width, data)
            held[dim, at] = held[dim, at] + own if (dim, at) in held else own
    yield _table([(*key, *packed(v)) for key, v in held.items()])


def _gathered(parts: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """The whole sums: one row for each length and place reaches the driver."""
    rows = parts.repartition("dim", "at").mapInArrow(_added, ROWS).toArrow().to_pylist()
    return {(r["dim"], r["at"]): unpacked(r["width"], r["sums"]) for r in rows}


@dataclass(frozen=True)
class Model:
    """One length's fit: n vectors with sums, eigenvalues by falling size with their unit vectors as rows, and the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def kept(self, most: int) -> int:
        """Components that have variance, `most` at most."""
        return int(np.count_nonzero(self.values[:most] > 1e-12 * self.trace)) if self.trace > 0 else 0


def decomposed(n: int, sums: list[int], spread: np.ndarray) -> Model:
    """spread is n·XᵀX − SSᵀ in whole numbers."""
    exact = np.array([[int(v) / (n * n) for v in row] for row in spread], np.float64)
    trace = int(sum(spread[i][i] for i in range(len(sums)))) / (n * n)
    values, vectors = np.linalg.eigh(exact)
    vectors = vectors[:, ::-1].T
    # either sign is right: the largest entry is positive
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])
    return Model(n, tuple(sums), values[::-1].copy(), vectors * signs[:, None], trace)


def fit(distinct: DataFrame) -> dict[int, Model]:
    """A model for each length of the vectors x, which are each given once."""
    counts = {dim: (int(v[0]), [int(s) for s in v[1:]]) for (dim, _), v in _gathered(distinct.select("x").mapInArrow(_sums, ROWS)).items()}
    if not counts:
        return {}
    shifts = {dim: np.array([s // n for s in sums], object) for dim, (n, sums) in counts.items()}
    shared = distinct.sparkSession.sparkContext.broadcast(shifts)
    rows = _gathered(distinct.select("x").mapInArrow(_products(shared), ROWS))
    out = {}
    for dim, (n, sums) in counts.items():
        left = np.array([s - n * int(m) for s, m in zip(sums, shifts[dim], strict=True)], object)
        spread = [n * rows[dim, i] - left[i] * left for i in range(dim)]
        out[dim] = decomposed(n, sums, spread)
    return out


def _whitened(shared, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            dims = batch.column(1).value_lengths()
            deviation, scores = [None] * batch.num_rows, [None] * batch.num_rows
            for dim, places, x in rows_of(batch, 1):
                m = models[dim]
                top = max(abs(int(x.min())), abs(int(x.max()))) * m.n + max(abs(s) for s in m.sums)
                small = top < 2**63
                sums = np.array(m.sums, np.int64 if small else object)
                off = (x if small else x.astype(object)) * m.n - sums
                wide = not small or dim * top * top >= 2**63
                squares = [int(v) for v in (np.square(off.astype(object) if wide else off)).sum(1)]
                count = m.kept(most)
                y = (off.astype(np.float64) if small else np.array([[int(v) / m.n for v in row] for row in off])) / (m.n if small else 1)
                z = y @ m.vectors[:count].T / np.sqrt(m.values[:count])
                for i, at in enumerate(places.tolist()):
                    scores[at] = z[i]
                    deviation[at] = squares[i] if squares[i] < 2**63 else None
            n = pa.array([models[d].n for d in dims.to_pylist()], pa.int64())
            cols = [batch.column(0), n, pa.array(deviation, pa.int64()), dims.cast(pa.int32()), pa.array(scores, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "n", "deviation", "dim", "scores"])

    return run


def projected(vectors: DataFrame, models: dict[int, Model], most: int = 4) -> DataFrame:
    """(vec_id, n, deviation, dim, scores) of every vector: its whitened components as an array. deviation is null where it lies
    beyond a long."""
    shared = vectors.sparkSession.sparkContext.broadcast(models)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(_whitened(shared, most), "vec_id long, n long, deviation long, dim int, scores array<double>")


def identity_errors(distinct: DataFrame, models: dict[int, Model], most: int = 4) -> dict[int, float]:
    """For each length the largest entry of the whitened fit list's covariance (centred, divisor n) less the identity."""
    rows = projected(distinct.withColumn("vec_id", F.lit(0)), models, most)
    cells = [(i, j) for i in range(most) for j in range(i, most)]
    got = rows.groupBy("dim").agg(*(F.covar_pop(F.get("scores", F.lit(i)), F.get("scores", F.lit(j))).alias(f"c{i}_{j}") for i, j in cells)).toArrow().to_pylist()
    return {r["dim"]: max((abs(r[f"c{i}_{j}"] - (i == j)) for i, j in cells if r[f"c{i}_{j}"] is not None), default=0.0) for r in got}


def whitened(vectors: DataFrame, most: int = 4) -> DataFrame:
    """vec_id, component (from 1, `most` at most), n, deviation, whitened, explained and identity_error for every row of vectors
    (vec_id, x)."""
    distinct = written(vectors.select("x").distinct(), "whitening-fit")
    models = fit(distinct)
    errors = identity_errors(distinct, models, most)
    spark = vectors.sparkSession
    told = [(dim, i + 1, float(m.values[i]) / m.trace, max(errors.values())) for dim, m in models.items() for i in range(m.kept(most))]
    # a row for each length and component
    shares = spark.createDataFrame(told, "dim int, component int, explained double, identity_error double")
    rows = projected(vectors, models, most).select("vec_id", "n", "deviation", "dim", F.posexplode("scores").alias("i", "whitened")).withColumn("component", (F.col("i") + 1).cast("int"))
    return rows.join(F.broadcast(shares), ["dim", "component"]).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")

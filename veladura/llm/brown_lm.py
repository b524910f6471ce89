"""Brown class-based bigram model: P(text) = product of P(class | class before) * P(word | class).

The vocabulary that is clustered word by word is every training word above a floor of occurrences, the least floor that
leaves `lookup` words at most. Classes are found in two steps. Exchange clustering moves the `head` most frequent of them,
and `signatures` buckets of words below the floor by their last three bytes, between `classes` classes while that raises
the bigram likelihood. Then every other word of the lookup goes to the class that makes its own neighbours most likely:
its counts before and after each class, gathered over all training texts in a shuffle by word, weighed in the tasks that
hold them. Class bigrams are counted once more with the final classes. Only the lookup's words with their classes, and
matrices of classes, reach the driver or are broadcast; counts of words below the floor stay in a table and meet the texts
in a shuffled join, which the words hot enough to skew it, being in the lookup, don't take part in.

Null and empty texts hold the end token alone. Rows that repeat are scored one by one and count as often
as they occur. An empty table gives an empty result; extra columns are ignored. Words that occur equally often are above
the floor together or not at all; of classes that suit a word equally well it takes the first.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import small_batches, words_of, written

END = b""
ADD = 0.1


@dataclass(frozen=True)
class Params:
    head: int = 1024
    signatures: int = 256
    lookup: int = 1 << 17
    classes: int = 64
    rounds: int = 6
    smooth: float = 0.5
    flush: int = 1 << 22


def signature(word: bytes, p: Params) -> int:
    return zlib.crc32(word[-3:]) % p.signatures


def _count_words(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(seen)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([signature(w, p) for w in keys], pa.int32()), pa.array(seen.values(), pa.int64())],
                names=["word", "sig", "n"],
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
                seen[END] += 1
                if len(seen) > p.flush // 4:
                    yield out()
                    seen.clear()
        yield out()

    return run


def word_counts(train: DataFrame, p: Params) -> DataFrame:
    """(word, sig, n) over all training texts, the end token under the empty word."""
    part = small_batches(train).select("text").mapInArrow(_count_words(p), "word binary, sig int, n long")
    return part.groupBy("word").agg(F.first("sig").alias("sig"), F.sum("n").alias("n"))


def _unit_ids(words: list[bytes], units: dict[bytes, int], p: Params, size: int) -> np.ndarray:
    ids = np.fromiter(map(units.get, words, repeat(-1)), np.int64, len(words))
    for i in np.flatnonzero(ids < 0):
        ids[i] = size + signature(words[i], p)
    return ids


def _count_bigrams(units, p: Params, size: int):
    total = size + p.signatures

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, waiting = units.value, [], 0

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys // total, pa.int32()), pa.array(keys % total, pa.int32()), pa.array(n, pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = np.zeros(0, np.int64) if not text else _unit_ids(words_of(text), table, p, size)
                ring = np.concatenate(([0], ids, [0]))
                held.append(ring[:-1] * total + ring[1:])
                waiting += len(ring) - 1
                if waiting >= p.flush:
                    yield out()
                    held.clear()
                    waiting = 0
        if held:
            yield out()

    return run


def unit_bigrams(train: DataFrame, units: dict[bytes, int], p: Params) -> np.ndarray:
    """Counts of unit pairs over all training texts, a matrix of a fixed size; unit 0 is the end token."""
    size = len(units)
    shared = train.sparkSession.sparkContext.broadcast(units)
    part = train.select("text").mapInArrow(_count_bigrams(shared, p, size), "a int, b int, n long")
    cells = part.groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros((size + p.signatures,) * 2)
    matrix[cells["a"].to_numpy(), cells["b"].to_numpy()] = cells["n"].to_numpy()
    return matrix


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, p: Params) -> np.ndarray:
    """Class of each unit. Units start dealt out by frequency; each round visits them by frequency and moves
    each to the class with the highest bigram likelihood, until a round moves none. Class 0 is the end token's."""
    count, c = len(pairs), p.classes
    size = pairs.sum(0)
    order = np.argsort(-size[1:], kind="stable") + 1
    cls = np.zeros(count, np.int64)
    cls[order] = np.arange(count - 1) % (c - 1) + 1
    member = np.eye(c)[cls]
    grid = member.T @ pairs @ member
    mass_a, mass_b = grid.sum(1), grid.sum(0)
    out_w, in_w = pairs.sum(1), size
    diag = np.arange(c)
    for _ in range(p.rounds):
        moved = 0
        for w in order:
            if not out_w[w] and not in_w[w]:
                continue
            self_n = pairs[w, w]
            succ = np.bincount(cls, pairs[w], c)
            pred = np.bincount(cls, pairs[:, w], c)
            a = cls[w]
            succ[a] -= self_n
            pred[a] -= self_n
            grid[a] -= succ
            grid[:, a] -= pred
            grid[a, a] -= self_n
            mass_a[a] -= out_w[w]
            mass_b[a] -= in_w[w]
            rows = _xlogx(grid + succ) - _xlogx(grid)
            cols = _xlogx(grid + pred[:, None]) - _xlogx(grid)
            own = np.diagonal(grid)
            gain = rows.sum(1) - rows[diag, diag] + cols.sum(0) - cols[diag, diag]
            gain += _xlogx(own + succ + pred + self_n) - _xlogx(own)
            gain -= _xlogx(mass_a + out_w[w]) - _xlogx(mass_a) + _xlogx(mass_b + in_w[w]) - _xlogx(mass_b)
            gain[0] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[a] + 1e-9:
                best = int(a)
            moved += best != a
            cls[w] = best
            grid[best] += succ
            grid[:, best] += pred
            grid[best, best] += self_n
            mass_a[best] += out_w[w]
            mass_b[best] += in_w[w]
        if not moved:
            break
    return cls


@dataclass
class Model:
    """words: the lookup by falling count, the end token first; classes: of its words, then of the buckets; all arrays are of
    bounded size. emit is log10 P(word | class); for a bucket what a word of it with no count but ADD has, less that ADD."""

    params: Params
    words: list[bytes]
    counts: np.ndarray
    classes: np.ndarray
    steps: np.ndarray
    emit: np.ndarray
    tokens: int
    distinct: int

    @property
    def base_den(self) -> float:
        return self.tokens + ADD * (self.distinct + 1)


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words above the least floor of occurrences that leaves `most` of them at most (the end token apart): found in a
    histogram of counts by powers of 2^(1/8), then by the counts of the one bin in which the floor lies."""
    words = counts.where(F.length("word") > 0).withColumn("bin", F.floor(8 * F.log2("n")).cast("int"))
    left, floor = most, 0
    for r in sorted(words.groupBy("bin").agg(F.count("*").alias("v")).collect(), key=lambda r: -r["bin"]):
        if r["v"] > left:
            for n, v in sorted(((x["n"], x["v"]) for x in words.where(F.col("bin") == r["bin"]).groupBy("n").agg(F.count("*").alias("v")).collect()), reverse=True):
                if v > left:
                    floor = n
                    break
                left -= v
            break
        left -= r["v"]
    return words.where(F.col("n") > floor).select("word", "sig", "n")


def _ranks(words: list[bytes], rank: dict[bytes, int], size: int, p: Params) -> np.ndarray:
    """Places in the lookup; words that it lacks count on from its size by bucket."""
    at = np.fromiter(map(rank.get, words, repeat(-1)), np.int64, len(words))
    for i in np.flatnonzero(at < 0):
        at[i] = size + signature(words[i], p)
    return at


def _rings(batches: Iterator[pa.RecordBatch], rank: dict[bytes, int], size: int, p: Params) -> Iterator[np.ndarray]:
    """Texts in blocks of about `flush` tokens as units, an end token before, between and after them."""
    held, waiting = [np.zeros(1, np.int64)], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.append(np.append(_ranks(words_of(text), rank, size, p) if text else np.zeros(0, np.int64), 0))
            waiting += len(held[-1])
            if waiting >= p.flush:
                yield np.concatenate(held)
                held, waiting = [np.zeros(1, np.int64)], 0
    if waiting:
        yield np.concatenate(held)


def _contexts(shared, p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, cls, _ = shared.value
        size, c = len(rank), p.classes
        for ring in _rings(batches, rank, size, p):
            own = cls[ring]
            later = np.flatnonzero((own < 0) & (ring < size))
            keys = []
            for step, shift in ((1, 0), (-1, c)):
                near = own[later + step]
                fine = near >= 0
                keys.append(ring[later][fine] * 2 * c + shift + near[fine])
            keys, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys // (2 * c), pa.int32()), pa.array(keys % (2 * c), pa.int32()), pa.array(n, pa.int64())], names=["w", "k", "n"])

    return run


def _assign(shared, p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, (steps, mass) = shared.value
        c, rows = p.classes, {}
        for batch in batches:
            for w, k, n in zip(*(batch.column(i).to_numpy() for i in range(3)), strict=True):
                rows.setdefault(int(w), np.zeros(2 * c))[k] += n
        if rows:
            seen = np.stack(list(rows.values()))
            after, before = seen[:, :c], seen[:, c:]
            # the word's neighbours under each class, less what its tokens cost by sharing the class's mass
            gain = after @ steps.T + before @ steps - np.maximum(after.sum(1), before.sum(1))[:, None] * mass[None, :]
            gain[:, 0] = -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array(gain.argmax(1), pa.int32())], names=["w", "cls"])

    return run


def _class_pairs(shared, p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, cls = shared.value
        grid = np.zeros(p.classes * p.classes, np.int64)
        for ring in _rings(batches, rank, len(rank), p):
            own = cls[ring]
            grid += np.bincount(own[:-1] * p.classes + own[1:], minlength=len(grid))
        at = np.flatnonzero(grid)
        yield pa.RecordBatch.from_arrays([pa.array(at // p.classes, pa.int32()), pa.array(at % p.classes, pa.int32()), pa.array(grid[at])], names=["a", "b", "n"])

    return run


def log_steps(grid: np.ndarray, p: Params) -> np.ndarray:
    return np.log10((grid + p.smooth) / (grid.sum(1, keepdims=True) + p.smooth * p.classes))


def fit(train: DataFrame, p: Params = Params()) -> tuple[Model, DataFrame]:
    """The model and the table of all training words (word, sig, n)."""
    context = train.sparkSession.sparkContext
    counts = written(word_counts(train, p), "lm-words")
    by_sig = counts.groupBy("sig").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow().to_pylist()
    ends = counts.where(F.length("word") == 0).agg(F.sum("n")).first()[0] or 0
    top = sorted(((bytes(r["word"]), r["n"], r["sig"]) for r in frequent(counts, p.lookup).toArrow().to_pylist()), key=lambda r: (-r[1], r[0]))
    words = [END, *(w for w, _, _ in top)]
    ns = np.array([ends, *(n for _, n, _ in top)], np.int64)
    sigs = np.array([signature(END, p), *(s for _, _, s in top)], np.int64)
    size, head = len(words), min(p.head, len(words))
    pairs = unit_bigrams(train, {w: i for i, w in enumerate(words[:head])}, p)
    first = exchange(pairs, p)
    member = np.eye(p.classes)[first]
    grid = member.T @ pairs @ member
    cls = np.full(size + p.signatures, -1, np.int64)
    cls[:head], cls[size:] = first[:head], first[head:]
    rank = {w: i for i, w in enumerate(words)}
    if size > head:
        mass = np.log10(np.maximum(grid.sum(0), 1))
        shared = context.broadcast((rank, cls, (log_steps(grid, p), mass)))
        near = train.select("text").mapInArrow(_contexts(shared, p), "w int, k int, n long")
        found = near.repartition("w").mapInArrow(_assign(shared, p), "w int, cls int").toArrow()
        cls[found["w"].to_numpy()] = found["cls"].to_numpy()
        # words none of whose neighbours has a class yet
        lost = np.flatnonzero(cls[:size] < 0)
        cls[lost] = cls[size + sigs[lost]]
        shared = context.broadcast((rank, cls))
        cells = train.select("text").mapInArrow(_class_pairs(shared, p), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
        grid = np.zeros((p.classes, p.classes))
        grid[cells["a"].to_numpy(), cells["b"].to_numpy()] = cells["n"].to_numpy()
    rare_n, rare_v = np.zeros(p.signatures), np.zeros(p.signatures)
    for r in by_sig:
        rare_n[r["sig"]], rare_v[r["sig"]] = r["n"], r["v"]
    np.subtract.at(rare_n, sigs, ns)
    np.subtract.at(rare_v, sigs, ns > 0)
    unit_n = np.concatenate((ns, rare_n))
    per_class_n = np.bincount(cls, unit_n, p.classes)
    per_class_v = np.bincount(cls, minlength=p.classes)
    emit = np.log10((unit_n + ADD) / (per_class_n[cls] + ADD * per_class_v[cls]))
    emit[size:] -= np.log10(rare_n + ADD * (rare_v + 1))
    total, distinct = sum(r["n"] for r in by_sig), sum(r["v"] for r in by_sig)
    return Model(p, words, ns, cls, log_steps(grid, p), emit, total, distinct), counts


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        p, size = m.params, len(m.words)
        rank = {w: i for i, w in enumerate(m.words)}
        logs = np.log10(m.counts + ADD)
        den = np.log10(m.base_den) if m.base_den > 0 else 0.0
        lows = np.log10(ADD)
        for batch in batches:
            rows = []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                words = words_of(text)
                words.append(END)
                unit = _ranks(words, rank, size, p)
                rare = np.flatnonzero(unit >= size)
                known = unit[unit < size]
                cls = m.classes[unit]
                steps = m.steps[np.concatenate(([0], cls[:-1])), cls].sum()
                tail = Counter([words[i] for i in rare])
                rows.append(
                    (
                        len(words),
                        int((m.counts[known] > 0).sum()),
                        float(logs[known].sum() + lows * len(rare) - den * len(words)),
                        float(steps + m.emit[unit].sum() + lows * len(rare)),
                        [{"word": w, "n": n} for w, n in tail.items()],
                    )
                )
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))]
            keep = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "text"]
            names = [f.name for f in batch.schema if f.name != "text"]
            yield pa.RecordBatch.from_arrays(keep + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[*names, "n_tokens", "n_known", "base_score", "score", "tail"])

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """docs (doc_id, text) with n_tokens, n_known, base_score (add-0.1 unigrams) and score, both log10."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]
    first = docs.select("doc_id", "text").mapInArrow(
        _score(shared), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, tail array<struct<word:binary,n:long>>"
    )
    first = written(first.withColumn("uid", F.monotonically_increasing_id()), "lm-scored")
    gain = F.log10(F.col("c") + ADD) - F.lit(float(np.log10(ADD)))
    more = (
        first.select("uid", F.explode("tail").alias("t"))
        .select("uid", "t.word", F.col("t.n").alias("k"))
        .join(counts.select("word", F.col("n").alias("c")), "word")
        .groupBy("uid")
        .agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * gain).alias("more"))
    )
    return (
        first.drop("tail")
        .join(more, "uid", "left")
        .select(
            "doc_id",
            "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
            (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
        )
    )


def scored(docs: DataFrame, is_training: Column, p: Params = Params()) -> tuple[DataFrame, Model]:
    model, counts = fit(docs.where(is_training).select("text"), p)
    return score(docs, model, counts), model

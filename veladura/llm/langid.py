"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text stands for each language. A text is parsed from left to right into the
longest phrases that occur in that language's sample; the language that needs the fewest phrases, normalised
to bits a symbol by the sample's size, wins. Letters are lower-cased, each run of other characters is one
separator. Every letter of a sample is a symbol of its own; letters that no sample has share one that no sample has. Phrases also end every `window` symbols: the windows of many texts are then parsed in step, one
array operation a symbol for all of them, and a long text is just many windows.

The sample is bounded: at most `rows` labelled rows a language, those whose id and text have the smallest hash,
`per_row` characters of each, `symbols` symbols in all. Only this sample reaches the driver.

Text that is null or has no letter gets `und` and score 0; so does everything where no language was learned.
Ties go to the smaller language name. The score is one less the winner's entropy over the runner-up's.
Rows stay as they are: repeated rows are answered each, extra columns are kept, an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import small_batches, text_blocks


@dataclass(frozen=True)
class Params:
    rows: int = 96
    per_row: int = 1200
    symbols: int = 24_000
    window: int = 512
    block: int = 1 << 20


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def automaton(text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Moves of the suffix automaton of a symbol sequence, as packed() lays them out."""
    nexts: list[dict[int, int]] = [{}, {}]
    link, size = [0, 0], [0, 0]
    last = 1
    for c in text.tolist():
        new = len(nexts)
        nexts.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = nexts[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return packed(nexts, width)


def packed(nexts: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, to, root): the moves of states in one array, the rows of all states laid over each other so that no two
    moves meet. A state is known by its row's offset, which no other has; 0 is none. State s moves by c to
    to[s + c] where owner[s + c] is s, and nowhere otherwise. root holds the moves of state 1 by symbol. The size
    follows the number of moves, not that of symbols."""
    taken, offsets, at = bytearray(2 * width + 2), [0] * len(nexts), {0}
    low, high = [0] * width, 0
    for s in sorted(range(1, len(nexts)), key=lambda s: -len(nexts[s])):
        moves = sorted(nexts[s])
        first, tries = moves[0] if moves else 0, 0
        cell = high if len(moves) > 1 else low[first]
        while True:
            if len(taken) <= cell + 2 * width:
                taken.extend(bytes(len(taken)))
            cell = taken.index(0, cell)
            if len(taken) <= cell + 2 * width:
                taken.extend(bytes(len(taken)))
            offset = cell - first
            if offset > 0 and offset not in at and not any(taken[offset + c] for c in moves):
                break
            cell, tries = cell + 1, tries + 1
        if len(moves) < 2:  # a cell that doesn't do for one move never will for the same
            low[first] = cell
        elif tries > 16:  # the cells passed over are left to states of one move
            high = cell
        offsets[s] = offset
        at.add(offset)
        for c in moves:
            taken[offset + c] = 1
    owner = np.full(max(at) + width, -1, np.int64)
    to = np.zeros(len(owner), np.int64)
    for s, moves in enumerate(nexts):
        for c, t in moves.items():
            owner[offsets[s] + c], to[offsets[s] + c] = offsets[s], offsets[t]
    root = np.zeros(width, np.int64)
    for c, t in nexts[1].items():
        root[c] = offsets[t]
    return owner, to, root


class Parser:
    """sample: (language, text) by language."""

    def __init__(self, sample: tuple[tuple[str, str], ...], p: Params) -> None:
        self.p, self.names = p, [k for k, _ in sample]
        is_letter = letters()
        used = sorted({ord(c) for _, t in sample for c in t.lower() if is_letter[ord(c)]})
        # 0 pads, 1 separates, 2 is a letter that no sample has
        self.width = 3 + len(used)
        self.table = np.where(is_letter, 2, 1).astype(np.min_scalar_type(self.width))
        self.table[used] = np.arange(3, 3 + len(used))
        self.autos, self.bits = [], []
        for _, t in sample:
            symbols = self.symbols(t)[: p.symbols]
            self.autos.append(automaton(symbols, self.width))
            self.bits.append(np.log2(max(2, len(symbols))))

    def symbols(self, text: str) -> np.ndarray:
        s = self.table[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        return s[np.concatenate(([True], (s[1:] != 1) | (s[:-1] != 1)))] if len(s) else s

    def phrases(self, windows: np.ndarray) -> np.ndarray:
        """Phrases in each window (a column of symbols, padded with 0) for each language."""
        n, out = windows.shape[1], np.zeros((len(self.autos), windows.shape[1]), np.int64)
        for k, (owner, to, root) in enumerate(self.autos):
            # no move leaves state 0: there a phrase begins, as it does after a symbol that the sample lacks
            state, missed = np.zeros(n, np.int64), np.zeros(n, np.int32)
            for row in windows:
                at = state + row
                miss = owner[at] != state
                missed += miss & (row != 0)
                state = np.where(miss, root[row], to[at])
            out[k] += missed
        return out

    def answer(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.names:
            return out
        w, parts, owner = self.p.window, [], []
        sizes = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            s = self.symbols(t) if t else np.zeros(0, self.table.dtype)
            if not (s >= 2).any():
                continue
            sizes[i] = len(s)
            pad = -len(s) % w
            parts.append(np.concatenate((s, np.zeros(pad, self.table.dtype))))
            owner += [i] * ((len(s) + pad) // w)
        if not parts:
            return out
        grid = np.ascontiguousarray(np.concatenate(parts).reshape(-1, w).T)
        counts = self.phrases(grid)
        total = np.stack([np.bincount(owner, c, len(texts)) for c in counts]) * np.array(self.bits)[:, None] / np.maximum(sizes, 1)
        first = total.argmin(0)
        rest = total.copy()
        rest[first, np.arange(len(texts))] = np.inf
        second = rest.min(0)
        best = total[first, np.arange(len(texts))]
        for i in np.flatnonzero(sizes):
            score = 1.0 if not np.isfinite(second[i]) else 1 - best[i] / second[i]
            out[i] = (self.names[first[i]], float(min(1.0, max(0.0, score))))
        return out

    def answers(self, texts: pa.Array) -> list[tuple[str, float]]:
        """In blocks of about p.block characters."""
        return [x for block in text_blocks(texts, self.p.block) for x in self.answer(block)]


@lru_cache(2)
def parser(sample: tuple[tuple[str, str], ...], p: Params) -> Parser:
    """Built once in each Python worker from the broadcast sample."""
    return Parser(sample, p)


def fit(docs: DataFrame, is_training: Column, p: Params = Params()) -> tuple[tuple[str, str], ...]:
    """A bounded sample of labelled text for each language: the p.rows rows whose id and text have the smallest hash, ranked by
    Spark first by hash alone, then with their texts among those up to the last one's hash. Rows that repeat are in no
    draw's way: of equal hashes as many stay as are still asked for."""
    draw = F.xxhash64(F.lit(7), "doc_id", "text").alias("draw")
    rows = docs.where(is_training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    ranked = rows.select("lang", draw).withColumn("turn", turn).where(F.col("turn") <= p.rows)
    last = ranked.groupBy("lang").agg(F.max("draw").alias("last")).toArrow().to_pylist()
    if not last:
        return ()
    limit = F.create_map(*(F.lit(x) for r in last for x in (r["lang"], r["last"])))
    drawn = rows.select("lang", draw, F.substring("text", 1, p.per_row).alias("text")).where(F.col("draw") <= limit[F.col("lang")])
    got: dict[str, list] = {}
    for r in drawn.withColumn("turn", turn).where(F.col("turn") <= p.rows).toArrow().to_pylist():
        got.setdefault(r["lang"], []).append((r["draw"], r["text"]))
    return tuple((k, "\n".join(t for _, t in sorted(got[k]))) for k in sorted(got))


def identify(docs: DataFrame, sample: tuple[tuple[str, str], ...], p: Params = Params()) -> DataFrame:
    """docs with lang_pred and score; every other column, the text included, stays."""
    shared = docs.sparkSession.sparkContext.broadcast(sample)
    docs = small_batches(docs).drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(shared.value, p)
        for batch in batches:
            got = own.answers(batch.column(at))
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)

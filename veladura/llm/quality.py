"""Quality rules by distribution divergence.

Each language's reference is learned from all documents of that language: the histogram of character classes
and that of its `common` most frequent words, all others in one bin. A document is compared with every
reference by Jensen-Shannon distance (base 2, 0 to 1) and judged by the nearest: it fails where the distance
of the characters, or that of the words, is above its limit. The limits widen with the sampling noise of short
texts, which falls as one over the root of the number of words; texts shorter than `min_words` are not compared.

Null texts have no words. Where no language was learned, nothing fails by divergence. Rows stay as they are:
repeated rows are answered each, extra columns are kept unless they bear a result's name, an empty table
stays empty. Ties between languages do not matter, ties between words go to the smaller word.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count, repeat

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import small_batches, text_blocks

SPACE, BREAK, LOWER, UPPER, DIGIT, POINT, SYMBOL, MARKED, OTHER = range(9)
CLASSES = 9
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Params:
    common: int = 100
    char_limit: float = 0.2
    char_noise: float = 0.6
    word_limit: float = 0.3
    word_noise: float = 1.4
    min_words: int = 50
    block: int = 1 << 20
    held: int = 250_000


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of each code point; MARKED are the characters of the symbol rule."""

    def of(c: str) -> int:
        if c in "\n\r":
            return BREAK
        if c in SPACES:
            return SPACE
        if c in "#*$%&|<>":
            return MARKED
        kind = unicodedata.category(c)
        return {"Ll": LOWER, "Lu": UPPER, "Nd": DIGIT}.get(kind, POINT if kind[0] == "P" else SYMBOL if kind[0] == "S" else LOWER if kind[0] == "L" else OTHER)

    return np.fromiter((of(chr(i)) for i in range(0x110000)), np.uint8, 0x110000)


def char_counts(texts: list[str]) -> np.ndarray:
    """Class counts of each text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(owner * CLASSES + char_classes()[points], minlength=len(texts) * CLASSES).reshape(-1, CLASSES)


def _blocks(batch: pa.RecordBatch, at: int, size: int) -> Iterator[list[str]]:
    return ([t or "" for t in block] for block in text_blocks(batch.column(at), size))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of a to the distribution b; rows without mass are at 1."""
    mass = a.sum(1, keepdims=True)
    p, q = a / np.maximum(mass, 1e-12), b[None, :] / max(b.sum(), 1e-12)
    m = (p + q) / 2

    def kl(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log2(np.maximum(x, 1e-300) / np.maximum(m, 1e-300)), 0).sum(1)

    return np.where(mass[:, 0] > 0, np.sqrt(np.clip((kl(p) + kl(q)) / 2, 0, 1)), 1.0)


def fit(docs: DataFrame, p: Params = Params()) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """For each language: class counts, its common words' bins and their counts (the last bin is all others)."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        chars: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(CLASSES, np.int64))

        def out() -> pa.RecordBatch:
            rows = [(k, w, n, None) for k, c in words.items() for w, n in c.items()]
            rows += [(k, None, int(n), i) for k, c in chars.items() for i, n in enumerate(c) if n]
            rows += [(k, None, c.total(), -1) for k, c in words.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.binary(), pa.int64(), pa.int32()), strict=True)], names=["lang", "word", "n", "cls"])

        for batch in batches:
            langs, at = batch.column(0).to_pylist(), 0
            for block in _blocks(batch, 1, p.block):
                own = char_counts(block)
                for i, t in enumerate(block):
                    words[langs[at + i]].update(t.encode().lower().split())
                    chars[langs[at + i]] += own[i]
                at += len(block)
                if sum(map(len, words.values())) > p.held:
                    yield out()
                    words.clear()
                    chars.clear()
        yield out()

    rows = small_batches(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    part = rows.mapInArrow(counts, "lang string, word binary, n long, cls int")
    total = part.groupBy("lang", "word", "cls").agg(F.sum("n").alias("n"))
    # Spark keeps the first ranks of each task before the shuffle, so that no task sorts a language's whole vocabulary
    first = Window.partitionBy("lang", F.col("word").isNull()).orderBy(F.col("n").desc(), "word", "cls")
    best = total.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= p.common).drop("rank").toArrow().to_pylist()
    out: dict[str, list] = {}
    for r in sorted(best, key=lambda r: (-r["n"], r["word"] or b"")):
        ref = out.setdefault(r["lang"], [np.zeros(CLASSES), {}, [], 0])
        if r["word"] is not None:
            ref[1][bytes(r["word"])] = len(ref[1])
            ref[2].append(r["n"])
        elif r["cls"] < 0:
            ref[3] = r["n"]
        else:
            ref[0][r["cls"]] = r["n"]
    return {k: (chars, words, np.array([*ns, n - sum(ns)], float)) for k, (chars, words, ns, n) in sorted(out.items())}


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(ids) < 4:
        return 0
    ids = ids.astype(np.int64)
    wide = int(ids.max()) + 1
    if wide <= 1 << 21:
        key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:  # three ids no longer fit one key: pairs are numbered first
        key = np.unique(ids[:-2] * wide + ids[1:-1], return_inverse=True)[1].astype(np.int64) * wide + ids[2:]
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    hit = n[back] > 1
    if not hit.any():
        return 0
    cover = np.zeros(len(ids), bool)
    cover[:-2] |= hit
    cover[1:-1] |= hit
    cover[2:] |= hit
    return int(cover.sum())


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


class Judge:
    def __init__(self, refs: dict, p: Params) -> None:
        self.p, self.refs = p, refs
        self.common = {w: i for i, w in enumerate(sorted({w for _, words, _ in refs.values() for w in words}))}
        self.ids: dict = defaultdict(count().__next__)
        self.bins = []
        for _, words, ns in refs.values():
            to = np.full(len(self.common) + 1, len(words))
            for w, i in words.items():
                to[self.common[w]] = i
            self.bins.append((to, len(words) + 1))

    def rows(self, texts: list[str]) -> list[tuple]:
        chars, out = char_counts(texts), []
        judged, hists = [], [[] for _ in self.refs]
        for i, t in enumerate(texts):
            if len(self.ids) > self.p.held:
                self.ids = defaultdict(count().__next__)
            data = t.encode()
            words = data.split()
            n, c = len(words), chars[i]
            if n and len(self.ids) + n < 1 << 21:
                ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, n)
            else:
                ids = np.unique(np.array(words, object), return_inverse=True)[1] if n else np.zeros(0, np.int64)
            if "\n" in t:
                lines = [x for x in t.split("\n") if x.strip(SPACES)]
                dup = len(lines) - len(set(lines))
            else:
                dup = 0
            again = repeat_words(ids)
            failed = n < 50 or 100 * again > 50 * n
            out.append([n, int(len(t) - sum(t.count(s) for s in SPACES)), int(c[MARKED]), dup, again, failed, not failed, None, None])
            if not failed and n >= self.p.min_words and self.refs:
                at = np.fromiter(map(self.common.get, data.lower().split(), repeat(len(self.common))), np.int64, n)
                flat = np.bincount(at, minlength=len(self.common) + 1)
                judged.append(i)
                for h, (to, len_w) in zip(hists, self.bins, strict=True):
                    h.append(np.bincount(to, flat, len_w))
        if judged:
            n = np.array([out[i][0] for i in judged], float)
            own = chars[judged].astype(float)
            near_c = np.full(len(judged), np.inf)
            near_w = np.full(len(judged), np.inf)
            near = np.full(len(judged), np.inf)
            for (ref_c, _, ref_w), h in zip(self.refs.values(), hists, strict=True):
                dc, dw = distance(own, ref_c), distance(np.array(h, float), ref_w)
                closer = dw + dc < near
                near[closer], near_c[closer], near_w[closer] = (dw + dc)[closer], dc[closer], dw[closer]
            short = 1 / np.sqrt(n)
            fine = (near_c <= self.p.char_limit + self.p.char_noise * short) & (near_w <= self.p.word_limit + self.p.word_noise * short)
            for k, i in enumerate(judged):
                out[i][6:] = [bool(fine[k]), float(near_c[k]), float(near_w[k])]
        return out


def judged(docs: DataFrame, refs: dict, p: Params = Params()) -> DataFrame:
    """docs with RESULTS; every other column stays."""
    shared = docs.sparkSession.sparkContext.broadcast(refs)
    docs = small_batches(docs).drop(*RESULTS)
    kinds = [T.LongType()] * 5 + [T.BooleanType()] * 2 + [T.DoubleType()] * 2
    arrow = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(RESULTS, kinds, strict=True))])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value, p)
        for batch in batches:
            rows = [r for block in _blocks(batch, at, p.block) for r in judge.rows(block)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(RESULTS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, arrow, strict=True))], names=[*batch.schema.names, *RESULTS])

    return docs.mapInArrow(run, schema)

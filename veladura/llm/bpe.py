"""Byte-pair encoding by batched merge rounds over flat symbol arrays.

Each distinct piece of text is split once; the symbols of many words lie in one flat array. A round looks up
the rank of every adjacent pair by binary search over the sorted pair keys, takes the lowest rank of each word,
merges its leftmost occurrences and goes on until no word has a pair left. Words of more than LONG_WORD bytes, on
which a round would cost as much as they are long, are merged by the same ranks from a heap.

Null texts are empty; an empty text has no ids. Memory is bounded by the cache's size and one Arrow batch.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .base import small_batches, text_blocks

CACHE = 300_000
LONG_WORD = 512
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = regex.compile(f"[{SPACE}]+")
NOT_SPACE = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


# --- fixed values: what Unicode 16 added to Python's 15.1 and the library's expressions know (the regex module knows more),
# and the lower case of letters that Unicode 16 and 17 added, as its normalizer has it
ADDED = {
    "L": ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
          (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
          (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF),
          (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)),
    "N": ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)),
}
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {i: i + 0x20 for i in range(0x10D50, 0x10D66)} | {i: i + 0x1B for i in range(0x16EA0, 0x16EB9)}
NEW_UPPER = regex.compile("[" + "".join(map(chr, LOWER)) + "]")


@lru_cache(2)
def category(first: str) -> str:
    """The characters of a general category in Unicode 16, as ranges of a regular expression's class."""
    at = [i for i in range(0x110000) if unicodedata.category(chr(i))[0] == first]
    cuts = [0, *(k for k in range(1, len(at)) if at[k] != at[k - 1] + 1), len(at)]
    ranges = [(at[a], at[b - 1]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in [*ranges, *ADDED[first]])


class Bpe:
    """A vocabulary with word ends, read from a tokenizers file: NFC, white space dropped, lower case."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        splits = [x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        # the library's \s leaves out U+001C to U+001F, which Python's has
        self.pattern = regex.compile(splits[0].replace(r"\s", SPACE).replace(r"\p{L}", category("L")).replace(r"\p{N}", category("N")))
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        symbols = byte_symbols()
        self.plain = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        self.width = max(self.tokens) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys, first = np.unique(keys, return_index=True)
        self.keys, self.ranks, self.made = keys, first, made[first]
        self.pairs = {k: (r, m) for k, r, m in zip(keys.tolist(), first.tolist(), made[first].tolist(), strict=True)}
        self.cache: dict[str, tuple[str, int, str]] = {}

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (its UTF-8 bytes), all words together, round by round."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids = self.plain[flat]
        ends = np.cumsum(sizes) - 1
        ids[ends] = self.final[flat[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        live_ids, live_word = ids, word
        done_ids, done_word = [], []
        none = len(self.made)
        while len(live_ids) > 1:
            key = live_ids[:-1] * self.width + live_ids[1:]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[spot] == key) & (live_word[:-1] == live_word[1:])
            rank = np.where(hit, self.ranks[spot], none)
            start = np.flatnonzero(np.concatenate(([True], live_word[1:] != live_word[:-1])))
            best = np.minimum.reduceat(np.append(rank, none), start)
            sizes_now = np.diff(np.append(start, len(live_word)))
            best_each = np.repeat(best, sizes_now)
            over = best_each == none
            if over.any():
                done_ids.append(live_ids[over])
                done_word.append(live_word[over])
            take = (rank == best_each[:-1]) & (rank < none)
            # of overlapping occurrences the leftmost goes first: keep every other one of each run
            runs = np.flatnonzero(take)
            if len(runs):
                fresh = np.concatenate(([True], np.diff(runs) != 1))
                base = np.maximum.accumulate(np.where(fresh, np.arange(len(runs)), 0))
                runs = runs[(np.arange(len(runs)) - base) % 2 == 0]
            live_ids = live_ids.copy()
            live_ids[runs] = self.made[spot[runs]]
            keep = ~over
            keep[runs + 1] = False
            live_ids, live_word = live_ids[keep], live_word[keep]
        done_ids.append(live_ids)
        done_word.append(live_word)
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return np.split(ids[order], np.cumsum(np.bincount(word, minlength=len(words)))[:-1])

    def merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one long word: the same merges, lowest rank first, then leftmost, over a linked list. A round costs as
        much as the word is long; here a merge costs what its two new pairs do."""
        ids = self.plain[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.final[word[-1]])
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        pair, width = self.pairs, self.width
        heap = [(r[0], i) for i in range(n - 1) if (r := pair.get(ids[i] * width + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or (r := pair.get(ids[i] * width + ids[j])) is None or r[0] != rank:
                continue
            ids[i], ids[j], k = r[1], -1, after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                if r := pair.get(ids[i] * width + ids[k]):
                    heapq.heappush(heap, (r[0], i))
            if (h := before[i]) >= 0 and (r := pair.get(ids[h] * width + ids[i])):
                heapq.heappush(heap, (r[0], h))
        return np.array([x for x in ids if x >= 0], np.int64)

    def pieces(self, chunk: str) -> list[str]:
        return self.pattern.findall(chunk)

    def learn(self, chunks: list[str]) -> None:
        """Put the ids of chunks (normalised, without white space) into the cache."""
        parts = [self.pieces(c) for c in chunks]
        distinct = list(dict.fromkeys(p for ps in parts for p in ps))
        data = {p: p.encode() for p in distinct}
        short = [p for p in distinct if len(data[p]) <= LONG_WORD]
        made = dict(zip(short, self.merge([data[p] for p in short]), strict=True))
        made |= {p: self.merge_long(data[p]) for p in distinct if len(data[p]) > LONG_WORD}
        tokens = self.tokens
        for c, ps in zip(chunks, parts, strict=True):
            ids = [i for p in ps for i in made[p].tolist()]
            self.cache[c] = (" ".join(map(str, ids)), len(ids), " ".join(tokens[i] for i in ids))

    def encode(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text the number of ids, the ids joined by one space and the decoded text."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        split, seen = [], set()
        for t in texts:
            row: list[str] = []
            if t:
                last = 0
                for m in self.specials.finditer(t) if "<|" in t else ():
                    row += chunks_of(t[last : m.start()])
                    row.append(f" {m[0]}")  # chunks hold no space
                    last = m.end()
                row += chunks_of(t[last:])
                seen.update(row)
            split.append(row)
        for s in (c for c in seen if c[0] == " "):
            self.cache[s] = (str(self.special[s[1:]]), 1, s[1:])
        self.learn([c for c in seen if c not in self.cache])
        get, out = self.cache.__getitem__, []
        for row in split:
            if row:
                ids, n, tokens = zip(*map(get, row), strict=True)
                out.append((sum(n), " ".join(ids), " ".join(tokens)))
            else:
                out.append((0, "", ""))
        return out


@lru_cache(2)
def loaded(path: str) -> Bpe:
    """One vocabulary and cache for each Python worker."""
    return Bpe(path)


def chunks_of(text: str) -> list[str]:
    """NFC, lower case letter by letter (without the final-sigma rule that str.lower has), split at white space."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if NEW_UPPER.search(text):
            text = text.translate(LOWER)
    text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
    return [c for c in SPACES.split(text) if c] if NOT_SPACE.search(text) else text.split()


def in_blocks(bpe: Bpe, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
    """encode over blocks of bounded size, so that no more is split at once."""
    for block in text_blocks(texts):
        yield from bpe.encode(block)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            rows = [*in_blocks(bpe, batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string())))],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return run


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            rows = [(n, *(hashlib.sha256(x.encode()).hexdigest() for x in (ids, text))) for n, ids, text in in_blocks(bpe, batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string())))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by one space) and the text that decoding them gives."""
    kind = dict(docs.dtypes)["doc_id"]
    return small_batches(docs).select("doc_id", "text").mapInArrow(_encode(path), f"doc_id {kind}, n_tokens long, ids string, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """As encoded, with SHA-256 digests in place of the long strings, which then never leave the task."""
    kind = dict(docs.dtypes)["doc_id"]
    return small_batches(docs).select("doc_id", "text").mapInArrow(_digests(path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

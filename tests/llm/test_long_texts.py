"""Texts that are one long run, one long word, or millions of different words."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veladura.llm import bpe, packing, quality

rng = random.Random(8)


def library(name):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.no_truncation()
    plain.no_padding()
    return lambda t: plain.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 60_000 + "x", "a" + "\n" * 30_000 + " b", " " * 19_999 + "z", "\t \n" * 9000 + "fin", "a" * 200_000])
def test_packing_ids_are_the_librarys(text):
    assert packing.ids_of(public_tokenizers.path("byte_bpe_50k.json"), text) == library("byte_bpe_50k.json")(text)


def test_packing_takes_a_million_spaces(spark):
    docs = spark.createDataFrame([(1, "uno" + " " * 1_000_000 + "dos"), (2, " " * 1_000_000)], "doc_id long, text string")
    rows = packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == next(r.doc_tokens for r in rows if r.doc_id == 1)


@pytest.mark.parametrize("word", ["a" * 100_000, "ab" * 3000, "".join(rng.choices("etaoinshrdlu", k=5000)), "é" * 700, "x" * 513, "q" * 512])
def test_long_words(word):
    model = bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))
    n, ids, _ = model.encode([word])[0]
    assert ids == " ".join(map(str, library("word_bpe_49k.json")(word)))


def test_a_word_of_a_million_letters_ends():
    assert bpe.Bpe(public_tokenizers.path("word_bpe_49k.json")).encode(["a" * 1_000_000])[0][0] > 1000


def test_long_and_short_words_merge_alike():
    model = bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 60))).encode() for _ in range(300)]
    for word, ids in zip(words, model.merge(words), strict=True):
        assert model.merge_long(word).tolist() == ids.tolist()


def test_letters_of_every_age():
    """Code points that Unicode versions differ on, between letters and signs."""
    model = bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))
    points = [0x558, 0x1C89, 0xA7CB, 0xA7D2, 0x10D40, 0x10D50, 0x10D70, 0x11380, 0x13460, 0x16EA0, 0x1E5F1, *rng.sample(range(0x80, 0xD800), 4000), *rng.sample(range(0xE000, 0x30000), 4000)]
    texts = [f"a{chr(c)}'!" for c in points]
    want = library("word_bpe_49k.json")
    assert [c for c, t, r in zip(points, texts, model.encode(texts), strict=True) if r[1] != " ".join(map(str, want(t)))] == []


def test_repeats_among_millions_of_words():
    ids = np.arange(2_200_000)
    assert quality.repeat_words(ids) == 0
    assert quality.repeat_words(np.concatenate((ids, ids[5:8]))) == 6
    assert quality.repeat_words(np.array([3_000_000, 1, 2, 9, 3_000_000, 1, 2])) == 6

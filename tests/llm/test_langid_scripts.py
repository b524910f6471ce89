"""Language ID where the samples hold more letters than a byte can number."""

import random

import numpy as np
import pytest

from veladura.llm import langid

rng = random.Random(11)
LATIN = [chr(c) for c in range(0x61, 0x500) if chr(c).isalpha() and chr(c).lower() == chr(c)][:280]
HAN = [chr(c) for c in range(0x4E00, 0x4E00 + 1500)]
ALPHABETS = {"latin": LATIN, "han_a": HAN[:500], "han_b": HAN[500:1000], "han_c": HAN[1000:], "hangul": [chr(c) for c in range(0xAC00, 0xAC00 + 700)]}
WORDS = {k: ["".join(rng.choices(v, k=rng.randint(2, 4))) for _ in range(300)] for k, v in ALPHABETS.items()}


def text(name, n):
    return " ".join(rng.choices(WORDS[name], k=n))


@pytest.fixture(scope="module")
def parser():
    return langid.Parser(tuple((k, text(k, 4000)) for k in sorted(WORDS)), langid.Params())


def test_every_script_is_told_apart(parser):
    assert len(LATIN) == 280
    names = [k for k in sorted(WORDS) for _ in range(5)]
    got = parser.answer([text(k, 60) for k in names])
    assert [g[0] for g in got] == names
    assert min(score for _, score in got) > 0.3


def test_a_script_never_learned_gets_no_good_score(parser):
    thai = [chr(c) for c in range(0x0E01, 0x0E2F)]
    ((_, score),) = parser.answer([" ".join("".join(rng.choices(thai, k=3)) for _ in range(80))])
    assert score < 0.1
    assert not any((parser.symbols(text(k, 4000)) == 2).any() for k in WORDS)


@pytest.mark.parametrize("name", ["latin", "han_b"])
def test_phrases_are_the_longest_matches(parser, name):
    k = sorted(WORDS).index(name)
    sample = text(name, 400)
    own = langid.Parser(((name, sample), ("other", text("hangul", 3000))), langid.Params(window=512))
    string = lambda t: "".join(map(chr, own.symbols(t).tolist()))
    words = [*rng.choices(WORDS[name], k=40), *rng.choices(WORDS["hangul"], k=5)]
    probe = " ".join(rng.sample(words, len(words)))
    symbols = own.symbols(probe)[:512]
    grid = np.zeros((512, 1), symbols.dtype)
    grid[: len(symbols), 0] = symbols
    have, data, at, n = string(sample), "".join(map(chr, symbols.tolist())), 0, 0
    while at < len(data):
        size = 1
        while at + size < len(data) and data[at : at + size + 1] in have:
            size += 1
        at, n = at + size, n + 1
    assert own.phrases(grid)[0, 0] == n and k >= 0


def test_moves_take_no_more_room_with_more_letters():
    own = langid.Parser((("han", "".join(rng.choices([chr(c) for c in range(0x4E00, 0x4E00 + 12000)], k=24000))),), langid.Params())
    assert own.width > 9000 and len(own.autos[0][0]) < 300_000

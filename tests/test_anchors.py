"""Patterns are tried at their anchors only, and find there what they find everywhere; fixed words are met by a tree of letters."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veladura.functions import fixed as X
from veladura.functions import lexicon as L
from veladura.functions.spans import TITLE, Find, Scanned, _index, _steps, folded, has_any, is_any, strip
from veladura.operators import audit, context, detect
from veladura.plans import cases

rng = random.Random(41)
OLD = (*context.REGEX, *context.ADDRESSES, *context.PHONES)
TABLES = {
    "detect": tuple(f for r in detect.RULES.values() for f in r.finds),
    "audit": tuple(f for r in audit.FINDERS.values() for f in r.finds),
    "old": (*(f for r in OLD for f in r.finds), context.TOKEN, Find(X.OLD_TITLE_CASE, anchors=(TITLE,)), audit.EVAL_EMAIL, audit.EVAL_DNI),
}
TEXTS = [re.sub(r"\{n\}", "\n", re.sub(r"\{[ck]\d*\}", "00123456", cases.bare(s))) for s in (*cases.SENTENCES, *cases.LEAKY, cases.OLD, cases.PLACES, cases.HARD)]


def mixed(n: int) -> str:
    parts = re.findall(r"\w+|\s+|[^\w\s]+", " ".join(rng.sample(TEXTS, n)))
    odd = ("\n", " ", "\xa0", "\t", ".", ",", ":", "°", "İ", "ſ", "K", "ß", "x@y.pe", "٣٤٥", "sala", "EXP-", "n°", "")
    return "".join(rng.choice(odd) if (x := rng.random()) < 0.08 else p.upper() if x < 0.14 else p.capitalize() if x < 0.18 else p for p in parts)


@pytest.mark.parametrize("name", TABLES)
def test_a_table_loses_no_match(name):
    finds = TABLES[name]
    for text in (*TEXTS, *(mixed(6) for _ in range(120))):
        scanned = Scanned(text, _index(finds))
        for find, step in zip(finds, _steps(finds), strict=True):
            if find.inside is None:
                assert [m.span() for m, _ in scanned.places(step)] == [m.span() for m in re.compile(find.pattern, find.flags).finditer(text)], find.pattern


@pytest.mark.parametrize("name", TABLES)
def test_all_patterns_have_anchors(name):
    """Between what they look for hardly any pattern is tried."""
    finds = TABLES[name]
    assert all(f.anchors or f.inside for f in finds)
    scanned = Scanned("x. " + "=" * 5000 + " Ana vive lejos", _index(finds))
    assert sum(len(scanned.begins(step)) for step in _steps(finds) if step.inside is None) < 20


def test_folded_is_casefold():
    for text in ("Ñandú N° ÁÉ", "İstanbul ıſK", "straße", "“El” – año", "Привет, МИР! " * 3 + "".join(map(chr, range(0x410, 0x450)))):
        assert folded(text) == text.replace("İ", "i").replace("ı", "i").casefold()


def test_fixed_words(spark):
    words = (L.NO_NAMES, L.WHITELIST, L.CONNECTORS, X.PERSON_TRIGGERS, X.MONEY)
    pool = [w for own in words for w in own[:40]]
    texts = ["", "\n", *pool, *(w[:-1] for w in pool), *(w + "s" for w in pool), *(w + "\n" for w in pool), *(" a" + w for w in pool)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", *(is_any(F.col("t"), own).alias(f"is{i}") for i, own in enumerate(words)), *(has_any(F.col("t"), own).alias(f"has{i}") for i, own in enumerate(words))).collect()
    for r in got:
        for i, own in enumerate(words):
            assert r[f"is{i}"] == (r.t in own) and r[f"has{i}"] == any(w in r.t for w in own), (r.t, i)


def test_strip(spark):
    texts = ["", " ", "a", "\x1c a b \x85　", "\n\ta \xa0", "​a​"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == [t.strip() for t in texts]

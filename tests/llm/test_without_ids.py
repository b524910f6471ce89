"""Tables whose ids are null, or all the same: nothing may hang on them."""

import random

import pytest
from pyspark.sql import functions as F

from veladura.llm import jaccard, langid, vafile

rng = random.Random(3)
WORDS = {k: [f"{k}{''.join(rng.choices('abcdefghij', k=5))}" for _ in range(300)] for k in ("en", "de", "fr", "es")}


@pytest.mark.parametrize("ids", [None, 0, 7, "own"])
def test_every_language_is_learned(spark, ids):
    p = langid.Params(rows=12)
    rows = [(i if ids == "own" else ids, " ".join(rng.choices(WORDS[k], k=30)), k) for i in range(60) for k in WORDS for _ in range(5 if k == "en" else 1)]
    rows += [(ids if ids != "own" else 9, "the same text of one language alone", "xx")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    sample = langid.fit(docs, F.lit(True), p)
    assert [k for k, _ in sample] == ["de", "en", "es", "fr", "xx"]
    assert all(len(t.split("\n")) == 12 for _, t in sample)
    got = langid.identify(docs, sample, p).where("lang <> lang_pred").count()
    assert got == 0


def plain(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [d]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("ids", ["null", "equal", "some"])
def test_near_duplicates_do_not_hang_on_ids(spark, ids):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(5):
        base = rng.choices(words, k=60)
        for i in range(12):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(60)] = rng.choice(words)
            rows.append(({"null": None, "equal": 4, "some": rng.choice([None, k, i])}[ids], " ".join(own)))
    rows += [(None, None), (4, ""), rows[0], rows[0]]
    for p in (jaccard.Params(), jaccard.Params(block=3, first_checks=1, bits=64, heavy=50, heavy_from=1, flush=100, broadcast=0)):
        got = jaccard.clusters(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), p).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_marks_of_several_lengths(spark):
    rows = [(i, [rng.randint(-900, 900) for _ in range(n)]) for i in range(30) for n in (0, 2, 5)]
    vectors = spark.createDataFrame(rows, "vec_id long, x array<long>").repartition(4)
    got = vafile.marks(vectors, 4)
    assert set(got) == {2, 5}
    for dim, (low, step) in got.items():
        own = [x for _, x in rows if len(x) == dim]
        assert low.tolist() == [min(c) for c in zip(*own, strict=True)]
        assert step.tolist() == [max(1, -(-(max(c) - min(c) + 1) // 16)) for c in zip(*own, strict=True)]


@pytest.mark.parametrize("p", [jaccard.Params(), jaccard.Params(block=3, bits=64, heavy=50, heavy_from=1, flush=100, broadcast=0)])
def test_every_link_is_given(spark, p):
    words = [f"v{i}" for i in range(300)]
    texts = []
    for _ in range(3):
        base = rng.choices(words, k=220)
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(220)] = rng.choice(words)
            texts.append(" ".join(own))
    texts += [texts[0], texts[0], texts[20], texts[20].upper(), None, "", "solo", "solo", " ".join(rng.choices(words, k=50))]
    rows = [(rng.choice([None, i]), t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    members, pairs = jaccard.links(docs, p)
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    near = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)
    different = sorted(set(sets), key=sorted)
    want = sum(near(a, b) for i, a in enumerate(different) for b in different[:i])
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) == want > 100 and all(a != b for a, b in got)
    counts = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.n_links) for r in jaccard.link_counts(members, pairs).collect())
    assert counts == sorted((d is None, d or 0, len(s), sum(near(s, o) for j, o in enumerate(sets) if j != i)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))

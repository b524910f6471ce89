"""The pipeline stage by stage against plain versions, on a table with nulls, repeats, copies, junk and secrets."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from veladura.llm import langid, quality, secrets

rng = random.Random(21)
WORDS = {
    "en": "the of and to in is that it was for on are as with his they at be this have from or one had by word but not what all were we when".split(),
    "es": "el de la que y a en un ser se no haber por con su para como estar tener le lo todo pero mas hacer o poder decir este ir otro ese si".split(),
}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"


def prose(lang, n):
    return " ".join(w + str(rng.randint(0, 60)) if rng.random() < 0.5 else w for w in rng.choices(WORDS[lang], k=n))


@pytest.fixture(scope="module")
def rows():
    out = []
    for i in range(60):
        lang = ("en", "es")[i % 2]
        out.append((i, prose(lang, rng.randint(60, 160)), lang))
    out += [(100, out[3][1], "en"), (99, out[3][1].upper(), "en")]  # exact copies
    out.append((101, out[4][1] + " cola", "es"))  # a near copy
    out += [(None, prose("en", 90), "en"), (None, prose("es", 90), None), (5, prose("es", 80), "es"), (5, prose("es", 80), "es")]  # null and repeated ids
    out.append((102, None, "en"))
    out += [(103, "", None), (104, "123 456 ... !!", "en"), (105, "corto texto", "es"), (106, "la la " * 200, "es"), (107, "#$%& " * 100, "en")]
    out.append((108, prose("en", 70) + " password=abcdef12 fin AKIA" + "B" * 16, "en"))
    out.append((109, prose("en", 3000), "en"))
    return [(i, t, lang, "web", None if t is None else len(t)) for i, t, lang in out]


@pytest.fixture(scope="module")
def stages(spark, rows, tmp_path_factory):
    """The rows that every stage is given and gives."""
    at = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{at}/documents.parquet")
    docs, out = spark.read.parquet(f"{at}/documents.parquet"), [("input", rows)]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, at), name)
        out.append((name, [tuple(r) for r in docs.collect()]))
    return at, dict(out), docs.columns


def test_stages_are_those_of_the_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "ngram_jaccard", "secret_scans", "packing"]


def test_language_id_drops_what_has_no_letter(stages):
    _, got, _ = stages
    want = [r for r in got["input"] if r[1] and any(c.isalpha() for c in r[1])]
    assert Counter(got["language_id"]) == Counter(want)


def test_quality_rules_judge_their_own_input(spark, stages):
    """Kept is what the base rules and the distances of a plain computation let pass."""
    _, got, _ = stages
    given = got["language_id"]
    p = quality.Params()
    refs = quality.fit(spark.createDataFrame(given, COLUMNS), p)

    def distance(a, b):
        pa, pb = np.asarray(a, float) / sum(a), np.asarray(b, float) / sum(b)
        m = (pa + pb) / 2
        kl = lambda x: sum(u * np.log2(u / v) for u, v in zip(x, m) if u > 0)
        return max(0.0, (kl(pa) + kl(pb)) / 2) ** 0.5

    def kept(text):
        words = re.findall("[^\x20\x09-\x0d]+", text)
        n = len(words)
        seen = defaultdict(list)
        for i in range(n - 2):
            seen[tuple(words[i : i + 3])].append(i)
        again = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
        if n < 50 or 100 * len(again) > 50 * n:
            return False
        best = None
        for chars, common, counts in refs.values():
            own = quality.char_counts([text])[0]
            hist = np.zeros(len(common) + 1)
            for w in text.encode().lower().split():
                hist[common.get(w, len(common))] += 1
            d = distance(own, chars), distance(hist, counts)
            if best is None or sum(d) < sum(best):
                best = d
        return best[0] <= p.char_limit + p.char_noise / n**0.5 and best[1] <= p.word_limit + p.word_noise / n**0.5

    assert Counter(got["quality_rules"]) == Counter(r for r in given if kept(r[1]))
    assert 50 < len(got["quality_rules"]) < len(given)


def test_one_row_of_each_group_stays(stages):
    _, got, _ = stages
    given = got["quality_rules"]

    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", t.translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(r[1]) for r in given]
    root = list(range(len(given)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(given)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for i, r in enumerate(given):
        groups[find(i)].append(r)
    want = Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values())
    assert Counter(got["ngram_jaccard"]) == want
    assert sum(r[0] is None for r in got["ngram_jaccard"]) == 2 and sum(r[0] == 5 for r in got["ngram_jaccard"]) >= 2
    assert len(want) < len(given)


def test_secrets_are_replaced(stages):
    _, got, _ = stages

    def clean(t):
        out, last = [], 0
        for kind, a, b in secrets.scan(t):
            if a >= last:
                out += [t[last:a], f"[{kind.upper()}]"]
            last = max(last, b)
        return "".join(out) + t[last:]

    want = Counter((i, clean(t), lang, source, len(clean(t))) for i, t, lang, source, _ in got["ngram_jaccard"])
    assert Counter(got["secret_scans"]) == want
    (row,) = [r for r in got["secret_scans"] if r[0] == 108]
    assert "[ASSIGN]" in row[1] and "[ACCESS]" in row[1]


def test_pieces_are_all_ids_in_sequences(stages):
    _, got, columns = stages
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.no_truncation()
    tok.no_padding()
    pieces = [dict(zip(columns, r, strict=True)) for r in got["packing"]]
    want = Counter()
    for i, t, *_ in got["secret_scans"]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            want[i, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces) == want
    by = defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 2048
    assert len(by) <= -(-sum(p["length"] for p in pieces) // 2048) + 1


def test_run_is_its_stages(spark, stages):
    at, got, columns = stages
    out = corpus_pipeline.run(spark, at)
    assert out.columns == columns and Counter(r.doc_id for r in out.collect()) == Counter(dict(zip(columns, r, strict=True))["doc_id"] for r in got["packing"])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_nothing_to_learn_from(spark, tmp_path):
    spark.createDataFrame([(1, None, None, None, None), (None, "", None, None, 0)], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_identify_keeps_an_empty_table_empty(spark):
    docs = spark.createDataFrame([], COLUMNS)
    assert langid.identify(docs, langid.fit(docs, F.lit(True))).collect() == []

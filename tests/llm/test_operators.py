"""The ten operators against plain versions, on small tables with nulls, empty and long texts, ties and repeats."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veladura.llm import bpe, brown_lm, chat, components, jaccard, langid, packing, quality, secrets, vafile, warc

rng = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]
ODD = [None, "", " \n\t ", "uno", "a b c d", "x" * 20000, "Ünï ÇÔDÉ 日本 😀 \x00 \x1c end", "same text of five words here", "same text of five words here"]


def sentence(n, words=WORDS):
    return " ".join(rng.choices(words, k=n))


def near_copies():
    texts = []
    for _ in range(6):
        base = sentence(90).split()
        for _ in range(9):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(90)] = rng.choice(WORDS)
            texts.append(" ".join(own))
    return texts + [sentence(80) for _ in range(20)] + ODD


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], "extra", i) for i, t in enumerate(near_copies())]
    rows.append(rows[-1])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n string, rank long").repartition(5)


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_clusters(rows):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("p", [jaccard.Params(), jaccard.Params(block=3, first_checks=1, bits=64, heavy=50, heavy_from=1, flush=100, broadcast=0)])
def test_jaccard(docs, p):
    want = plain_clusters([(r.doc_id, r.text) for r in docs.collect()])
    got = jaccard.clusters(docs, p).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_jaccard_empty(docs):
    assert jaccard.clusters(docs.limit(0)).collect() == []


def test_word_hashes_are_by_word():
    h, n = jaccard.word_hashes(["Ab cd  ab", None, "", "cd\tAB\x0b"])
    assert n.tolist() == [3, 0, 0, 2]
    assert h[0] == h[2] == h[4] and h[1] == h[3] != h[0]
    a, b = jaccard.shingle_sets(["p q r s t u", "Q R S T U"], 5)
    assert len(a) == 2 and len(b) == 1 and b[0] in a


def test_components(spark):
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}


def test_brown_lm(docs):
    rows, model = brown_lm.scored(docs, F.col("doc_id") % 10 != 0, brown_lm.Params(head=50, signatures=16, lookup=60, classes=8, flush=64))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    train = Counter()
    for d, t in texts:
        if d % 10:
            train.update([*words(t), ""])
    n, v = sum(train.values()), len(train)
    assert model.tokens == n and model.distinct == v
    want = Counter((d, len(words(t)) + 1, sum(train[w] > 0 for w in [*words(t), ""]), round(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), ""]), 6)) for d, t in texts)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows.collect()) == want


def test_brown_lm_probabilities_sum_to_one(spark):
    train = spark.createDataFrame([("a b a c e",), ("b a d f",), ("c e f g a b",), (None,)], "text string")
    p = brown_lm.Params(head=3, signatures=4, lookup=5, classes=3)
    model, counts = brown_lm.fit(train, p)
    assert 3 < len(model.words) <= 6
    seen = {bytes(r.word): r.n for r in counts.collect()}
    total = np.zeros(p.classes)
    for i, w in enumerate(model.words):
        total[model.classes[i]] += 10 ** model.emit[i]
    for k in range(p.signatures):
        unit = len(model.words) + k
        # the rare words of a bucket, and one place for all that it has not seen
        here = [n for w, n in seen.items() if w not in model.words and brown_lm.signature(w, p) == k]
        total[model.classes[unit]] += 10 ** model.emit[unit] * (sum(n + 0.1 for n in here) + 0.1)
    used = [c for c in range(p.classes) if (model.classes == c).any()]
    assert np.allclose(total[used], 1) and np.allclose((10**model.steps).sum(1), 1)


def test_brown_lm_scores_are_those_of_the_plain_model(docs):
    p = brown_lm.Params(head=20, signatures=16, lookup=60, classes=8, flush=64)
    train = docs.where(F.col("doc_id") % 10 != 0).select("text")
    model, counts = brown_lm.fit(train, p)
    assert len(model.words) > 40 and (model.classes >= 0).all()
    seen = {bytes(r.word): r.n for r in counts.collect()}
    rank = {w: i for i, w in enumerate(model.words)}
    want = Counter()
    for r in docs.collect():
        score, before = 0.0, 0
        for w in [*(x.encode() for x in words(r.text)), b""]:
            unit = rank.get(w, len(rank) + brown_lm.signature(w, p))
            cls = int(model.classes[unit])
            score += model.steps[before, cls] + model.emit[unit] + (0 if w in rank else math.log10(seen.get(w, 0) + 0.1))
            before = cls
        want[r.doc_id, round(score, 6)] += 1
    assert Counter((r.doc_id, round(r.score, 6)) for r in brown_lm.score(docs, model, counts).collect()) == want


def test_brown_lm_class_bigrams_are_those_of_the_texts(spark):
    """Words beyond the head get the class that suits their neighbours; the grid counts final classes."""
    texts = [" ".join(x for i in range(40) for x in (rng.choice(["el", "la"]), rng.choice([f"n{j}" for j in range(12)]), rng.choice([f"v{j}" for j in range(12)]))) for _ in range(60)]
    p = brown_lm.Params(head=12, signatures=2, lookup=40, classes=4, rounds=8)
    model, _ = brown_lm.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), p)
    cls = dict(zip(model.words, model.classes[: len(model.words)].tolist(), strict=True))
    grid = np.zeros((4, 4))
    for t in texts:
        ring = [0, *(cls[w.encode()] for w in t.split()), 0]
        for a, b in zip(ring, ring[1:]):
            grid[a, b] += 1
    assert np.allclose(model.steps, np.log10((grid + 0.5) / (grid.sum(1, keepdims=True) + 2)))
    nouns, verbs = Counter(cls[f"n{j}".encode()] for j in range(12)), Counter(cls[f"v{j}".encode()] for j in range(12))
    assert nouns.most_common(1)[0][1] + verbs.most_common(1)[0][1] >= 20 and nouns.most_common(1)[0][0] != verbs.most_common(1)[0][0]


@pytest.mark.parametrize("most, want", [(100, 6), (6, 6), (5, 3), (3, 3), (2, 2), (1, 1), (0, 0)])
def test_frequent_words(spark, most, want):
    rows = [(b"", 0, 99)] + [(w.encode(), 0, n) for w, n in (("a", 1000), ("b", 1001), ("c", 7), ("d", 1), ("e", 1), ("f", 1))]
    got = brown_lm.frequent(spark.createDataFrame(rows, "word binary, sig int, n long"), most).collect()
    assert len(got) == want and all(r.n >= 1 for r in got)


def test_exchange_raises_likelihood():
    pairs = np.zeros((9, 9))
    for a in range(1, 9):
        for b in range(1, 9):
            pairs[a, b] = 20 if (a % 2) != (b % 2) else 1
    pairs[0, 1:] = pairs[1:, 0] = 3
    cls = brown_lm.exchange(pairs, brown_lm.Params(classes=3, rounds=20))
    assert cls[0] == 0
    odd, even = {cls[i] for i in range(1, 9, 2)}, {cls[i] for i in range(2, 9, 2)}
    assert len(odd) == len(even) == 1 and odd != even


def test_packing(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.packed(docs, path, capacity=64).collect()
    left = Counter()
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 64):
            part = ids[at : at + 64]
            left[(r.doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == left
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_best_fill_is_optimal():
    for _ in range(60):
        cap = rng.randint(5, 40)
        counts = np.zeros(cap + 1, np.int64)
        for _ in range(rng.randint(1, 7)):
            counts[rng.randint(1, cap)] += rng.randint(1, 3)
        sums = {0}
        for x in np.flatnonzero(counts):
            for _ in range(counts[x]):
                sums |= {s + x for s in sums if s + x <= cap}
        got = packing.best_fill(counts, cap)
        assert sum(k * n for k, n in got.items()) == max(sums)
        assert all(n <= counts[k] for k, n in got.items())


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\s>[\\INST]", "", None, "plain", "[ROLE] x\n[/ROLE] \\\\", " </s>", "a\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool[ROLE]", "a\\nb\nc\\", None]), rng.choice(nasty), "x") for c in (1, 2, None) for t in range(12)]
    rows += rows[:3]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    pieces = chat.pieces(chat.as_events(table))
    got = {r.conv_id: r for r in chat.read_back(pieces, in_order=True).collect()}
    assert got == {r.conv_id: r for r in chat.read_back(pieces.repartition(7)).collect()}
    whole = {r.conv: r for r in chat.formatted(chat.as_events(table)).collect()}
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert chat.parse(whole[c].formatted) == [(r, x) for _, r, x in turns] and len(whole[c].formatted) == got[c].formatted_chars
        assert "".join(chat.unescape(whole[c].formatted[s.start : s.stop]) for s in whole[c].spans) == loss


def test_chat_events_throw_drafts_away(spark):
    """Turns come in several deltas, with an edit or a regeneration on the way."""
    table = spark.createDataFrame([(1, 0, "user", "abc"), (1, 1, "assistant", "defgh"), (1, None, "x", "")], "conv_id long, turn long, role string, text string")
    events = chat.as_events(table)
    assert sorted(r.kind for r in events.collect()) == ["delta"] * 7 + ["edit"] * 2 + ["regenerate"]
    assert [(r.role, r.text) for r in chat.messages(events).orderBy("seq").collect()] == [("x", ""), ("user", "abc"), ("assistant", "defgh")]


def test_chat_misses_a_lost_piece(spark):
    log = spark.createDataFrame([(1, 0, "user", "abc"), (1, 1, "user", "d"), (1, 2, "user", "e")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="is missing"):
        chat.read_back(chat.pieces(chat.as_events(log)).where("position <> 1")).collect()


def test_chat_folds_events(spark):
    log = [(1, 0, "m1", "delta", "user", "he"), (1, 1, "m1", "delta", None, "llo"), (1, 2, "m2", "delta", "assistant", "bad"), (1, 3, "m2", "regenerate", None, None), (1, 4, "m2", "delta", None, "good"), (1, 5, "m1", "edit", None, "hi")]
    out = chat.formatted(spark.createDataFrame(log, "conv long, seq long, msg string, kind string, role string, text string")).first()
    assert out.formatted == "<s>[INST] hi [/INST] good </s>"
    assert [out.formatted[s.start : s.stop] for s in out.spans] == ["good"]
    assert chat.parse(out.formatted) == [("user", "hi"), ("assistant", "good")]


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", "", None, "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "<p>b</p>"]
    pages = spark.createDataFrame([(i, f"http://x/{i} y\n" if i else None, h, 1) for i, h in enumerate(html)], "page_id long, url string, html string, digest int")
    warc.write(pages, f"{tmp_path}/w")
    rows = {r.record_id: r for r in warc.read(spark, f"{tmp_path}/w").collect()}
    assert all(r.gap is None for r in rows.values()) and len(rows) == len(html)
    last = {h or "": i for i, h in enumerate(html)}
    for i, h in enumerate(html):
        r, data = rows[f"<urn:page:{i}>"], (h or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert r.record_type == ("response" if last[h or ""] == i else "revisit")
        assert r.refers_to == (None if last[h or ""] == i else f"<urn:page:{last[h or '']}>")


def record(body: bytes, **more) -> bytes:
    head = {"WARC-Type": "resource", "Content-Length": str(len(body)), **more}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def test_warc_salvage_plain_and_members():
    parts = [record(b"one"), record(b"two" * 50), record(b"three")]
    data = bytearray(b"".join(parts))
    data[len(parts[0]) + 20] ^= 255  # breaks the second record's header
    data[len(parts[0]) + 33 : len(parts[0]) + 36] = b"999"
    got = [*warc.salvage(bytes(data))]
    assert [x.block for x in got if isinstance(x, warc.Record)] == [b"one", b"three"]
    (gap,) = [x for x in got if isinstance(x, warc.Gap)]
    assert (gap.start, gap.stop) == (len(parts[0]), len(parts[0]) + len(parts[1]))
    import gzip

    members = [gzip.compress(x) for x in parts]
    broken = bytearray(b"".join(members))
    broken[len(members[0]) + len(members[1]) - 6] ^= 255  # the second member's checksum
    got = [*warc.salvage(bytes(broken))]
    assert b"three" in [x.block for x in got if isinstance(x, warc.Record)]
    assert [x.reason for x in got if isinstance(x, warc.Gap)] == ["broken member"]
    assert [*warc.salvage(b"")] == []
    assert [type(x) for x in warc.salvage(parts[0][:-3])] == [warc.Gap]


def test_langid(spark):
    vocab = {"xx": ["pala", "kora", "mipa", "tola"], "yy": ["strengh", "wurz", "ichtel", "schm"]}
    rows = [(i, sentence(40, vocab[("xx", "yy")[i % 2]]), ("xx", "yy")[i % 2]) for i in range(60)]
    rows += [(100, None, "xx"), (101, "123 !!", "yy"), (102, "", None), (103, sentence(3000, vocab["yy"]), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("old"))
    sample = langid.fit(docs, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in langid.identify(docs, sample).collect()}
    assert all(got[i].lang_pred == ("xx", "yy")[i % 2] for i in range(60))
    assert got[103].lang_pred == "yy" and all(0 <= r.score <= 1 for r in got.values())
    assert {got[i].lang_pred for i in (100, 101, 102)} == {"und"}
    assert langid.identify(docs, ()).select("lang_pred").distinct().collect()[0][0] == "und"
    assert langid.fit(docs.limit(0), F.lit(True)) == ()


def test_langid_phrases_are_the_longest_matches():
    own = langid.Parser((("a", "abracadabra abba"),), langid.Params(window=64))
    text = own.symbols("abracad xx brabba abracadabra")
    grid = np.zeros((64, 1), np.uint8)
    grid[: len(text), 0] = text
    sample, at, n = own.symbols("abracadabra abba").tobytes(), 0, 0
    data = text.tobytes()
    while at < len(data):
        size = 1
        while at + size < len(data) and data[at : at + size + 1] in sample:
            size += 1
        at, n = at + size, n + 1
    assert own.phrases(grid)[0, 0] == n


def test_quality(docs):
    rows = quality.judged(docs, quality.fit(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        t = r.text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if tri[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_distance_bounds():
    a = np.array([[1.0, 0, 0], [0, 3, 0], [0, 0, 0]])
    got = quality.distance(a, np.array([0.0, 5, 0]))
    assert np.allclose(got, [1, 0, 1])


@pytest.mark.parametrize("bits, block, queries, dim", [(2, 40, 3, 6), (4, 64, 2, 7), (4, 8192, 512, 1), (6, 50, 4, 5), (8, 90, 4, 6)])
def test_vafile(spark, bits, block, queries, dim):
    vec = np.random.default_rng(dim).normal(size=(300, dim)).astype(np.float32)
    vec[50:60] = vec[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vec)] + [(7, vec[7].tolist()), (50, vec[9].tolist()), (350, [0.0] * dim)]
    none = [(300, None), (301, [None] * dim), (302, [math.nan] * dim), (303, [math.inf] + [0.0] * (dim - 1)), (None, vec[1].tolist()), (400, [1.0] * (dim + 1)), (500, [])]
    table = spark.createDataFrame([(*r, "extra", 1) for r in rows + none], "vec_id long, embedding array<float>, score string, row int")
    got = vafile.top_k(vafile.as_integers(table), F.col("vec_id") % 50 == 0, 5, bits, block=block, queries=queries).collect()
    x = [(i, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v in rows]
    want = []
    for a, (q, own) in enumerate(x):
        if q % 50 == 0:
            best = sorted((-int(own @ v), i) for b, (i, v) in enumerate(x) if a != b)[:5]
            want += [(q, k + 1, i, -v) for k, (v, i) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_vafile_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0, -2.0]), (1, [0.5, 0.25])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vafile.top_k(vafile.as_integers(table), F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 128 - 512 * 64)]
    assert vafile.top_k(vafile.as_integers(table.limit(0)), F.lit(True)).collect() == []


def test_vafile_bounds_hold():
    """Packed cells come back as they were, and every exact product lies between its bounds."""
    g = np.random.default_rng(3)
    for bits, dim in ((4, 5), (4, 8), (5, 3), (8, 4)):
        x, q = g.integers(-900, 900, (60, dim)), g.integers(-900, 900, (9, dim))
        low = x.min(0)
        step = np.maximum(1, -(-(x.max(0) - low + 1) // (1 << bits)))
        cells = (x - low) // step
        assert cells.max() < 1 << bits
        assert (vafile.unpack(vafile.pack(cells, bits), dim, bits) == cells).all()
        lower, upper = vafile.bounds(q, cells.astype(np.uint8), low, step)
        assert (lower <= x @ q.T).all() and (x @ q.T <= upper).all()


def test_bpe_matches_the_library(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    more = ["I'LL don'T", "ΑΣ ΌΣΟΣ", "x<|endoftext|>y <|ENDOFTEXT|>", "İ ﬁ ǅ", "a\x1cb\x85c", "aaaaaaaaaaaaaaaaaaaaa", "é 가", "日本語テスト!!!???"]
    texts = [r.text for r in docs.collect()] + more + ["".join(rng.choices("abcdefgh", k=rng.randint(1, 60))) for _ in range(300)]
    for t, (n, ids, text) in zip(texts, bpe.Bpe(path).encode(texts), strict=True):
        want = tok.encode(t or "", add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want)))
        assert text == tok.decode(want, skip_special_tokens=False)
    assert bpe.digests(docs, path).count() == docs.count() == bpe.encoded(docs, path).count()


SECRETS = [
    'password = "hunter22" and PASSWORD:abc',
    "token:token:abcdefg secret=abcdef",
    "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 12 + " AKIA1",
    "deadbeef" * 3 + "g" + "0123456789abcdef" * 2,
    "paßword=abcdefgh api_key='x.y/z+1==' toKen=qwerty",
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----",
    "",
    None,
]


def test_secrets(spark):
    rows = [(i, t) for i, t in enumerate(SECRETS)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    got = secrets.found(docs).collect()
    assert len(got) == len(rows)
    assign = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in got:
        t = SECRETS[r.doc_id] or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = [(s.start, secrets.BASE.index(s.kind), s.stop) for s in r.spans if s.kind in secrets.BASE]
        assert base == sorted(want)
    clean = {r.doc_id: r.text for r in secrets.redacted(spark.createDataFrame(rows[:8], "doc_id long, text string")).collect()}
    assert clean[0] == '[ASSIGN]" and PASSWORD:abc' and clean[5] == "[PEM]" and clean[6] == "" and clean[7] is None


def test_secret_ledger_scans_only_what_it_lacks(spark, tmp_path):
    """Pairs of blob and version that the ledger has are not scanned again: what it says of them is believed."""
    old = spark.createDataFrame([(1, "secret=abcdefg"), (2, "plain"), (5, "-----BEGIN PRIVATE KEY-----")], "doc_id long, text string")
    ledger = secrets.update(old, versions=("base-1",))
    assert sorted((r.rules, len(r.spans)) for r in ledger.collect()) == [("base-1", 0), ("base-1", 0), ("base-1", 1)]
    told = ledger.withColumn("spans", F.when(F.size("spans") == 0, F.array(F.struct(F.lit("hex").alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("stop")))).otherwise(F.col("spans")))
    both = old.union(spark.createDataFrame([(3, "token=zyxwvut"), (4, "secret=abcdefg"), (6, None)], "doc_id long, text string"))
    after = secrets.update(both, told)
    # five blobs under two versions; three of them were known under one
    assert after.count() == 10 and after.groupBy("blob", "rules").count().where("count > 1").count() == 0
    assert secrets.update(both, after).count() == 10
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.findings(both, after).collect()}
    assert got == {1: ["assign"], 2: ["hex"], 3: ["assign"], 4: ["assign"], 5: ["hex", "pem"], 6: []}
    assert {r.doc_id: [s.kind for s in r.spans] for r in secrets.found(both, ledger).collect()} == {1: ["assign"], 2: [], 3: ["assign"], 4: ["assign"], 5: ["pem"], 6: []}


def test_secret_query_is_that_of_one_scan(spark, tmp_path):
    from veladura.llm import queries

    rows = [(i, t) for i, t in enumerate(SECRETS * 3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.spans for r in queries.op10_secret_ledger(spark, str(tmp_path)).collect()}
    assert got == {i: ",".join(f"{k}:{a}:{b}" for k, a, b in secrets.scan(t or "")) for i, t in rows}


def test_json_of_vocabularies_is_readable():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            assert json.load(f)["model"]["type"] == "BPE"

"""Bottom-k sketches against plain sets of hashes."""

import hashlib
import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from veladura.llm import fingerprint

rng = random.Random(11)


def chained(values, seed=42):
    """Spark's xxhash64 of several values: each hash is the next one's seed."""
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_sketch(text, k, words=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    h = [chained([x]) for x in w]
    if len(h) >= words:
        out = {chained(h[i : i + words]) for i in range(len(h) - words + 1)}
    elif h:
        acc = 0
        for x in h:
            acc = chained([acc, x])
        out = {acc}
    else:
        out = set()
    return sorted(out)[:k]


def likeness(a, b, k):
    if not a and not b:
        return 1.0
    u = sorted(set(a) | set(b))[:k]
    return len(set(u) & set(a) & set(b)) / len(u)


def documents():
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "😀"]
    texts = [" ".join(rng.choices(words, k=n)) for n in (0, 1, 4, 5, 6, 30, 200, 3000)] + [None, "", " \t\n", "😀" * 10, "x" * 20000]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (9, "another text under a used id"), (None, "no id here at all"), (None, None), (-(1 << 63), "least"), ((1 << 63) - 1, "most")]


def test_compared_against_plain_version(spark):
    rows, k = documents(), 16
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, next string, copies string").repartition(3)
    got = fingerprint.compared(docs, k).collect()
    assert len(got) == len(rows)
    distinct = {(i, t or "") for i, t in rows}
    order = sorted(distinct, key=lambda r: (r[0] is None, -(r[0] or 0), chained_key(r)))
    want = {}
    for at, (i, t) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        third = len(t) // 3
        edit = t[: len(t) - third] + after[:third]
        a, b, c = (plain_sketch(x, k) for x in (t, edit, after))
        want[i, t] = (len(t), hashlib.sha256(edit.encode()).hexdigest(), likeness(a, b, k), likeness(a, c, k), a, b)
    plain = {(i, t): v for (i, t), v in want.items()}
    told = sorted((r.doc_id or 0, r.doc_id is None, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.fingerprint, r.edited_fingerprint) for r in got)
    text = lambda s: "".join(f"{h & (1 << 64) - 1:016x}" for h in s)
    expected = []
    for i, t in rows:
        n, sha, near, after, a, b = plain[i, t or ""]
        expected.append((i or 0, i is None, n, sha, near, after, text(a), text(b)))
    assert told == sorted(expected)


def chained_key(row):
    """xxhash64(doc_id is null, text) as Spark hashes a boolean: as an integer of four bytes."""
    seed = xxhash.xxh64_intdigest(struct.pack("<i", row[0] is None), 42)
    seed = xxhash.xxh64_intdigest(row[1].encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_sketches_of_parts_merge_into_that_of_the_whole(spark):
    words = [f"w{i}" for i in range(500)]
    parts = [(key, " ".join(rng.choices(words, k=rng.randint(0, 200)))) for key in ("a", "b", None) for _ in range(20)] + [("empty", ""), ("empty", None)]
    df = spark.createDataFrame(parts, "key string, text string").withColumn("sketch", fingerprint.sketch(F.col("text"), 64))
    got = {r.key: list(r.sketch) for r in fingerprint.merged(df, ["key"], k=64).collect()}
    for key in ("a", "b", None, "empty"):
        every = set().union(*(plain_sketch(t, 1 << 30) for k, t in parts if k == key))
        assert got[key] == sorted(every)[:64]
    both = fingerprint.union(fingerprint.sketch(F.lit(parts[0][1]), 64), fingerprint.sketch(F.lit(parts[1][1]), 64), 64)
    (row,) = spark.range(1).select(both.alias("s")).collect()
    assert list(row.s) == sorted(set(plain_sketch(parts[0][1], 64)) | set(plain_sketch(parts[1][1], 64)))[:64]


def test_estimates_and_text_form(spark):
    words = [f"w{i}" for i in range(5000)]
    base = rng.choices(words, k=4000)
    rows = [(" ".join(base), " ".join(base[:3000] + rng.choices(words, k=1000))), (" ".join(base), " ".join(base[:1000])), ("", "a"), ("", "")]
    a, b = fingerprint.sketch(F.col("a"), 512), fingerprint.sketch(F.col("b"), 512)
    df = spark.createDataFrame(rows, "a string, b string").select(a.alias("a"), b.alias("b"))
    got = df.select(
        fingerprint.distinct(F.col("a"), 512).alias("n"), fingerprint.resemblance(F.col("a"), F.col("b"), 512).alias("j"),
        fingerprint.containment(F.col("a"), F.col("b"), 512).alias("c"), fingerprint.containment(F.col("b"), F.col("a"), 512).alias("d"),
        (fingerprint.read(fingerprint.told(F.col("a"))) == F.col("a")).alias("same"),
    ).collect()
    assert all(r.same for r in got)
    assert abs(got[0].n - 3996) < 600 and abs(got[0].j - 0.6) < 0.1 and abs(got[0].c - 0.75) < 0.1
    assert abs(got[1].j - 0.25) < 0.08 and abs(got[1].c - 0.25) < 0.08 and got[1].d > 0.97
    assert (got[2].n, got[2].j, got[2].c, got[2].d) == (0, 0.0, 1.0, 0.0) and (got[3].j, got[3].c) == (1.0, 1.0)


def test_no_documents_and_one(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprint.compared(none).collect() == []
    (row,) = fingerprint.compared(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    assert (row.n_chars, row.near_next) == (11, 1.0) and row.edited_sha256 == hashlib.sha256(b"a b c d a b").hexdigest()


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    plan = fingerprint.compared(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

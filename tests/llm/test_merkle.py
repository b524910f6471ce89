"""Merkle manifests against a plain tree."""

import hashlib
import random

from pyspark.sql import functions as F

from veladura.llm import merkle, queries

rng = random.Random(12)
DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp string, idx string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """Levels from the leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, i):
    """(place, siblings) up a tree."""
    out = []
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        out.append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
        i //= 8
    return out


def plain(rows):
    """(group, order, leaf) to a list of (group, leaf, proof, subroot, root)."""
    groups = {}
    for g, o, leaf in rows:
        groups.setdefault(g, []).append((o is not None, o or 0, leaf))
    trees = {g: tree([x[2] for x in sorted(v)]) for g, v in groups.items()}
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    top = tree([trees[g][-1][0] for g in order])
    return sorted((str(g), leaf, way(trees[g], i) + way(top, order.index(g)), trees[g][-1][0], top[-1][0]) for g in order for i, leaf in enumerate(trees[g][0]))


def check(spark, rows, held=1 << 16, parts=5):
    df = spark.createDataFrame(rows, "g string, o long, leaf string").repartition(parts)
    made = merkle.manifest(df, F.col("g"), [F.col("o")], F.col("leaf"), held)
    made = made.withColumn("folded", merkle.folded(F.col("leaf"), F.col("proof")))
    got = made.collect()
    assert sorted((str(r.row.g), r.leaf, [(s.pos, s.siblings) for s in r.proof], r.subroot, r.root) for r in got) == plain(rows)
    assert all(r.folded == r.root for r in got)


def test_trees_of_every_shape(spark):
    sizes = {"a": 1, "b": 2, "é": 8, "z": 9, None: 65, "hot": 600, **{f"g{i}": 1 for i in range(70)}}
    rows = [(g, rng.choice([None, *range(50)]) if g != "hot" else i, h(str(g), str(i))) for g, n in sizes.items() for i in range(n)]
    check(spark, rows + rows[:1])


def test_one_group_and_one_row(spark):
    check(spark, [("x", i, h(str(i))) for i in range(17)])
    check(spark, [("x", 1, h("1"))])


def test_frontiers_handed_over_early(spark):
    """Leaves in no order: a task meets more partial parents than it may hold."""
    leaves = [("x", i, 1500, h(str(i))) for i in range(1500)]
    rng.shuffle(leaves)
    df = spark.createDataFrame(leaves, "grp string, idx long, size long, digest string").repartition(3)
    got = {(r.level, r.idx): r.digest for r in merkle.parents(df, held=1).collect()}
    want = tree([h(str(i)) for i in range(1500)])
    assert got == {(k, i): d for k, level in enumerate(want) if k for i, d in enumerate(level)}


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, o long, leaf string")
    assert merkle.manifest(df, F.col("g"), [F.col("o")], F.col("leaf")).collect() == []


def test_query_on_odd_rows(spark, tmp_path):
    import zlib

    texts = [None, "", "x" * 50000, "ÉA b", "Same", "same"] + [f"Text {i}" for i in range(40)]
    rows = [(i if i % 7 else None, rng.choice(["s", None]), rng.choice(["en", "de", None]), rng.choice([None, 5]), t, "x", "y", "z") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3]]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_merkle_manifest(spark, str(tmp_path)).collect()
    leaf = lambda r, text: h(*(field(v) for v in (r[0], r[1], r[2], r[3], text)))
    want = plain([(r[2], r[0], leaf(r, r[4])) for r in rows])
    assert sorted((r.leaf, r.subroot, r.root, r.proof_sha256) for r in got) == sorted((x[1], x[3], x[4], h(*(d for _, s in x[2] for d in s))) for x in want)
    low = lambda t: t and t.translate({c: c + 32 for c in range(65, 91)})
    changed = {leaf(r, r[4]) for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and low(r[4]) != r[4]}
    assert {r.leaf for r in got if not r.verified} == changed and changed
    assert all(r.verified == (r.folded_root == r.root) for r in got)

"""Whitening against fractions and against plain numpy."""

import math
import random
from fractions import Fraction

import numpy as np

from veladura.llm import whitening

rng = random.Random(13)
VECTORS = "vec_id long, embedding array<float>, n string, component string"


def rows_for(dim, count, scale=1.0):
    mix = np.random.default_rng(dim).normal(size=(dim, dim)) * scale
    return [[float(np.float32(v)) for v in mix @ np.random.default_rng(dim * 1000 + i).normal(size=dim)] for i in range(count)]


def check(spark, vectors, ids=None):
    ids = ids or list(range(len(vectors)))
    rows = [(i, v, "x", "y") for i, v in zip(ids, vectors, strict=True)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = whitening.whitened(whitening.as_integers(df)).collect()
    fine = [(i, [math.floor(256 * float(c)) for c in v]) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    for dim in {len(x) for _, x in fine}:
        own = [(i, x) for i, x in fine if len(x) == dim]
        fit = [list(x) for x in {tuple(x) for _, x in own}]
        n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        exact = [[Fraction(sum(x[i] * x[j] for x in fit), n) - Fraction(sums[i] * sums[j], n * n) for j in range(dim)] for i in range(dim)]
        cov = np.array([[float(v) for v in r] for r in exact])
        e = np.linalg.eigvalsh(cov)[::-1]
        trace = float(sum(exact[i][i] for i in range(dim)))
        kept = [k for k in range(min(4, dim)) if trace > 0 and e[k] > 1e-12 * trace]
        mine = sorted(((r.vec_id if r.vec_id is not None else -1, r.component, r) for r in got if any(r.vec_id == i for i, _ in own)), key=lambda t: t[:2])
        assert [t[:2] for t in mine] == sorted((i if i is not None else -1, k + 1) for i, _ in own for k in kept)
        at = {i: x for i, x in own}
        w = {k: [] for k in kept}
        for _, c, r in mine:
            x = at[r.vec_id]
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            assert abs(r.explained - e[c - 1] / trace) <= 1e-9 * abs(r.explained)
            assert r.identity_error < 1e-8
            w[c - 1].append((tuple(x), r.whitened))
        # over the fit list every component has mean 0 and variance 1, and components are not correlated
        z = np.array([[dict(w[k])[tuple(x)] for x in fit] for k in kept])
        if len(kept):
            assert np.abs(z.mean(1)).max() < 1e-8 and np.abs(z @ z.T / n - np.eye(len(kept))).max() < 1e-8
            # and is the projection on an eigenvector of V: V u = e u, as seen from V's own projections
            centred = np.array(fit, float) - np.array(sums) / n
            for k in kept:
                u = centred.T @ z[k] / n / np.sqrt(e[k])
                assert abs(np.linalg.norm(u) - 1) < 1e-8 and np.abs(cov @ u - e[k] * u).max() < 1e-8 * e[0]
    return got


def test_against_fractions(spark):
    vectors = rows_for(6, 80)
    vectors += vectors[:30] + [None, [], [1.0, None, 1.0, 1.0, 1.0, 1.0], [math.nan] * 6, [math.inf] + [0.0] * 5, [-0.0] * 6]
    check(spark, vectors)


def test_lengths_are_fitted_apart(spark):
    check(spark, rows_for(6, 40) + rows_for(3, 40) + rows_for(2, 30))


def test_large_values_need_unbounded_integers(spark):
    """Products beyond a long, sums beyond 2^53."""
    vectors = [[float(np.float32(rng.uniform(-1, 1) * 3e14)) for _ in range(3)] for _ in range(40)]
    rows = [(i, v, "x", "y") for i, v in enumerate(vectors)]
    got = whitening.whitened(whitening.as_integers(spark.createDataFrame(rows, VECTORS).repartition(3))).collect()
    x = [[math.floor(256 * c) for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert len(got) == 120 and all(r.deviation is None for r in got)
    spread = [[40 * sum(a[i] * a[j] for a in x) - sums[i] * sums[j] for j in range(3)] for i in range(3)]
    e = np.linalg.eigvalsh(np.array([[v / 1600 for v in r] for r in spread]))[::-1]
    share = {r.component: r.explained for r in got}
    assert all(abs(share[k + 1] - e[k] / e.sum()) < 1e-9 for k in range(3)) and got[0].identity_error < 1e-6


def test_scatter_is_exact_at_every_size():
    for top in (10, 10**6, 2**31, 2**62):
        x = np.array([[rng.randint(-top, top) for _ in range(4)] for _ in range(9)], np.int64)
        shift = np.array([rng.randint(-top, top) for _ in range(4)], object)
        y = whitening.less(x, shift)
        want = [[int(a) - int(s) for a, s in zip(r, shift, strict=True)] for r in x.tolist()]
        assert y.tolist() == want
        assert whitening.scatter(y).tolist() == [[sum(r[i] * r[j] for r in want) for j in range(4)] for i in range(4)]
    for values in ([], [0, -1, 2**63, -(2**200)], [5]):
        assert whitening.unpacked(*whitening.packed(values)).tolist() == values


def test_no_variance_and_no_rows(spark):
    one = spark.createDataFrame([(i, [0.5, 0.25], "x", "y") for i in range(5)], VECTORS)
    assert whitening.whitened(whitening.as_integers(one)).collect() == []
    assert whitening.whitened(whitening.as_integers(spark.createDataFrame([], VECTORS))).collect() == []
    line = [[float(i), 2.0 * i, 1.0] for i in range(10)]
    got = check(spark, line)
    assert {r.component for r in got} == {1}


def test_null_ids_stay(spark):
    got = whitening.whitened(whitening.as_integers(spark.createDataFrame([(None, v, "x", "y") for v in rows_for(3, 12)], VECTORS))).collect()
    assert len(got) == 36 and {r.vec_id for r in got} == {None}

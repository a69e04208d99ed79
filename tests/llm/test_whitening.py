"""Whitening and its spectrum against numpy's eigenvectors and exact integers."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from pitchflow.llm import spectrum, whitening


@pytest.mark.parametrize("kind", ["plain", "cluster", "beyond", "equal", "low rank", "zero", "huge", "tiny"])
@pytest.mark.parametrize("n", [1, 2, 3, 64])
def test_spectrum(kind, n):
    rng = np.random.default_rng(n)
    e = np.sort(rng.uniform(1, 100, n))[::-1]
    if kind == "cluster":
        e[n // 4 : n // 2] = e[n // 4]
    if kind == "beyond":  # a cluster that the 32 components cut
        e[min(n - 1, 30) : 36] = e[min(n - 1, 30)]
    if kind == "equal":
        e[:] = 3
    if kind == "low rank":
        e[1 + n // 8 :] = 0
    e = e * {"zero": 0.0, "huge": 1e30, "tiny": 1e-30}.get(kind, 1.0)
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    m = (q * e) @ q.T
    m = (m + m.T) / 2
    values, vectors = spectrum.leading(m, 32)
    k = min(n, 32)
    scale = max(e.max(), 1e-300)
    assert np.abs(values - np.sort(np.linalg.eigvalsh(m))[::-1][:k]).max() < 1e-13 * scale
    assert np.abs(m @ vectors - vectors * values).max() < 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13


def test_counts_are_inertia():
    rng = np.random.default_rng(9)
    m = rng.normal(size=(20, 20))
    m = m + m.T
    a, b, q = spectrum.tridiagonal(m)
    assert np.abs(q.T @ m @ q - np.diag(a) - np.diag(b, 1) - np.diag(b, -1)).max() < 1e-12
    shifts = np.concatenate([rng.uniform(-15, 15, 50), a])
    assert (spectrum.below(a, b, shifts) == (np.linalg.eigvalsh(m)[None, :] < shifts[:, None]).sum(1)).all()


def plain(rows, k):
    """rows of (id, vector) that are left: {id: deviation}, eigenvalues' shares, and the whitened rows."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    z = np.array([[float(Fraction(n * r[i] - s[i], n)) for i in range(d)] for r in x])
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x], e / np.trace(v), z @ u / np.sqrt(e)


def found(spark, rows, k=32):
    frame = spark.createDataFrame([(i, v, 5, "x") for i, v in rows], "vec_id long, embedding array<float>, component int, w string").repartition(3)
    return whitening.whiten(spark, frame, k).collect()


@pytest.mark.parametrize(("n", "d", "k"), [(300, 40, 32), (50, 6, 32), (200, 10, 3)])
def test_against_numpy(spark, n, d, k):
    rng = np.random.default_rng(d)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=d) * np.linspace(1, 4, d) + 5]) for i in range(n)]
    odd = [(900, None), (901, [None] * d), (902, [float("nan")] * d), (903, [float("inf")] * d), (904, []), (905, [1.0] * (d + 1))]
    got = found(spark, rows + odd, k)
    deviation, share, white = plain(rows, k)
    k = min(k, d)
    assert sorted((r.vec_id, r.component) for r in got) == [(i, c + 1) for i in range(n) for c in range(k)]
    assert all(r.n == n and r.deviation == deviation[r.vec_id] and r.explained == pytest.approx(share[r.component - 1], rel=1e-10) for r in got)
    mine = np.zeros((n, k))
    for r in got:
        mine[r.vec_id, r.component - 1] = r.whitened
    sign = np.sign((mine * white).sum(0))
    assert np.abs(mine * sign - white).max() < 1e-8
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10
    assert np.abs(mine.T @ mine / n - np.eye(k)).max() < 1e-10


def test_odd_tables(spark):
    assert found(spark, []) == [] == found(spark, [(1, None), (2, [])])
    assert found(spark, [(1, [1.0, 2.0])] * 4) == []  # equal rows leave nothing to scale
    rng = random.Random(1)
    rows = [(None if i % 3 else 7, [rng.random() for _ in range(20)]) for i in range(6)]  # fewer rows than dimensions; ids repeat and are null
    got = found(spark, rows)
    assert len(got) == 6 * 5 and max(r.component for r in got) == 5 and got[0].identity_error < 1e-9
    far = found(spark, [(1, [3e30, 1.0]), (2, [-3e30, 2.0]), (3, [0.0, 4.0])])
    assert {r.vec_id for r in far if r.deviation is None} == {1, 2} and all(math.isfinite(r.whitened) for r in far)

"""Exact search against brute force over all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchflow.llm import topk


def plain(rows, k, asks):
    """rows of (vec_id, vector): every query's best others, in Python's integers."""
    usable = [(i, [math.floor(64 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (q, x) in enumerate(usable):
        if q is not None and asks(q):
            scores = [(max(min(sum(u * w for u, w in zip(x, y)), 2**63 - 1), -(2**63)), i) for b, (i, y) in enumerate(usable) if b != a]  # noqa: B905
            scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
            out += [(q, r, i, s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, k, asks=lambda c: c % 5 == 0, kind="float"):
    frame = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], f"vec_id long, embedding array<{kind}>, row string, score int")
    return sorted((tuple(r) for r in topk.top(spark, frame, asks(F.col("vec_id")), k).collect()), key=str)


@pytest.mark.parametrize("cells", [1 << 18, 16 * 40])
def test_against_brute_force(spark, monkeypatch, cells):
    """Also over many small blocks; a third of the rows is one vector, so that most scores tie."""
    monkeypatch.setattr(topk, "CELLS", cells)
    monkeypatch.setattr(topk, "QUERIES", 1024 if cells > 1000 else 7)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in (rng.normal(size=12) if i % 3 else np.ones(12))]) for i in range(240)]
    assert found(spark, rows, 9) == plain(rows, 9, lambda q: q % 5 == 0)


def test_odd_rows(spark):
    rng = random.Random(4)
    some = [(i, [rng.randrange(-64, 64) / 64 for _ in range(6)]) for i in range(30)]
    odd = [(100, None), (105, []), (110, [None, 1.0]), (115, [float("nan")] * 6), (120, [float("inf")] * 6), (None, some[3][1]), (5, some[5][1]), (5, some[5][1]), (125, [1.0]), (130, [0.5] * 9)]
    for k in (1, 4, 100):
        assert found(spark, some + odd, k) == plain(some + odd, k, lambda q: q % 5 == 0)
    assert found(spark, [(0, [1.0])], 3) == [] == found(spark, [], 3) == found(spark, [(1, [1.0]), (2, [2.0])], 3)
    assert found(spark, [(0, [1.0]), (1, [2.0])], 3) == [(0, 1, 1, 64 * 128)]


@pytest.mark.parametrize("size", [100.0, 1e6, 1e8, 1e16])
def test_wide_numbers_stay_exact(spark, size):
    """Sums under 2**24, under 2**53, under 2**63 and beyond."""
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-size, size) for _ in range(5)]) for i in range(40)]
    assert found(spark, rows, 6, kind="double") == plain(rows, 6, lambda q: q % 5 == 0)


def test_cutoff_passes_most_rows_over():
    """The lists' cutoff leaves few rows to resolve, and the ones that reach it all."""
    rng = np.random.default_rng(6)
    cells = rng.integers(-30, 30, (2000, 16))
    block = topk.Block(2000, 16, "i8", *(x.astype(np.int64).tobytes() for x in (np.arange(2000), np.arange(2000))), np.ones(2000, np.uint8).tobytes(), np.full(2000, topk.LOW).tobytes(), cells.astype("i8").tobytes())
    query, score = topk.first_lists(block, block, 20)
    cutoff = np.full(2000, topk.LOW)
    for q in range(2000):
        cutoff[q] = score[query == q].min()
    lists = topk.partial_scores(cells, cells)
    left = np.maximum(*lists) >= cutoff[:, None] / 2
    total = cells @ cells.T
    assert (left | (total < cutoff[:, None])).all() and left.mean() < 0.2
    assert ((total >= cutoff[:, None]).sum(1) >= 20).all()

import hashlib
import random
import tracemalloc
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from pitchflow.llm import fm_index, repeats, suffix_sort

from .helpers import empty_documents, odd_documents, odd_texts


def brute(parts: list, size: int, hidden: int = 0):
    count = Counter(tuple(p[i : i + size]) for p in parts for i in range(len(p) - size + 1))
    for p in parts:
        gone = np.zeros(len(p), dtype=bool)
        for i in range(len(p) - size + 1):
            if count[tuple(p[i : i + size])] > 1:
                gone[i : i + size] = True
        yield gone


@pytest.mark.parametrize("size", [3, 5, 9, 35])
def test_indexes_agree_with_counting(size):
    rng = random.Random(size)
    for _ in range(20):
        segs = [[rng.randrange(1, 4) for _ in range(size + rng.randrange(9))] for _ in range(12)]
        weight = np.array([rng.choice([1, 1, 1, 2]) for _ in segs])
        count = Counter()
        for s, w in zip(segs, weight, strict=True):
            for i in range(len(s) - size + 1):
                count[tuple(s[i : i + size])] += w
        want = [count[tuple(s[i : i + size])] > 1 for s in segs for i in range(len(s) - size + 1)]
        got = fm_index.repeated_windows([np.array(s, dtype=np.uint64).view(np.uint8).reshape(-1, 8)[:, : fm_index.WIDTH].tobytes() for s in segs], weight, size)
        assert got.tolist() == want
        assert suffix_sort.repeated_windows([bytes(96 + x for x in s) for s in segs], weight, size).tolist() == want


def test_two_stage_is_the_suffix_order():
    rng = random.Random(2)
    for n in (1, 2, 3, 50, 400):
        raw = bytes(rng.choice(b"aab\xff") for _ in range(n))
        got = suffix_sort.two_stage(np.frombuffer(raw, dtype=np.uint8), n + 1)
        assert got.tolist() == sorted(range(n), key=lambda i: raw[i:])


@pytest.mark.parametrize("most", [1, 3])
def test_many_alike_suffixes_are_dealt_out(monkeypatch, most):
    monkeypatch.setattr(suffix_sort, "SORTED", most)
    rng = random.Random(3)
    for alphabet in (b"ab", b"ab\0", b"a\0", b"abcdefgh"):
        for n in (1, 2, 30, 400):
            part = bytes(rng.choice(alphabet) for _ in range(n))
            for raw in (part, part + part[: n // 2], part + b"ab\0" * 9):
                assert suffix_sort.two_stage(np.frombuffer(raw, dtype=np.uint8), len(raw) + 1).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


@pytest.mark.parametrize("alphabet", ["01", "abcdefghijklmnopqrstuvwxyz "])
def test_an_index_holds_few_bytes_a_byte(alphabet):
    rng = random.Random(6)
    line = "".join(rng.choices(alphabet, k=700)).encode()
    segs = [line[:i] + b"-" + line[i + 1 :] for i in range(700)] + [line[:i] + b"+" + line[i + 1 :] for i in range(200)]
    windows = 301
    tracemalloc.start()
    try:
        hit = suffix_sort.repeated_windows(segs, np.ones(len(segs), dtype=np.int64), 400)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    count = Counter(s[i : i + 400] for s in segs for i in range(windows))
    assert hit.tolist() == [count[s[i : i + 400]] > 1 for s in segs for i in range(windows)]
    assert peak < 42 * sum(map(len, segs))


@pytest.mark.parametrize("sizes", [[30, 30, 30, 30], [90, 90], [10, 95, 20], [30, 350], [350, 30], [20, 260, 200, 20]])
def test_what_is_indexed_at_once(sizes):
    """An anchor beyond a chunk is indexed alone, and others together up to a chunk."""
    seen = []

    def index(segments, counts, size):
        seen.append({s[:1] for s in segments})
        assert sum(map(len, segments)) <= 100 or len(seen[-1]) == 1
        return np.ones(sum(len(s) - size + 1 for s in segments), dtype=bool)

    unit = replace(suffix_sort.byte_unit(5, 3), index=index, chunk=100)
    rows = [(h, 100 * h + i, bytes([65 + h]) * 10, 1) for h, n in enumerate(sizes) for i in range(n // 10)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["h", "own", "seg", "n"])
    own = [o for b in repeats._shards(unit)([batch]) for o in b.column(0).to_pylist()]
    assert sorted(own) == [r[1] for r in rows]
    assert set().union(*seen) == {bytes([65 + h]) for h in range(len(sizes))}


def test_common_prefixes():
    rng = random.Random(8)
    for n in (1, 2, 60, 300):
        raw = bytes(rng.choice(b"aab") for _ in range(n))
        order = np.array(sorted(range(n), key=lambda i: raw[i:]))
        got = suffix_sort.common_prefixes(np.frombuffer(raw, dtype=np.uint8), order, 20)
        assert got.tolist() == [next((k for k in range(20) if raw[a + k : a + k + 1] != raw[b + k : b + k + 1] or a + k >= n or b + k >= n), 20) for a, b in zip(order[:-1], order[1:], strict=True)]


def test_wavelet_ranks():
    rng = np.random.default_rng(3)
    seq = rng.integers(0, 37, 300)
    tree = fm_index.WaveletTree(seq, 37)
    c, at = rng.integers(0, 37, 500), rng.integers(0, 301, 500)
    present = np.isin(c, seq)
    assert tree.rank(c[present], at[present]).tolist() == [int((seq[:i] == s).sum()) for s, i in zip(c[present], at[present], strict=True)]


@pytest.mark.parametrize("hot", [4096, 1])
def test_words(spark, monkeypatch, hot):
    """hot = 1: every repeated anchor is avoided where it can be, and its windows are counted one by one."""
    monkeypatch.setattr(repeats, "HOT", hot)
    if hot == 1:
        monkeypatch.setattr(repeats.Unit, "most", 10)
    texts = odd_texts()
    out = {r.h: r.r for r in fm_index.removed(spark, odd_documents(spark)).collect()}
    tokens = [(t or "").encode().split() for t in texts]
    for i, (t, gone) in enumerate(zip(tokens, brute(tokens, 35), strict=True)):
        kept = b" ".join(w for w, g in zip(t, gone, strict=True) if not g)
        assert (out[i].n_words, out[i].n_removed, out[i].kept_sha256) == (len(t), int(gone.sum()), hashlib.sha256(kept).hexdigest()), i
    assert sum(r.n_removed for r in out.values()) > 0


@pytest.mark.parametrize("hot", [4096, 1])
def test_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    if hot == 1:
        monkeypatch.setattr(repeats.Unit, "most", 10)
    texts = odd_texts()
    texts[9] = texts[9][:6000]
    texts[10] = texts[10][:3000]
    out = {r.h: r.r for r in suffix_sort.removed(spark, odd_documents(spark, texts)).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, (t, gone) in enumerate(zip(raw, brute(raw, 400), strict=True)):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        assert (out[i].n_bytes, out[i].n_removed, out[i].n_spans, out[i].kept_sha256) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i


def test_empty(spark):
    assert fm_index.removed(spark, empty_documents(spark)).count() == 0
    assert suffix_sort.removed(spark, empty_documents(spark)).count() == 0

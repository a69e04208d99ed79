import numpy as np
import pytest
import xxhash

from pitchflow.llm import graph, simhash

from .helpers import empty_documents, odd_documents, odd_texts

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain(text):
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def components(fps, ids):
    fps = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(fps))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    return [min((i for i, l in zip(ids, label, strict=True) if l == mine and i is not None), default=None) for mine in label]


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = {r.h: r.doc_id for r in docs.collect()}
    fps = [plain(t) for t in odd_texts()]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(spark, docs).collect())
    want = sorted((i is None, i or 0, f, c) for i, f, c in zip([rows[k] for k in sorted(rows)], fps, components(fps, [rows[k] for k in sorted(rows)]), strict=True))
    assert got == want
    assert simhash.near_duplicates(spark, empty_documents(spark)).count() == 0


@pytest.mark.parametrize("most", [4096, 3])
def test_clouds_and_chains(spark, monkeypatch, most):
    """Fingerprints around centres, and a chain of single bits: against all pairs; also with keys split again and again."""
    monkeypatch.setattr(simhash, "MOST", most)
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 2**63, 6).astype(np.uint64)
    fps = [int(c) ^ int(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for c in centre for k in (0, 1, 2, 3, 4, 5, 6) for _ in range(20)]
    chain = [int(centre[0])]
    for b in range(0, 60, 3):
        chain.append(chain[-1] ^ (7 << b))
    fps = list(dict.fromkeys(fps + chain))
    prints = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    met = simhash.meetings(spark, prints).select("mask", "value", "fp").coalesce(1).sortWithinPartitions("mask", "value", "fp")
    pairs = [(r.a, r.b) for r in met.mapInArrow(simhash._links, "a long, b long").collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in pairs)
    root = {r.node & (2**64 - 1): r.root for r in graph.components(spark, spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components(fps, list(range(len(fps))))
    mine = {}
    for f, w in zip(fps, want, strict=True):
        assert mine.setdefault(root.get(f, ("alone", f)), w) == w
    assert len(mine) == len(set(want))

"""The trie of conversations against a brute-force version."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from pitchflow.llm import prefix_trie


def rebuilt(rows):
    """rows of (conv_id, turn, role, text): {conv_id: its rebuilt turns}."""
    of = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            of[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in of.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    return out


def plain(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in who if len(convs[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), sum(not children[n] for n in below),
                    sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, parts=5):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, n int").repartition(parts)
    return sorted((tuple(r) for r in prefix_trie.trie(spark, *prefix_trie.rebuilt(spark, frame)).collect()), key=str)


def conversations(rng, n, turns, texts):
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for c in range(n) for t in range(rng.randrange(1, turns))]


@pytest.mark.parametrize("height", [256, 3])
def test_against_brute_force(spark, monkeypatch, height):
    """Also with segments of three turns, so that sums are carried over several levels; many conversations share their first turns."""
    monkeypatch.setattr(prefix_trie, "HEIGHT", height)
    rng = random.Random(1)
    rows = [(c, t, "user", f"{t % 2} {rng.randrange(2) if t > 3 else 0} ä") for c in range(0, 90, 3) for t in range(rng.randrange(1, 14))]
    rows += [(c, t, "user", "same") for c in range(200, 260) for t in range(11)]  # a group of copies
    rows += [(c, t, "a", f"long {t}") for c in (300, 301) for t in range(40 + c % 2)]
    assert found(spark, rows) == plain(rows)


def test_one_path_through_every_shard(spark, monkeypatch):
    """A skeleton of long paths: every conversation is the beginning of one, and all start alike."""
    monkeypatch.setattr(prefix_trie, "HEIGHT", 8)
    monkeypatch.setattr(prefix_trie, "SAMPLE", 1000)
    rows = [(c, t, "r", f"{t}") for c in range(0, 150, 5) for t in range(c // 5)] + [(c, t, "r", f"{t if t < 12 else c % 3}") for c in range(500, 560) for t in range(20)]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rng = random.Random(2)
    texts = ["a", "", None, "b c", "ab", "日本", "x" * 70_000]
    rows = conversations(rng, 25, 6, texts) + [(None, 1, "user", "lost"), (3, None, None, None), (3, None, "z", "first"), (4, 2, "user", "tie"), (4, 2, "user", "tie"), (4, 2, "role", "tie")]
    rows += [(c, t, None, "n") for c in (-1, -2, -7, 10**12 + 3) for t in (5, 2, 2)]
    rows += [(70 + c, 0, "u", "short") for c in range(9)]  # some are left without turns
    assert found(spark, rows) == plain(rows)
    assert any(not turns for turns in rebuilt(rows).values())
    assert found(spark, []) == [] == found(spark, [(None, 1, "user", "x")])


def test_pieces_of_ends(spark, monkeypatch):
    """The digest of many ends is streamed over pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE", 40)
    rows = [(c, t, "u", "t") for c in range(3000, 3300) for t in range(9)]
    assert found(spark, rows) == plain(rows)

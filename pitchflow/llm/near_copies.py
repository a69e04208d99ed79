"""Near copies by word shingles: fingerprints and pivots find most links cheaply, an exact join finds all others.

A text's set of shingles (``SHINGLE`` lower-cased words; fewer words: the whole sequence) gives a 64-bit SimHash,
``ROWS`` minima of its hashes, and a signature of one byte for each minimum. A SimHash alone can't deal such pairs
out to tasks: at a similarity of 0.8 some ten of 64 bits differ, and no block of bits is sure to agree. So texts
meet where a band of four minima agrees (a pair of similarity 0.8 has one of 16 such bands in 9,998 cases of
10,000). Of those that meet, pivot distance tables discard pairs whose distances to a reference fingerprint
differ by more than ``MOST_BITS``, differing bits and signatures discard more, and the texts decide.

Equal texts are one node. Groups of one key of over ``WALK`` nodes are not compared all with all: each node is
compared with the group's leaders, linked to the most similar ones, and is a leader itself unless its signature
is very near to one's. This is done within each task before the shuffle, too, so a hot group comes to one task
as a few leaders of each other task. Links that fail the exact test fall away.

What bands, bits, signatures, leaders and ``LINKS`` pass over is found by ``others``, which is exact and has no cap. All
shingles are ordered, common ones last. Two sets of that similarity share one of the first n - ceil(least * n) + 1
shingles of each, so texts meet at those; only texts not linked yet are compared there. Three bounds discard pairs, none of
which can discard a pair of that similarity: sizes, the shingles left after the one met at, and sketches of one bit for
each of 512 cells of hashes, set if the cell has an odd number of the set's shingles (two sets differ in at least as many
shingles as their sketches do in bits). The texts decide. A shingle at which over ``MOST`` texts meet is dealt out by
pairs of blocks of them. The order of shingles (by counts in one of ``NTH`` texts) decides only how many meet: whatever it
is, all texts and all their shingles are taken, and all pairs are found.

Cases: null and word-free texts are one group; repeated rows are equal texts; very long texts are read whole; ids
and other columns are not looked at; an empty table gives no row. Equal hashes (64 bits) stand for equal shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, mix, steps, text_arrays, window_hashes, word_bounds, word_hashes, written
from .decontam import text_key
from .graph import components
from .repeats import _in, bitmap
from .simhash import distance, pivot_table

SHINGLE = 5
ROWS, BAND = 64, 4
MOST_BITS = 22
LIKELY, SAME = 0.66, 0.86  # of a signature: candidates, and members that needn't lead
WALK = 12
LINKS = 4
NTH = 16  # the order of shingles goes by their counts in one of so many texts
COMMON = 2, 16, 256  # counts from which a shingle comes after all rarer ones
ODD_BITS = 512
MOST = 2048
_MULTIPLY = mix(np.arange(1001, 1001 + ROWS, dtype=np.uint64)) | np.uint64(1)
_TURN = mix(np.arange(5001, 5001 + ROWS, dtype=np.uint64))


def shingles(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, in order, and each text's first (n + 1)."""
    low = LOWER[data]
    starts, ends, first = word_bounds(low, off)
    words = word_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    begin = np.cumsum(count) - count
    every = window_hashes(words, size)
    at = np.arange(count.sum()) - np.repeat(begin, count) + np.repeat(first[:-1], count)
    short = np.flatnonzero((n > 0) & (n < size))
    out = np.zeros(int(count.sum()), dtype=np.uint64)
    whole = np.ones(len(out), dtype=bool)
    whole[begin[short]] = False
    out[whole] = every[at[whole]]
    for i in short.tolist():
        out[begin[i]] = window_hashes(words[first[i] : first[i + 1]], int(n[i]))[0]
    return out, np.append(begin, len(out))


def sketched(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, signatures, band keys) of texts; those without words have zeros."""
    n = len(off) - 1
    prints, least = np.zeros(n, np.uint64), np.zeros((n, ROWS), np.uint64)
    for a, b in steps(off):
        h, first = shingles(data[off[a] : off[b]], off[a : b + 1] - off[a])
        on = np.flatnonzero(np.diff(first) > 0)
        if not len(on):
            continue
        ones = np.add.reduceat(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), first[on], axis=0, dtype=np.int64)
        prints[a + on] = np.packbits(2 * ones > np.diff(first)[on, None], axis=1, bitorder="little").view(np.uint64).ravel()
        for k in range(ROWS):
            least[a + on, k] = np.minimum.reduceat((h ^ _TURN[k]) * _MULTIPLY[k], first[on])
    spread = mix(least.ravel().copy()).reshape(least.shape)
    bands = np.zeros((n, ROWS // BAND), np.uint64)
    for k in range(BAND):
        bands = mix((bands + spread[:, k::BAND] * np.uint64(0x9E3779B97F4A7C15)).ravel()).reshape(bands.shape)
    bands ^= mix(np.arange(1, ROWS // BAND + 1, dtype=np.uint64))
    return prints, (spread & np.uint64(255)).astype(np.uint8), bands


SKETCH = "struct<fp:bigint,sig:binary,bands:array<bigint>>"


def _sketch(col: pa.Array) -> pa.Array:
    prints, sig, bands = sketched(*text_arrays(col))
    raw = sig.tobytes()
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(prints) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.ravel().view(np.int64)))
    return pa.StructArray.from_arrays([pa.array(prints.view(np.int64)), pa.array([raw[i * ROWS : (i + 1) * ROWS] for i in range(len(prints))], pa.binary()), lists], ["fp", "sig", "bands"])


def _alike(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (sig[i] == sig[j]).mean(axis=1)


class Group:
    """The leaders of one key's nodes, and links of all others to them."""

    def __init__(self):
        self.at = np.zeros(0, np.int64)

    def add(self, new: np.ndarray, fp: np.ndarray, sig: np.ndarray, table: np.ndarray) -> list[tuple[int, int]]:
        out = []
        lead, n = np.concatenate([self.at, np.zeros(len(new), np.int64)]), len(self.at)
        for y in new.tolist():
            old = lead[:n]
            near = old[np.abs(table[old] - table[y]).max(axis=1, initial=0) <= MOST_BITS]  # pivots discard
            near = near[distance(fp[near], fp[y]) <= MOST_BITS]
            like = _alike(sig, near, np.full(len(near), y))
            best = np.argsort(-like, kind="stable")[:LINKS]
            out += [(int(near[k]), y) for k in best if like[k] >= LIKELY]
            if not len(like) or like[best[0]] < SAME:
                lead[n] = y
                n += 1
        self.at = lead[:n]
        return out


def _compared(key: np.ndarray, fp: np.ndarray, sig: np.ndarray, small: bool) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Links of rows sorted by key, as row numbers, and the rows that stay: leaders of large groups, all of small ones.

    Pairs of small groups are compared only if ``small`` is set.
    """
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(cut, len(key)))
    table = pivot_table(fp)
    links, stay = [], np.ones(len(key), dtype=bool)
    for s, n in zip(cut[size > WALK].tolist(), size[size > WALK].tolist(), strict=True):
        group = Group()
        got = group.add(np.arange(s, s + n), fp, sig, table)
        if got:
            links.append(tuple(np.array(got).T))
        stay[s : s + n] = False
        stay[group.at] = True
    if small:
        at = np.flatnonzero(np.repeat((size > 1) & (size <= WALK), size))
        for step in range(1, WALK):
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            ok = at[np.abs(table[at] - table[at + step]).max(axis=1, initial=0) <= MOST_BITS]
            ok = ok[distance(fp[ok], fp[ok + step]) <= MOST_BITS]
            ok = ok[_alike(sig, ok, ok + step) >= LIKELY]
            links.append((ok, ok + step))
    return links, stay


def _signatures(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in col), dtype=np.uint8).reshape(len(col), ROWS)


def _local(shared):
    """(node, fp, sig, bands) to rows (key, node, fp, sig) of keys that the bitmap has, and links (a, b) within the batch."""

    def code(batches):
        bits = shared.value
        cells = np.uint64(len(bits) * 64 - 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            node, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            sig = _signatures(batch.column(2))
            key = batch.column(3).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            of = np.repeat(np.arange(len(node)), ROWS // BAND)
            cell = key & cells
            on = (bits[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) > 0
            key, of = key[on], of[on]
            order = np.lexsort((of, key))
            key, of = key[order], of[order]
            if not len(key):
                continue
            links, stay = _compared(key, fp[of].view(np.uint64), sig[of], small=False)
            key, left = key[stay], of[stay]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(node[left]), pa.array(fp[left]), pa.array([sig[i].tobytes() for i in left], pa.binary()), pa.nulls(len(key), pa.int64())], ["key", "node", "fp", "sig", "other"]
            )
            if links:
                pair = np.unique(np.stack([of[np.concatenate([x for x, _ in links])], of[np.concatenate([y for _, y in links])]], axis=1), axis=0)
                pair = node[pair]
                k = len(pair)
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(pair[:, 0]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(pair[:, 1])], ["key", "node", "fp", "sig", "other"])

    return code


def _met(batches):
    """(key, node, fp, sig) sorted by key to links (a, b); what is held of a key between batches is its leaders."""
    held = None

    def found(key, node, fp, sig):
        links, stay = _compared(key, fp, sig, small=True)
        i, j = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in links)]) for k in (0, 1))
        pair = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"]), stay

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64), _signatures(batch.column(3))]
        if held is not None:
            rows = [np.concatenate([h, x]) for h, x in zip(held, rows, strict=True)]
        links, stay = found(*rows)
        yield links
        stay &= rows[0] == rows[0][-1]  # the last key may go on in the next batch
        held = [x[stay] for x in rows]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets given as sorted distinct values; 1 of two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _decided(least: float):
    """(a, b, text a, text b) to the pairs (a, b) of at least that similarity."""

    def code(batches):
        for batch in batches:
            sets = []
            for k in (2, 3):
                h, first = shingles(*text_arrays(batch.column(k)))
                sets.append([np.unique(h[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
            ok = np.array([similarity(x, y) >= least for x, y in zip(*sets, strict=True)], dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["a", "b"])

    return code


def shingle_sets(data: np.ndarray, off: np.ndarray, common: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, the common ones last, and each text's first (n + 1)."""
    h, first = shingles(data, off)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    level = sum((_in(words, h).astype(np.int8) for words in common), np.zeros(len(h), np.int8))
    order = np.lexsort((h, level, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(off)))


def odd_sketches(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, words of 64 bits): a bit is set if an odd number of the text's shingles falls in its cell."""
    n = len(first) - 1
    cell = np.repeat(np.arange(n), np.diff(first)) * ODD_BITS + (h >> np.uint64(64 - (ODD_BITS - 1).bit_length())).astype(np.int64)
    odd = np.bincount(cell, minlength=n * ODD_BITS).reshape(n, ODD_BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


def prefix_lengths(size: np.ndarray, least: float) -> np.ndarray:
    """How many of the first shingles of a set of that size hold one of any set of that similarity; 1 of empty sets."""
    return size - np.ceil(least * size - 1e-9).astype(np.int64) + 1


def _set_counts(batches):
    for batch in batches:
        data, off = text_arrays(batch.column(0))
        for a, b in steps(off):
            h, n = np.unique(shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], [])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])


def _prefixes(batch: pa.RecordBatch, common: list[np.ndarray], least: float):
    """(first text, key, text, position, sets, firsts) of the first shingles of (node, root, text); empty sets meet at key 0."""
    data, off = text_arrays(batch.column(2))
    for a, b in steps(off):
        h, first = shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], common)
        size = np.diff(first)
        k = prefix_lengths(size, least)
        text = np.repeat(np.arange(b - a), k)
        pos = np.arange(len(text)) - np.repeat(np.cumsum(k) - k, k)
        key = np.append(h, np.uint64(0))[np.where(size[text] > 0, first[text] + pos, len(h))]
        yield a, key, text, pos, h, first


def _prefix_roots(shared, least: float):
    """(h, root) of the first shingles of (node, root, text)."""

    def code(batches):
        for batch in batches:
            root = batch.column(1).to_numpy(zero_copy_only=False)
            for a, key, text, _, _, _ in _prefixes(batch, shared.value, least):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(root[a + text])], ["h", "root"])

    return code


PREFIX = "key long, node long, root long, size int, pos int, odd binary"


def _prefix_rows(shared, least: float):
    """The first shingles of (node, root, text) that the bitmap has, with what the bounds need."""

    def code(batches):
        common, apart = shared.value
        for batch in batches:
            node, root = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for a, key, text, pos, h, first in _prefixes(batch, common, least):
                on = _in(apart, key)
                key, text, pos = key[on], text[on], pos[on]
                raw = [x.tobytes() for x in odd_sketches(h, first)]
                columns = [key.view(np.int64), node[a + text], root[a + text], np.diff(first)[text].astype(np.int32), pos.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([raw[i] for i in text.tolist()], pa.binary())], ["key", "node", "root", "size", "pos", "odd"])

    return code


def _apart(least: float):
    """Rows (key, lo, hi, mine, node, root, size, pos, odd) sorted by (key, lo, hi) to the pairs (a, b) that no bound discards.

    Rows of one key, lo and hi are at most those of two blocks, and are held until they are all there.
    """
    share, differ = least / (1 + least), (1 - least) / (1 + least)

    def found(rows: list[np.ndarray]):
        key, lo, hi, mine, node, root, size, pos, odd = rows
        group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
        at, step, pairs = np.arange(len(key)), 1, []
        while True:
            at = at[at + step < len(key)]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            i, j = at, at + step
            ok = (root[i] != root[j]) & ((lo[i] == hi[i]) | (mine[i] != mine[j]))
            ok &= np.minimum(size[i] - pos[i], size[j] - pos[j]) >= share * (size[i] + size[j]) - 1e-9
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64) <= differ * (size[i] + size[j]) + 1e-9
            if ok.any():
                pairs.append(np.stack([np.minimum(node[i[ok]], node[j[ok]]), np.maximum(node[i[ok]], node[j[ok]])], axis=1))
            step += 1
        pair = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *pairs]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    def code(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(8)]
            rows.append(np.frombuffer(b"".join(x.as_py() for x in batch.column(8)), dtype=np.uint64).reshape(-1, ODD_BITS // 64))
            if held is not None:
                rows = [np.concatenate([h, x]) for h, x in zip(held, rows, strict=True)]
            other = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            held = [x[last:] for x in rows]
            if last:
                yield found([x[:last] for x in rows])
        if held is not None:
            yield found(held)

    return code


def decided(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes of ``texts`` (node, t) that have at least that similarity."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    some = written(pairs.sparkSession, texts.join(ends, "node", "left_semi"), "paired-texts")
    both = pairs.join(some.withColumnsRenamed({"node": "a", "t": "ta"}), "a").join(some.withColumnsRenamed({"node": "b", "t": "tb"}), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_decided(least), "a long, b long")


def others(spark: SparkSession, texts: DataFrame, least: float) -> DataFrame:
    """All links (a, b) of at least that similarity between nodes of different roots; texts: (node, root, t), distinct texts."""
    texts = texts.select("node", "root", "t")
    told = texts.where(F.pmod(F.xxhash64("node"), F.lit(NTH)) == 0).select("t")
    counts = written(spark, told.mapInArrow(_set_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON[0]), "common-shingles")
    common = []
    for n in COMMON:
        some = counts.where(F.col("n") >= n).select("h")
        common.append(bitmap(some, some.count()))
    keys = texts.mapInArrow(_prefix_roots(spark.sparkContext.broadcast(common), least), "h long, root long")
    keys = written(spark, keys.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h"), "keys-apart")
    shared = spark.sparkContext.broadcast((common, bitmap(keys, keys.count())))
    rows = written(spark, texts.mapInArrow(_prefix_rows(shared, least), PREFIX), "prefix-rows")
    hot = written(spark, rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("key", F.ceil(F.col("n") / MOST).alias("blocks")), "hot-shingles")
    met = rows.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("mine", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", "root", "size", "pos", "odd")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = met.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node").mapInArrow(_apart(least), "a long, b long")
    return decided(written(spark, pairs.distinct(), "candidates-apart"), texts.select("node", "t"), least)


def surplus(spark: SparkSession, rows: DataFrame, row: str, text: str = "text", least: float = 0.8) -> DataFrame:
    """(row): the rows that aren't the first of their group of near copies; ``row`` is a stable integer key of rows."""
    sketches = written(spark, rows.select(F.col(row).alias("row"), *text_key(F.col(text)), F.arrow_udf(_sketch, SKETCH)(F.coalesce(F.col(text), F.lit(""))).alias("s")), "sketches")
    firsts = written(spark, sketches.groupBy("k1", "k2").agg(F.min("row").alias("node")), "first-copies")
    copies = sketches.select("row", "k1", "k2").join(firsts, ["k1", "k2"]).where("row <> node").select("row")
    nodes = sketches.join(firsts.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "s.fp", "s.sig", "s.bands")
    keys = nodes.select(F.explode("bands").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n >= 2").select("h")
    keys = written(spark, keys, "band-keys")
    shared = spark.sparkContext.broadcast(bitmap(keys, keys.count()))
    near = written(spark, nodes.mapInArrow(_local(shared), "key long, node long, fp long, sig binary, other long"), "band-rows")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = near.where("key IS NOT NULL").select("key", "node", "fp", "sig").repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(_met, "a long, b long")
    inside = near.where("key IS NULL").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    pairs = written(spark, met.unionByName(inside).distinct(), "candidates")
    texts = rows.select(F.col(row).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    near = components(spark, decided(pairs, texts, least))
    roots = firsts.select("node").join(near, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    texts = written(spark, texts.join(roots, "node"), "node-texts")
    links = written(spark, others(spark, texts, least), "other-links")
    if links.limit(1).count():
        near = components(spark, links.unionByName(near.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    later = near.where("node <> root").select(F.col("node").alias("row"))
    return copies.unionByName(later)

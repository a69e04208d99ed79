"""SimHash near-duplicates: fingerprints that differ in at most three bits are linked, links are followed.

Candidates meet where 28 bits agree: with at most three differing bits, one of four 16-bit blocks is
equal, and of the other 48 bits one of four 12-bit parts; so 16 keys for each distinct fingerprint miss
nothing. Where they meet, a pivot distance table is laid out: the Hamming distances of each fingerprint to
``PIVOTS`` reference fingerprints. By the triangle inequality a pair whose distances to any pivot differ by
more than three can't be linked; pairs that no pivot discards are compared bit by bit. (Pivot distances of
random fingerprints all lie near 32, so they discard well, but they can't deal rows out to tasks: hence the
keys.) A key that over ``MOST`` fingerprints share is replaced by four keys of more bits: of the bits left, cut in
four, one part is equal in any pair to be linked; and so on, so that no task holds a large group. Groups that are
left are walked link by link, so that none gives out all its pairs.

Copies of a fingerprint are one node with a count, whatever their number.

Cases: null or word-free text has fingerprint zero and is linked like any other; repeated rows and ids are
kept, one result row each; component_id is null only if all ids of a component are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, mix, steps, text_arrays, word_bounds, written
from .graph import components

BITS = 3
PIVOTS = mix(np.arange(1, 33, dtype=np.uint64))
WALK = 48  # groups of more fingerprints than this are walked
MOST = 4096  # fingerprints of one key; more are dealt out by more bits
LEVELS = 4
KEY = np.dtype([("mask", "i8"), ("value", "i8")])


def fingerprints(data: np.ndarray, off: np.ndarray, shingle: int = 3) -> np.ndarray:
    """SimHash of each text over XXH64 (seed 42) of its lower-cased word shingles."""
    out = np.zeros(len(off) - 1, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for a, b in steps(off):
        text = LOWER[data[off[a] : off[b]]]
        starts, ends, first = word_bounds(text, off[a : b + 1] - off[a])
        raw = text.tobytes()
        size = ends - starts
        for i in range(b - a):
            lo, hi = int(first[i]), int(first[i + 1])
            n = hi - lo
            if not n:
                continue
            line = b" ".join([raw[s:e] for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)])
            k = min(shingle, n)
            end = np.cumsum(size[lo:hi] + 1) - 1
            begin = end - size[lo:hi]
            h = np.array([digest(line[s:e], 42) for s, e in zip(begin[: n - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)], dtype=np.uint64)
            ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[a + i] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprint(text: Column | str) -> Column:
    """The fingerprint as a signed 64-bit integer."""

    def code(col: pa.Array) -> pa.Array:
        return pa.array(fingerprints(*text_arrays(col)).view(np.int64))

    return F.arrow_udf(code, "long")(F.col(text) if isinstance(text, str) else text)


def _quarters(bits: list[int]) -> list[list[int]]:
    cuts = [len(bits) * k // 4 for k in range(5)]
    return [bits[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def masks() -> dict[int, list[int]]:
    """The 16 masks of the first meeting: 16 bits of one block and 12 of the other 48; with the bits left."""
    out = {}
    for block in _quarters(list(range(64))):
        rest = [b for b in range(64) if b not in block]
        for part in _quarters(rest):
            out[_mask(block + part)] = [b for b in rest if b not in part]
    return out


def finer(level: dict[int, list[int]]) -> dict[int, list[tuple[int, list[int]]]]:
    """For each mask the four of more bits that take its place where it is too common."""
    return {m: [(_signed((m & ((1 << 64) - 1)) | sum(1 << b for b in part)), [b for b in rest if b not in part]) for part in _quarters(rest)] for m, rest in level.items()}


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Distances to the pivots: (fingerprints, pivots)."""
    return np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def linked(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs are linked: the pivots discard, the bits decide. Pivots are tried eight at a time."""
    keep = np.arange(len(i))
    for a in range(0, table.shape[1], 8):
        near = np.abs(table[i[keep], a : a + 8] - table[j[keep], a : a + 8]).max(axis=1, initial=0) <= BITS
        keep = keep[near]
    out = np.zeros(len(i), dtype=bool)
    out[keep] = distance(fp[i[keep]], fp[j[keep]]) <= BITS
    return out


def walked(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links that hold together a group's components: one for each fingerprint that a walk reaches."""
    table = pivot_table(fp)
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    left = np.ones(len(fp), dtype=bool)
    out = []
    for seed in range(len(fp)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            d = table[x, 0]
            lo, hi = np.searchsorted(table[:, 0], [d - BITS, d + BITS + 1])
            near = lo + np.flatnonzero(left[lo:hi])
            new = near[linked(fp, table, np.full(len(near), x), near)]
            left[new] = False
            out += [(int(order[x]), int(order[y])) for y in new]
            queue += new.tolist()
    return out


def _links(batches):
    """Links among fingerprints of one key (mask, value); rows come sorted by key, a key may span batches."""
    held_key, held_fp = np.zeros(0, KEY), np.zeros(0, np.uint64)

    def found(key: np.ndarray, fp: np.ndarray):
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(cut, len(key)))
        first, second = [], []
        for s, n in zip(cut[size > WALK], size[size > WALK], strict=True):
            for x, y in walked(fp[s : s + n]):
                first.append(np.array([s + x]))
                second.append(np.array([s + y]))
        small = np.repeat((size > 1) & (size <= WALK), size)
        at = np.flatnonzero(small)
        table = np.zeros((len(key), len(PIVOTS)), dtype=np.int8)
        table[at] = pivot_table(fp[at])
        for step in range(1, WALK):
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            ok = linked(fp, table, at, at + step)
            first.append(at[ok])
            second.append(at[ok] + step)
        if first:
            i, j = np.concatenate(first), np.concatenate(second)
            if len(i):
                pair = np.unique(np.stack([fp[i].view(np.int64), fp[j].view(np.int64)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    for batch in batches:
        new = np.zeros(batch.num_rows, KEY)
        new["mask"], new["value"] = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        key = np.concatenate([held_key, new])
        fp = np.concatenate([held_fp, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(key):
            continue
        other = np.flatnonzero(key != key[-1])
        last = int(other[-1]) + 1 if len(other) else 0
        held_key, held_fp = key[last:], fp[last:]
        if last:
            yield from found(key[:last], fp[:last])
    if len(held_key):
        yield from found(held_key, held_fp)


def meetings(spark: SparkSession, prints: DataFrame) -> DataFrame:
    """(mask, value, fp): where fingerprints meet, with no more than MOST of them anywhere (but for LEVELS masks in one another)."""
    level = masks()
    met = prints.select("fp", F.explode(F.array(*map(F.lit, level))).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    out = None
    for _ in range(LEVELS):
        hot = written(spark, met.groupBy("mask", "value").agg(F.count("*").alias("_n")).where(F.col("_n") > MOST).select("mask", "value"), "hot-keys")
        if not hot.limit(1).count():
            break
        fine = met.join(hot, ["mask", "value"], "left_anti")
        out = fine if out is None else out.unionByName(fine)
        below = finer(level)
        steps_down = F.create_map(*[x for m, some in below.items() for x in (F.lit(m), F.array(*[F.lit(k) for k, _ in some]))])
        common = met.join(hot, ["mask", "value"], "left_semi").select("fp", F.explode(steps_down[F.col("mask")]).alias("mask"))
        met = written(spark, common.distinct().withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))), "meetings")
        level = {k: rest for some in below.values() for k, rest in some}
    return met if out is None else out.unionByName(met)


def near_duplicates(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, root): one row for each row of docs."""
    rows = written(spark, docs.select(F.col(doc_id).alias("doc_id"), fingerprint(text).alias("fp")), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    met = meetings(spark, prints).select("mask", "value", "fp")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = met.repartition(parts, "mask", "value").sortWithinPartitions("mask", "value", "fp").mapInArrow(_links, "a long, b long")
    nodes = components(spark, links)
    by_print = prints.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    by_print = written(spark, by_print, "prints")
    ids = by_print.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(by_print.join(ids, "root").select("fp", "component_id", "root"), "fp").select("doc_id", "fp", "component_id", "root")

"""Suffix-array dedup with two-stage sorting.

Of a shard's suffixes only those smaller than their successor (type B) are sorted directly; all others
(type A) are induced: going through the order from the smallest suffix, the suffix one place to the left of
each, if of type A, goes to the next free place of its first byte's bucket. A bucket's A suffixes come
before its B suffixes and are complete when the scan gets to them, so a bucket is scanned at once, in rounds
only for runs of one byte. Then the common prefixes of neighbours in the order are computed; windows in a run of
common prefixes of window length repeat. Some 15 bytes are held for each byte of a shard, and slices and prefixes of a bounded number of suffixes.

Cases: null and empty texts keep nothing to remove; texts shorter than a window keep all; copies remove each other. Of copies none is
kept for the others' sake, so ties don't matter; repeated rows are copies; texts of any length are read whole; other
columns of docs, whatever their names, are kept.
A cut may fall within a character: the kept bytes are then not UTF-8, and come as binary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import BYTE_VALUE, steps, text_arrays

SORTED = 1 << 14
BLOCK = 1 << 22


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Type B: suffix i is smaller than suffix i + 1. The empty suffix is the smallest."""
    out = np.zeros(len(text), dtype=bool)
    out[:-1] = text[:-1] < text[1:]
    same = np.flatnonzero(text[:-1] == text[1:])  # within runs of one byte
    last = np.flatnonzero(np.append(np.diff(same) > 1, True)) if len(same) else same
    out[same] = np.repeat(out[same[last] + 1], np.diff(np.append(-1, last)))
    return out


def few_at_once(raw: bytes, some: np.ndarray, depth: int):
    """Parts of the ascending places ``some`` of suffixes with two bytes in common, in their order, exact to ``depth`` bytes.

    Suffixes are dealt out by eight bytes, and again by the next eight, until at most ``SORTED`` are sorted as slices of the text at once.
    """
    parts = [(some, 2)]
    words = None
    while parts:
        some, k = parts.pop()
        if len(some) <= SORTED:
            some = some.tolist()
            if len(some) > 1:
                some.sort(key=lambda p: raw[p + 2 : p + depth])
            yield some
        elif k >= depth:  # alike but for zeros at the text's end
            ended = some > len(raw) - depth
            yield some[ended][::-1]
            yield some[~ended]
        else:
            if words is None:
                words = np.ndarray(len(raw) + 1, dtype=">u8", buffer=raw + bytes(8), strides=(1,))
            key = words[np.minimum(some + k, len(raw))].astype(np.uint64)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            parts += [(part, k + 8) for part in reversed(np.split(some[order], cuts))]


def two_stage(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of a byte array, exact to ``depth`` bytes."""
    n = len(text)
    small = smaller_than_next(text)
    raw = text.tobytes()
    counts = np.bincount(text, minlength=256)
    low = np.cumsum(counts) - counts
    direct = np.flatnonzero(small)
    b_counts = np.bincount(text[direct], minlength=256)
    out = np.zeros(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    direct = direct.astype(out.dtype)
    pair = text[direct].astype(np.uint16) << 8
    pair |= text[np.minimum(direct + 1, n - 1)]
    by_pair = np.argsort(pair, kind="stable")
    direct, pair = direct[by_pair], pair[by_pair]
    del by_pair
    cuts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    fill = low + counts - b_counts
    for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pair)], strict=False):
        c = int(pair[s]) >> 8
        for some in few_at_once(raw, direct[s:e], depth):
            out[fill[c] : fill[c] + len(some)] = some
            fill[c] += len(some)
    del direct, pair
    head = low.copy()

    def induce(front: np.ndarray) -> None:
        left = front[front > 0] - 1
        left = left[~small[left]]
        c = text[left]
        order = np.argsort(c, kind="stable")
        left, c = left[order], c[order]
        k = np.bincount(c, minlength=256)
        out[head[c] + np.arange(len(c)) - (np.cumsum(k) - k)[c]] = left
        head[:] += k

    if n:  # the empty suffix comes first
        induce(np.array([n]))
    for c in range(256):
        if not counts[c]:
            continue
        at = low[c]
        while at < head[c]:
            at, front = head[c], out[at : head[c]].copy()
            induce(front)
        induce(out[low[c] + counts[c] - b_counts[c] : low[c] + counts[c]])
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the longest common prefix, up to ``depth``, of each suffix but the last, in order, with the next.

    The first ``depth`` bytes of some suffixes at a time are laid side by side and compared.
    """
    out = np.zeros(max(len(order) - 1, 0), dtype=np.int32)
    starts = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(depth, np.uint8)]), depth)
    step = max(1, BLOCK // depth)
    for at in range(0, len(out), step):
        some = order[at : at + step + 1]
        rows = starts[some]
        unlike = rows[1:] != rows[:-1]
        length = unlike.argmax(axis=1)
        length[~unlike[np.arange(len(length)), length]] = depth
        out[at : at + step] = np.minimum(length, len(text) - np.maximum(some[1:], some[:-1]))
    return out


def repeated_windows(segments: list[bytes], counts: np.ndarray, size: int) -> np.ndarray:
    """Flags of the windows that occur twice or more among the segments, which stand for ``counts`` copies each."""
    text = np.frombuffer(b"\xff".join(segments), dtype=np.uint8)  # 255 is in no UTF-8 text
    windows = np.array([len(s) - size + 1 for s in segments])
    copies = np.minimum(counts, 2).astype(np.uint8)
    # each segment's windows, then the places (a 255 included) at which none starts
    weight = np.repeat(np.stack([copies, np.zeros_like(copies)], axis=1).ravel(), np.stack([windows, np.full_like(windows, size)], axis=1).ravel())[: len(text)]
    order = two_stage(text, size)
    order = order[weight[order] > 0]
    # windows that share all their bytes are neighbours
    alike = common_prefixes(text, order, size) >= size
    again = weight[order] > 1
    again[1:] |= alike
    again[:-1] |= alike
    hit = np.zeros(len(text), dtype=bool)
    hit[order] = again
    return hit[weight > 0]


def _bytes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_VALUE[data], off


def _stored_bytes(data: np.ndarray, values: np.ndarray, first: np.ndarray) -> tuple[bytes, int]:
    return data.tobytes(), 1


def byte_unit(size: int = 400, gram: int = 96) -> repeats.Unit:
    return repeats.Unit(size, gram, _bytes, _stored_bytes, repeated_windows, chunk=1_000_000, width=1)


def removed(spark: SparkSession, docs: DataFrame, size: int = 400, with_bytes: bool = True) -> DataFrame:
    """docs with r (which replaces a column of that name): struct (n_bytes, n_removed, n_spans, kept, kept_sha256).

    kept has the remaining bytes; null unless ``with_bytes``.
    """
    unit = byte_unit(size)

    def code(text: pa.Array, marks: pa.Array) -> pa.Array:
        data, off = text_arrays(text)
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for a, b in steps(off):
            first = off[a : b + 1] - off[a]
            part, every = data[off[a] : off[b]], repeats.covered(first, marks.slice(a, b - a), size)
            for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                own, gone = part[lo:hi], every[lo:hi]
                kept = own[~gone].tobytes()
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                for column, value in zip(out, (len(own), int(gone.sum()), spans, kept if with_bytes else None, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    udf = F.arrow_udf(code, "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary,kept_sha256:string>")
    marked = repeats.with_marks(spark, docs, unit)
    return marked.withColumn("r", udf(F.coalesce("text", F.lit("")), "_pf_marks")).drop("_pf_marks")

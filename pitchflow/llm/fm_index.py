"""Substring dedup with a compressed FM-index per shard.

The index of a shard is the Burrows-Wheeler transform of its segments, sorted to the depth of a window, in a
wavelet tree of packed bit rows (one for each bit of a symbol) with counts for each 64 bits. Streamed
segments are searched backward, all in step: one symbol further left narrows the interval by two ranks for
each bit; a match of window length first drops its last symbol, which widens the interval to the run of
suffixes that share the rest. The interval's weight is the number of occurrences: the matching statistics,
held at the window's length.

Cases: null and empty texts have no words; texts shorter than a window keep all; copies remove each other. Of copies none is
kept for the others' sake, so ties don't matter; repeated rows are copies; texts of any length are read whole; other
columns of docs, whatever their names, are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import steps, text_arrays, word_bounds, word_hashes


WIDTH = 5  # bytes of a word's hash that a shard is told: one wrong match in 10**12 pairs of differing words


class WaveletTree:
    """Ranks of symbols in an integer sequence; level by level from the highest bit, zeros before ones."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        n = len(seq)
        self.rows, self.sums, self.zeros = [], [], []
        for level in range(self.levels):
            bit = (seq >> (self.levels - 1 - level)) & 1 > 0
            packed = np.zeros((n >> 6) + 1, dtype=np.uint64)
            raw = np.packbits(bit, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            self.rows.append(packed)
            self.sums.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        # where each symbol's run starts after the last level
        self.start = np.zeros(1 << self.levels, dtype=np.int64)
        change = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]])) if n else np.zeros(0, np.int64)
        self.start[seq[change]] = change

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        at = place.copy()
        for level in range(self.levels):
            word = at >> 6
            ones = self.sums[level][word] + np.bitwise_count(self.rows[level][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            one = (symbol >> (self.levels - 1 - level)) & 1 > 0
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at - self.start[symbol]


def _joined(rank: np.ndarray, step: int) -> np.ndarray:
    """Pairs (rank, rank ``step`` places on) as one number; 0 past the end."""
    on = np.zeros_like(rank)
    on[: len(rank) - step] = rank[step:]
    return rank * np.int64(int(rank.max(initial=0)) + 1) + on


def sorted_to(seq: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffix order to ``depth`` symbols; and ranks to a smaller depth, with that depth (at least half)."""
    rank, have = seq.astype(np.int64), 1
    while 2 * have < depth:
        rank = np.unique(_joined(rank, have), return_inverse=True)[1].astype(np.int64)
        have *= 2
    return np.argsort(_joined(rank, depth - have), kind="stable"), rank, have


class FMIndex:
    """Index of integer segments for windows of ``size`` symbols; symbols are 1..sigma-1, 0 stands between segments."""

    def __init__(self, segments: list[np.ndarray], weights: np.ndarray, sigma: int, size: int):
        lengths = np.array([len(s) for s in segments])
        begin = np.cumsum(lengths + 1) - lengths - 1
        seq = np.zeros(int((lengths + 1).sum()), dtype=np.int64)
        seq[np.arange(lengths.sum()) + np.repeat(np.arange(len(segments)), lengths)] = np.concatenate(segments)
        order, rank, have = sorted_to(seq, size)
        self.size, self.seq, self.begin, self.lengths = size, seq, begin, lengths
        self.tree = WaveletTree(seq[order - 1], sigma)
        self.first = np.searchsorted(seq[order], np.arange(sigma + 1))
        w = np.repeat(weights, lengths + 1)[order]
        self.weight = np.concatenate([[0], np.cumsum(w)])
        # runs of suffixes that share size - 1 symbols
        rest = np.zeros_like(rank)
        if size - 1 > have:
            rest[: len(rank) - (size - 1 - have)] = rank[size - 1 - have :]
        a, b = rank[order], rest[order]
        if size - 1 < have:  # not deep enough to tell: ranks of one symbol less
            raise ValueError("windows of two symbols at least")
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        cut = np.append(np.flatnonzero(new), len(order))
        run = np.cumsum(new) - 1
        self.run_start, self.run_end = cut[run], cut[run + 1]

    def occurrences(self) -> np.ndarray:
        """Occurrences of each window of each segment, in the order of segments and windows."""
        windows = self.lengths - self.size + 1
        to = np.cumsum(windows) - windows
        out = np.zeros(int(windows.sum()), dtype=np.int64)
        order = np.argsort(-self.lengths, kind="stable")
        lo, hi = np.zeros(len(order), np.int64), np.full(len(order), len(self.seq), np.int64)
        for step in range(int(self.lengths.max(initial=0))):
            live = int(np.searchsorted(-self.lengths[order], -step, side="left"))  # longer than step
            seg = order[:live]
            place = self.lengths[seg] - 1 - step
            c = self.seq[self.begin[seg] + place]
            lo, hi = lo[:live], hi[:live]
            ends = self.first[c] + self.tree.rank(np.concatenate([c, c]), np.concatenate([lo, hi])).reshape(2, -1)
            lo, hi = ends[0], ends[1]
            if step + 1 >= self.size:
                out[to[seg] + place] = self.weight[hi] - self.weight[lo]
                lo, hi = self.run_start[lo], self.run_end[hi - 1]
        return out


def repeated_windows(segments: list[bytes], counts: np.ndarray, size: int) -> np.ndarray:
    """Flags of the windows that occur twice or more among segments of WIDTH-byte symbols."""
    sizes = np.array([len(s) for s in segments]) // WIDTH
    values = np.zeros((int(sizes.sum()), 8), dtype=np.uint8)
    values[:, :WIDTH] = np.frombuffer(b"".join(segments), dtype=np.uint8).reshape(-1, WIDTH)
    values = values.view("<u8").ravel()
    ids = np.unique(values, return_inverse=True)[1] + 1
    index = FMIndex(np.split(ids, np.cumsum(sizes)[:-1]), counts, int(ids.max()) + 1, size)
    return index.occurrences() >= 2


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_bounds(data, off)
    return word_hashes(data, starts, ends), first


def _stored_words(data: np.ndarray, values: np.ndarray, first: np.ndarray) -> tuple[bytes, int]:
    return values.view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes(), WIDTH


def word_unit(size: int = 35, gram: int = 12) -> repeats.Unit:
    return repeats.Unit(size, gram, _words, _stored_words, repeated_windows, chunk=400_000, width=WIDTH)


def removed(spark: SparkSession, docs: DataFrame, size: int = 35, with_text: bool = True) -> DataFrame:
    """docs with r (which replaces a column of that name): struct (n_words, n_removed, kept, kept_sha256).

    kept is the text of the words outside repeated windows; null unless ``with_text``.
    """
    unit = word_unit(size)

    def code(text: pa.Array, marks: pa.Array) -> pa.Array:
        data, off = text_arrays(text)
        out: tuple[list, list, list, list] = ([], [], [], [])
        for a, b in steps(off):
            part = data[off[a] : off[b]]
            starts, ends, first = word_bounds(part, off[a : b + 1] - off[a])
            raw = part.tobytes()
            gone = repeats.covered(first, marks.slice(a, b - a), size)
            for i in range(b - a):
                lo, hi = int(first[i]), int(first[i + 1])
                keep = lo + np.flatnonzero(~gone[lo:hi])
                kept = b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
                for column, value in zip(out, (hi - lo, hi - lo - len(keep), kept if with_text else None, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
        return pa.StructArray.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string()), pa.array(out[3], pa.string())], ["n_words", "n_removed", "kept", "kept_sha256"])

    udf = F.arrow_udf(code, "struct<n_words:bigint,n_removed:bigint,kept:string,kept_sha256:string>")
    marked = repeats.with_marks(spark, docs, unit)
    return marked.withColumn("r", udf(F.coalesce("text", F.lit("")), "_pf_marks")).drop("_pf_marks")

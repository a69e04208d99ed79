"""Windows of texts that occur more than once, found shard by shard. Shared by substring and suffix-array dedup.

A text is a row of symbols (words or bytes), a window ``size`` neighbouring symbols. Each window has an
anchor: of its runs of ``gram`` symbols the one with the least hash, the last of equals. Equal windows have
equal anchors at equal offsets, so only windows with one anchor hash need to be compared, and:

1. All anchors of all texts are counted by hash.
2. A segment is an anchor with the windows that it anchors, size + n - 1 symbols for n windows. Segments
   whose anchor occurs once can't repeat and end here. The others are summed by content (copies become one
   row with a count) and go to the shard of their anchor.
3. A shard's segments are indexed (FM-index or suffix array), which tells each window's occurrences.
4. Windows that occur twice or more go back to their texts.

Which anchors occur more than once is told by a bitmap of one bit for each hash, of 16 bits an anchor up to
``MAX_BITS`` (32 MB): collisions only let more segments pass. Runs that occur over ``HOT`` times are anchors
only of windows that have no other run (equal windows still choose alike), so what surrounds a frequent line
isn't dealt by that line; what is left of them lies within frequent passages, whose copies are equal
segments and one row. Segments are summed within a task before they are shuffled, so a passage in a third of
all texts is one row a task. Results go back by segment: one row for each place of a segment.

An anchor whose distinct segments have over ``unit.most`` symbols together isn't indexed at once: their
windows are counted by hash in a shuffle of their own, which is exact too.

Cases: the operators' docstrings. Equal hashes (64 bits) stand for equal anchors, segments and windows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, prefix_sums, range_hash, shuffles_dropped, steps, text_arrays, window_hashes, written
from .decontam import text_key

MAX_BITS = 28
HOT = 4096
REMEMBERED = 400_000
_LOW = np.uint64((1 << 24) - 1)


@dataclass(frozen=True)
class Unit:
    """What a symbol is: ``symbols`` gives 64-bit values and each text's first; ``index`` tells which windows repeat.

    index(segments, counts, size) gets the symbols' bytes of each segment and its count, and gives a flag
    for each window, segment after segment.
    """

    size: int
    gram: int
    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    stored: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[bytes, int]]
    index: Callable[[list[bytes], np.ndarray, int], np.ndarray]
    chunk: int
    width: int

    @property
    def most(self) -> int:
        """Symbols of one anchor's distinct segments that are indexed together at most."""
        return 4 * self.chunk


def segments(values: np.ndarray, first: np.ndarray, size: int, gram: int, avoid: np.ndarray | None = None):
    """(text, start, windows, anchor hash) of all segments; starts are places in ``values``.

    Runs whose hash is in the bitmap ``avoid`` come after all others.
    """
    none = np.zeros(0, np.int64)
    if len(values) < size:
        return none, none, none, np.zeros(0, np.uint64)
    g = window_hashes(values, gram)
    least = ((g >> np.uint64(1)) & ~_LOW) | (_LOW - (np.arange(len(g), dtype=np.uint64) & _LOW))
    if avoid is not None:
        least |= _in(avoid, g).astype(np.uint64) << np.uint64(63)
    span, have = size - gram + 1, 1
    while have < span:  # minimum over span neighbours
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    counts = np.maximum(np.diff(first) - size + 1, 0)  # windows of each text
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(text)) + np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    if not len(at):
        return none, none, none, np.zeros(0, np.uint64)
    place = at + ((int(_LOW) - (least[at] & _LOW).astype(np.int64) - at) & int(_LOW))
    cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
    start = at[cut]
    return text[cut], start, np.diff(np.append(cut, len(at))), g[place[cut]]


def _parts(batch: pa.RecordBatch, unit: Unit, avoid: np.ndarray | None, column: int = 0):
    data, off = text_arrays(batch.column(column))
    for a, b in steps(off):
        part = data[off[a] : off[b]]
        values, first = unit.symbols(part, off[a : b + 1] - off[a])
        yield a, part, values, first, *segments(values, first, unit.size, unit.gram, avoid)


def _anchors(unit: Unit, avoided=None):
    def code(batches):
        avoid = avoided.value if avoided is not None else None
        for batch in batches:
            for _, _, _, _, _, _, _, h in _parts(batch, unit, avoid):
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return code


def bitmap(hashes: DataFrame, count: int) -> np.ndarray:
    """64-bit words with a bit for each value of column h, by its lowest bits."""
    bits = min(MAX_BITS, max(10, int(np.ceil(np.log2(16 * max(1, count))))))
    cell = F.col("h").bitwiseAND((1 << bits) - 1)
    words = hashes.groupBy(F.shiftright(cell, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(h & {(1 << bits) - 1} & 63 AS INT))")).alias("b"))
    with shuffles_dropped(hashes.sparkSession):
        got = words.toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return out


def _in(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    cell = h & np.uint64(len(words) * 64 - 1)
    return (words[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) > 0


def _repeating(unit: Unit, shared, batches):
    """(batch, first text, bytes, symbols, firsts, text, start, windows, anchor, content) of segments that may repeat."""
    avoid, twice = shared.value
    for batch in batches:
        for a, part, values, first, text, start, n, h in _parts(batch, unit, avoid):
            on = _in(twice, h)
            text, start, n, h = text[on], start[on], n[on], h[on]
            if len(h):
                yield batch, a, part, values, first, text, start, n, h, range_hash(prefix_sums(values), start, start + n + unit.size - 1)


def _content(unit: Unit, shared):
    """(h, own, seg, n): the distinct segments of a task, by anchor and content, with counts.

    What a task has given once, it counts on and gives again without the symbols, for all of its texts together.
    """

    def code(batches):
        seen: dict[int, int] = {}  # content to its place in the lists
        h_of, own_of, extra = [], [], []

        def rows(h, own, seg, n):
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(own, pa.int64()), pa.array(seg, pa.binary()), pa.array(n, pa.int64())], ["h", "own", "seg", "n"])

        def flush():
            n = np.array(extra, dtype=np.int64)
            again = np.flatnonzero(n)
            for a in range(0, len(again), 1 << 16):
                some = again[a : a + (1 << 16)].tolist()
                yield rows([h_of[i] for i in some], [own_of[i] for i in some], [None] * len(some), n[some])
            seen.clear()
            h_of.clear()
            own_of.clear()
            extra.clear()

        for _, _, part, values, first, _, start, n, h, own in _repeating(unit, shared, batches):
            own, at, count = np.unique(own, return_index=True, return_counts=True)
            h, own, begin, end = h[at].view(np.int64).tolist(), own.view(np.int64).tolist(), start[at].tolist(), (start[at] + n[at] + unit.size - 1).tolist()
            raw, scale = unit.stored(part, values, first)
            new = []
            for i, (o, m) in enumerate(zip(own, count.tolist(), strict=True)):
                k = seen.get(o)
                if k is None:
                    seen[o] = len(extra)
                    h_of.append(h[i])
                    own_of.append(o)
                    extra.append(0)
                    new.append(i)
                else:
                    extra[k] += m
            yield rows([h[i] for i in new], [own[i] for i in new], [raw[begin[i] * scale : end[i] * scale] for i in new], count[new])
            if len(extra) > REMEMBERED:
                yield from flush()
        yield from flush()

    return code


def _places(unit: Unit, shared):
    """(k1, k2, own, start): where the segments lie in their texts."""

    def code(batches):
        for batch, a, _, _, first, text, start, _, _, own in _repeating(unit, shared, batches):
            keys = [batch.column(k).take(pa.array(text + a)) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(own.view(np.int64)), pa.array(start - first[text])], ["k1", "k2", "own", "start"])

    return code


FLAGS = "own long, bits binary, seg binary, n long"


def _shards(unit: Unit):
    """Flags of the windows of each segment (or the segment itself, if its anchor has too many); rows come sorted by anchor."""

    def given(own, bits, seg, n):
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(bits, pa.binary()), pa.array(seg, pa.binary()), pa.array(n, pa.int64())], ["own", "bits", "seg", "n"])

    def found(rows: list[tuple[int, bytes, int]]):
        if not rows:
            return
        own, seg, n = zip(*rows, strict=True)
        hit = unit.index(list(seg), np.array(n), unit.size)
        cuts = np.cumsum([len(s) // unit.width - unit.size + 1 for s in seg])[:-1]
        out = [(o, np.packbits(bits, bitorder="little").tobytes()) for o, bits in zip(own, np.split(hit, cuts), strict=True) if bits.any()]
        if out:
            own, bits = zip(*out, strict=True)
            yield given(own, bits, [None] * len(own), [0] * len(own))

    def code(batches):
        held: list[tuple[int, bytes, int]] = []  # the rows to index together
        mine: list[tuple[int, bytes, int]] = []  # those of the anchor that is being read
        held_size = mine_size = 0
        anchor, many = None, False

        for batch in batches:
            for h, own, seg, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != anchor:
                    if held_size + mine_size > unit.chunk * unit.width:  # what one anchor has beyond a chunk is indexed alone
                        yield from found(held)
                        held, held_size = [], 0
                    held += mine
                    held_size += mine_size
                    mine, mine_size, anchor, many = [], 0, h, False
                mine.append((own, seg, n))
                mine_size += len(seg)
                if many or mine_size > unit.most * unit.width:
                    many = True
                    own, seg, n = zip(*mine, strict=True)
                    yield given(own, [None] * len(own), seg, n)
                    mine, mine_size = [], 0
        if held_size + mine_size > unit.chunk * unit.width:
            yield from found(held)
            held = []
        yield from found(held + mine)

    return code


def _windows(unit: Unit):
    """(w, own, i, n): each window of the segments (own, seg, n)."""

    def code(batches):
        for batch in batches:
            for own, seg, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = np.frombuffer(seg, dtype=np.uint8).reshape(-1, unit.width)
                values = np.zeros((len(rows), 8), dtype=np.uint8)
                values[:, : unit.width] = rows
                w = window_hashes(mix(values.view(np.uint64).ravel() + np.uint64(1)), unit.size)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.full(len(w), own)), pa.array(np.arange(len(w), dtype=np.int32)), pa.array(np.full(len(w), n))], ["w", "own", "i", "n"])

    return code


def _by_windows(unit: Unit, rest: DataFrame) -> DataFrame:
    """(own, bits) of segments (own, seg, n), by counts of their windows' hashes."""
    each = rest.select("own", "seg", "n").mapInArrow(_windows(unit), "w long, own long, i int, n long")
    twice = each.groupBy("w").agg(F.sum("n").alias("n")).where("n >= 2").select("w")
    flags = each.select("w", "own", "i").join(twice, "w").groupBy("own").agg(F.collect_list("i").alias("at"))
    byte = lambda k: F.aggregate(F.filter("at", lambda i: F.shiftright(i, 3) == k), F.lit(0), lambda acc, i: acc.bitwiseOR(F.element_at(F.array(*(F.lit(1 << b) for b in range(8))), i.bitwiseAND(7) + 1)))
    hexed = F.transform(F.sequence(F.lit(0), F.shiftright(F.array_max("at"), 3)), lambda k: F.lpad(F.hex(byte(k)), 2, "0"))
    return flags.select("own", F.unhex(F.array_join(hexed, "")).alias("bits"))


def find(spark: SparkSession, docs: DataFrame, unit: Unit, text: str = "text") -> DataFrame:
    """(k1, k2, marks): for each text with repeats, by text_key, the segments with flags of their repeated windows."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), *text_key(F.col(text)))

    def counted(avoided=None) -> DataFrame:
        rows = texts.select("text").mapInArrow(_anchors(unit, avoided), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 2")
        return written(spark, rows, "anchors")

    anchors, avoid = counted(), None
    hot = anchors.where(F.col("n") > HOT)
    many = hot.count()
    if many:
        avoid = bitmap(hot, many)
        anchors = counted(spark.sparkContext.broadcast(avoid))
    shared = spark.sparkContext.broadcast((avoid, bitmap(anchors, anchors.count())))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    content = texts.select("text").mapInArrow(_content(unit, shared), "h long, own long, seg binary, n long")
    # dealt by anchor once: that also brings the rows of one content together
    content = content.repartition(parts, "h").groupBy("h", "own").agg(F.first("seg", ignorenulls=True).alias("seg"), F.sum("n").alias("n"))
    flags = written(spark, content.sortWithinPartitions("h", "own").mapInArrow(_shards(unit), FLAGS), "flags")
    done, rest = flags.where("bits IS NOT NULL").select("own", "bits"), flags.where("bits IS NULL")
    if rest.limit(1).count():
        done = done.unionByName(_by_windows(unit, rest))
    places = texts.mapInArrow(_places(unit, shared), "k1 long, k2 long, own long, start long").distinct()
    met = places.join(done, "own")  # a segment's content tells its anchor
    return written(spark, met.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "bits")).alias("marks")), "marks")


def covered(first: np.ndarray, marks: pa.Array, size: int) -> np.ndarray:
    """Which symbols of a batch lie in a repeated window; text i has the symbols first[i] to first[i + 1]."""
    edge = np.zeros(int(first[-1]) + 1, dtype=np.int32)
    if isinstance(marks, pa.ChunkedArray):
        marks = marks.combine_chunks()
    counts = np.diff(marks.offsets.to_numpy())
    rows = marks.flatten()
    if len(rows):
        bits = rows.field("bits")
        ends = np.frombuffer(bits.buffers()[1], dtype=np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
        flags = np.unpackbits(np.frombuffer(bits.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]], bitorder="little")
        if marks.null_count:
            counts = np.where(marks.is_valid().to_numpy(zero_copy_only=False), counts, 0)
        place = np.repeat(first[:-1], counts) + rows.field("start").to_numpy() - 8 * (ends[:-1] - ends[0])
        at = (np.repeat(place, 8 * np.diff(ends)) + np.arange(len(flags)))[flags > 0]
        edge[at] += 1  # each window is marked once
        edge[at + size] -= 1
    return np.cumsum(edge[:-1]) > 0


def with_marks(spark: SparkSession, docs: DataFrame, unit: Unit, text: str = "text") -> DataFrame:
    """docs with a column _pf_marks (null where nothing repeats)."""
    found = find(spark, docs, unit, text).withColumnsRenamed({"k1": "_pf_k1", "k2": "_pf_k2", "marks": "_pf_marks"})
    k1, k2 = text_key(F.col(text))
    return docs.withColumns({"_pf_k1": k1, "_pf_k2": k2}).join(found, ["_pf_k1", "_pf_k2"], "left").drop("_pf_k1", "_pf_k2")

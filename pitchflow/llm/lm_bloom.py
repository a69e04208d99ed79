"""N-gram scoring with a log-frequency Bloom filter.

Counts of words and word pairs are quantised on a log scale: an n-gram of count c has level
1 + floor(log_base c), and the filter holds (n-gram, 1), ..., (n-gram, level). A look-up probes level 1, 2,
... until one is missing, and takes the mean count of the last level found. The filter has ``BITS_PER_ITEM``
bits for each item at every size, so its rate of false positives doesn't change with the corpus. It is never in
one place: cells of 64 kB make up shards of at most ``SHARD_CELLS``. A block of texts sends each shard one row
with its distinct n-grams by cell (words whole, pairs by 32 bits) and gets their levels back, one byte each.

All words and pairs are stored, those of count one at level 1. A pair's key is a 64-bit hash of both words' 64-bit
hashes. From probes, interpolated:

    P1(w) = (c(w) + 1) / (N + V + 1)
    P(w | v) = (1 - MU) P1(w) + MU c(vw) / c(v), or P1(w) if v is unknown

The context of a text's first token is the end token; each text ends in one. So c(v) also counts the pairs that
begin with v, and P(. | v) sums to one but for the rounding of counts to levels.

The base score uses exact counts. To get them to each text without a shuffle of all tokens, texts are dealt
into blocks of about ``BLOCK_BYTES`` by hash; each cell of the filter has the exact counts of its words beside it, by
64-bit hash, and a block's distinct words get them back with the levels.

Cases: null text counts as empty (one end token); texts of any length are counted and scored whole; with no
training texts N = V = 0 and every word is unknown; repeated rows count and are scored each time, rows equal in
id and text by one task; further columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, mix, steps, text_arrays, word_bounds, word_hashes, written

BASE = 1.5
BITS_PER_ITEM = 10
PROBES = 3
CELL_BITS = 19  # the filter is made of cells of 64 kB; all bits of an n-gram lie in one cell
SHARD_CELLS = 64
BLOCK_BYTES = 8 << 20
HOLD_TOKENS = 3_000_000
MU = 0.4
END = mix(np.array([0xE7D], dtype=np.uint64))[0]
WORD, PAIR = 0, 1
SPREAD = 0x4F1BBCDD, 0x2C1B3C6D


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end token after each text, and each text's first token (n + 1)."""
    low = LOWER[data]
    starts, ends, first = word_bounds(low, off)
    texts = len(off) - 1
    out = np.full(len(starts) + texts, END, dtype=np.uint64)
    out[np.arange(len(starts)) + np.repeat(np.arange(texts), np.diff(first))] = word_hashes(low, starts, ends)
    return out, first + np.arange(texts + 1)


def pair_keys(token: np.ndarray) -> np.ndarray:
    """Key of each token with the one before it. A text's first follows an end token."""
    before = np.empty_like(token)
    before[:1] = END
    before[1:] = token[:-1]
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + token)


def distinct(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct values; np.unique hashes, which takes many times as long as a sort of 64-bit integers."""
    x = np.sort(np.concatenate(parts))
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def _count(batches):
    """(kind, h, n) of all tokens and pairs; counts are merged over HOLD_TOKENS tokens at a time."""
    held: list[np.ndarray] = []
    size = 0

    def flush():
        if not held:
            return
        for kind, key in ((WORD, lambda x: x), (PAIR, pair_keys)):
            h, n = np.unique(np.concatenate([key(x) for x in held]), return_counts=True)
            for a in range(0, len(h), 1 << 18):
                part = h[a : a + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), pa.array(part.view(np.int64)), pa.array(n[a : a + (1 << 18)])], ["kind", "h", "n"])
        held.clear()

    for batch in batches:
        data, off = text_arrays(batch.column(0))
        for a, b in steps(off):
            held.append(tokens(data[off[a] : off[b]], off[a : b + 1] - off[a])[0])
            size += len(held[-1])
            if size >= HOLD_TOKENS:
                yield from flush()
                size = 0
    yield from flush()


def count_grams(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """Table (kind, h, n): all words and pairs with their counts."""
    rows = texts.select("text").mapInArrow(_count, "kind tinyint, h long, n long")
    return written(spark, rows.groupBy("kind", "h").agg(F.sum("n").alias("n")), "grams")


def level_of(n: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(n, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


_EDGES = np.ceil(BASE ** np.arange(0, 110) - 1e-6)
MEAN_COUNT = np.concatenate([[0.0], (_EDGES[:-1] + np.maximum(_EDGES[1:] - 1, _EDGES[:-1])) / 2])


def filter_key(kind: np.ndarray | int, h: np.ndarray) -> np.ndarray:
    """What tells n-grams of a cell apart: 32 bits."""
    return mix(h + np.asarray(kind).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(32)


def _bits(key: np.ndarray, level: np.ndarray | int) -> list[np.ndarray]:
    """The PROBES bits within the cell for keys at a level: parts of one hash."""
    x = mix(key ^ (np.atleast_1d(level).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
    return [((x >> np.uint64(64 - CELL_BITS * (p + 1))) & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64) for p in range(PROBES)]


def _cells(count: int):
    """Arrow code: (cell, kind, h, n) rows sorted by cell to (cell, bits, words): hashes, then counts, of the cell's words."""

    def code(batches):
        held_cell, bitmap, words = -1, None, []
        for batch in batches:
            cell, kind, h, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            key = filter_key(kind, h.view(np.uint64))
            top = level_of(n)
            cut = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else []
            for s, e in zip(cut, [*cut[1:], len(cell)], strict=True) if len(cell) else ():
                if cell[s] != held_cell:
                    if bitmap is not None:
                        yield _cell_row(held_cell, bitmap, words)
                    held_cell, bitmap, words = int(cell[s]), np.zeros(1 << CELL_BITS, dtype=bool), []
                k, t = np.repeat(key[s:e], top[s:e]), top[s:e]
                level = np.arange(len(k)) - np.repeat(np.cumsum(t) - t, t) + 1
                for bit in _bits(k, level):
                    bitmap[bit] = True
                own = s + np.flatnonzero(kind[s:e] == WORD)
                words.append(np.stack([h[own], n[own]]).astype(np.int64))
        if bitmap is not None:
            yield _cell_row(held_cell, bitmap, words)

    return code


def _cell_row(cell: int, bitmap: np.ndarray, words: list[np.ndarray]) -> pa.RecordBatch:
    columns = [np.packbits(bitmap, bitorder="little").tobytes()], [np.concatenate(words, axis=1).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), *(pa.array(x, pa.binary()) for x in columns)], ["cell", "bits", "words"])


def cell_column(cells: int):
    """The cell of a row: by its hash and its kind, the same as ``cell_of``."""
    low, high = F.col("h").bitwiseAND((1 << 31) - 1), F.shiftrightunsigned("h", 33)
    spread = F.shiftrightunsigned(low * F.lit(SPREAD[0]).cast("long") + high * F.lit(SPREAD[1]).cast("long"), 29).bitwiseAND((1 << 31) - 1)
    return ((spread + F.col("kind") * 7919) % cells).cast("int")


def cell_of(kind: int, h: np.ndarray, cells: int) -> np.ndarray:
    low, high = h & np.uint64((1 << 31) - 1), h >> np.uint64(33)
    spread = ((low * np.uint64(SPREAD[0]) + high * np.uint64(SPREAD[1])) >> np.uint64(29)) & np.uint64((1 << 31) - 1)
    return ((spread + np.uint64(kind * 7919)) % np.uint64(cells)).astype(np.int64)


def filter_size(grams: DataFrame) -> int:
    """Cells for BITS_PER_ITEM bits an item, however many items there are."""
    level = F.lit(1) + F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BASE)) + 1e-9)
    items = grams.agg(F.sum(level)).first()[0] or 0
    return max(1, -(-int(items) * BITS_PER_ITEM >> CELL_BITS))


def build_filter(spark: SparkSession, grams: DataFrame, cells: int) -> DataFrame:
    """The filter's table (cell, bits, words); cells without items have no row."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = grams.select(cell_column(cells).alias("cell"), "kind", "h", "n").repartition(parts, "cell").sortWithinPartitions("cell")
    return written(spark, rows.mapInArrow(_cells(cells), "cell int, bits binary, words binary"), "filter")


def levels(flat: np.ndarray, width: int, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The last level found of each key, by repeated probes of its cell."""
    found = np.zeros(len(key), dtype=np.uint8)
    live, level = np.arange(len(key)), 1
    while len(live) and level < len(MEAN_COUNT):
        base = at[live] * width
        hit = np.ones(len(live), dtype=bool)
        for bit in _bits(key[live], level):
            hit &= (flat[base + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 > 0
        live = live[hit]
        found[live] = level
        level += 1
    return found


def counts(cells: np.ndarray, kind: int, h: np.ndarray) -> np.ndarray:
    """Estimated counts by probes of a filter that is all here."""
    found = levels(cells.ravel(), cells.shape[1], cell_of(kind, h, len(cells)), filter_key(kind, h))
    return MEAN_COUNT[found]


class Routes:
    """The distinct words and pairs of a block, each sorted by cell, and where each shard's begin."""

    def __init__(self, word: np.ndarray, pair: np.ndarray, cells: int, per: int):
        self.per, self.shards = per, -(-cells // per)
        self.grams = []
        for kind, h in ((WORD, word), (PAIR, pair)):
            cell = cell_of(kind, h, cells)
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            self.grams.append((kind, h, order, cell, np.searchsorted(cell, np.arange(self.shards + 1) * per)))

    def rows(self, block: int) -> pa.RecordBatch:
        """(shard, block, sizes, keys): for each shard the numbers of words and of pairs of each cell, words' hashes and pairs' keys."""
        shard, sizes, keys = [], [], []
        parts = [(h[order] if kind == WORD else filter_key(kind, h[order]).astype(np.uint32), cell, cut) for kind, h, order, cell, cut in self.grams]
        for s in range(self.shards):
            if all(cut[s] == cut[s + 1] for _, _, cut in parts):
                continue
            shard.append(s)
            sizes.append(np.concatenate([np.bincount(cell[cut[s] : cut[s + 1]] - s * self.per, minlength=self.per) for _, cell, cut in parts]).astype(np.uint32).tobytes())
            keys.append(b"".join(key[cut[s] : cut[s + 1]].tobytes() for key, _, cut in parts))
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(np.full(len(shard), block, np.int32)), pa.array(sizes, pa.binary()), pa.array(keys, pa.binary())], ["shard", "block", "sizes", "keys"])

    def counts(self, shard: np.ndarray, found: list[bytes]) -> list[np.ndarray]:
        """Counts of words and of pairs, in the order of their hashes."""
        out = [np.zeros(len(h), dtype=np.uint8) for _, h, _, _, _ in self.grams]
        for s, part in zip(shard.tolist(), found, strict=True):
            part, a = np.frombuffer(part, np.uint8), 0
            for x, (_, _, at, _, cut) in zip(out, self.grams, strict=True):
                n = cut[s + 1] - cut[s]
                x[at[cut[s] : cut[s + 1]]] = part[a : a + n]
                a += n
        return [MEAN_COUNT[x] for x in out]

    def exact(self, shard: np.ndarray, found: list[bytes]) -> np.ndarray:
        """Exact counts of words, in the order of their hashes."""
        _, h, at, _, cut = self.grams[0]
        out = np.zeros(len(h), dtype=np.int64)
        for s, part in zip(shard.tolist(), found, strict=True):
            n = sum(int(cut[s + 1] - cut[s]) for _, _, _, _, cut in self.grams)
            out[at[cut[s] : cut[s + 1]]] = np.frombuffer(part, np.int64, offset=n) if len(part) > n else 0
        return out


def _exact_counts(table: list[np.ndarray], word: np.ndarray) -> np.ndarray:
    """Counts of words by a shard's tables (hashes, counts)."""
    if len(table) > 1:
        table[:] = [np.concatenate(table, axis=1)]
        table[0] = table[0][:, np.argsort(table[0][0])]
    if not table or not table[0].shape[1]:
        return np.zeros(len(word), np.int64)
    h, n = table[0]
    at = np.minimum(np.searchsorted(h, word), len(h) - 1)
    return np.where(h[at] == word, n[at], 0)


def _answers(per: int):
    """Arrow code: rows of the filter's cells (block -1) and of ``Routes.rows``, sorted by shard and block, to (block, shard, levels).

    A row of a cell has its words as sizes and its bits as keys. After the levels come the words' exact counts, 8 bytes each.
    """
    width = 1 << (CELL_BITS - 3)

    def code(batches):
        held, bits, table = -1, None, []
        for batch in batches:
            shard, block, cell = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            sizes, keys = batch.column(3), batch.column(4)
            cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else []
            for s, e in zip(cut, [*cut[1:], len(shard)], strict=True) if len(shard) else ():
                if shard[s] != held:
                    held, bits = int(shard[s]), np.zeros(per * width, dtype=np.uint8)
                    table = [np.zeros((2, 0), np.int64)]
                ask = s + int(np.searchsorted(block[s:e], 0))
                for i in range(s, ask):
                    at = (int(cell[i]) - held * per) * width
                    bits[at : at + width] = np.frombuffer(keys[i].as_buffer(), np.uint8)
                    if sizes[i].is_valid:
                        table.append(np.frombuffer(sizes[i].as_py(), np.int64).reshape(2, -1))
                if ask == e:
                    continue
                n = np.frombuffer(b"".join(sizes[i].as_py() for i in range(ask, e)), np.uint32).reshape(-1, 2, per).astype(np.int64)
                raw, words = [keys[i].as_py() for i in range(ask, e)], n[:, 0].sum(1).tolist()
                word = [np.frombuffer(x, np.uint64, count=k) for x, k in zip(raw, words, strict=True)]
                key = [k for w, x in zip(word, raw, strict=True) for k in (filter_key(WORD, w), np.frombuffer(x, np.uint32, offset=8 * len(w)).astype(np.uint64))]
                found = levels(bits, width, np.repeat(np.tile(np.arange(per), 2 * (e - ask)), n.ravel()), np.concatenate(key))
                exact = np.split(_exact_counts(table, np.concatenate(word).view(np.int64)), np.cumsum(words)[:-1])
                ends = np.cumsum(n.sum((1, 2)))
                out = [found[a:b].tobytes() + x.tobytes() for a, b, x in zip([0, *ends[:-1].tolist()], ends.tolist(), exact, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block[ask:e]), pa.array(shard[ask:e]), pa.array(out, pa.binary())], ["block", "shard", "levels"])

    return code


def model_scores(word: np.ndarray, pair: np.ndarray, found: list[np.ndarray], token: np.ndarray, where: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 P of each token given the one before it; found are the counts of ``Routes.counts``, where tells the tokens' places in word."""
    c, pairs = found
    p1 = np.minimum((c + 1) / (n + v + 1), 1.0)[where]
    before = np.empty_like(where)
    before[1:] = where[:-1]
    before[:1] = np.searchsorted(word, END)
    seen = np.minimum(pairs[np.searchsorted(pair, pair_keys(token))], c[before])
    return np.log10((1 - MU) * p1 + MU * np.where(c[before] > 0, seen / np.maximum(c[before], 1), p1))


def _asked(cells: int, per: int):
    """Arrow code: (block, doc_id, text) sorted by block to each block's ``Routes.rows``."""

    def code(batches):
        words, pairs, block = [], [], None

        def flush():
            if words:
                yield Routes(distinct(words), distinct(pairs), cells, per).rows(block)
                words.clear()
                pairs.clear()

        for batch in batches:
            data, off = text_arrays(batch.column(2))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in steps(off):
                token, first = tokens(data[off[a] : off[b]], off[a : b + 1] - off[a])
                cut = np.flatnonzero(np.concatenate([[True], ids[a + 1 : b] != ids[a : b - 1]]))
                for s, e in zip(cut, [*cut[1:], b - a], strict=True):
                    if ids[a + s] != block:
                        yield from flush()
                        block = int(ids[a + s])
                    part = token[first[s] : first[e]]
                    words.append(distinct([part]))
                    pairs.append(distinct([pair_keys(part)]))
        yield from flush()

    return code


def score(spark: SparkSession, docs: DataFrame, train: str = "train") -> DataFrame:
    """docs (doc_id, text, train) to doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col(train).alias("train"))
    grams = count_grams(spark, texts.where("train"))
    r = grams.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = int(r[0]), int(r[1])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = filter_size(grams)
    per = max(1, min(SHARD_CELLS, cells // (4 * parts)))
    blocks = max(1, int((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BLOCK_BYTES))
    dealt = texts.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text").repartition(parts, "block")
    by_block = dealt.sortWithinPartitions("block")
    asked = by_block.mapInArrow(_asked(cells, per), "shard int, block int, sizes binary, keys binary").select("shard", "block", F.lit(-1).alias("cell"), "sizes", "keys")
    held = build_filter(spark, grams, cells).select(F.floor(F.col("cell") / per).cast("int").alias("shard"), F.lit(-1).alias("block"), "cell", F.col("words").alias("sizes"), F.col("bits").alias("keys"))
    probed = held.unionByName(asked).repartition(parts, "shard").sortWithinPartitions("shard", "block")
    found = written(spark, probed.mapInArrow(_answers(per), "block int, shard int, levels binary"), "levels")

    def block_scores(left: pa.Table, answer: pa.Table) -> pa.Table:
        data, off = text_arrays(left["text"])
        size = len(off) - 1
        out = np.zeros((4, size))
        cut = [(a, b, *tokens(data[off[a] : off[b]], off[a : b + 1] - off[a])) for a, b in steps(off)]
        word = distinct([distinct([t]) for _, _, t, _ in cut])
        pair = distinct([distinct([pair_keys(t)]) for _, _, t, _ in cut])
        routes, shards, found = Routes(word, pair, cells, per), answer["shard"].to_numpy(), answer["levels"].to_pylist()
        model, counted = routes.counts(shards, found), routes.exact(shards, found)
        for a, b, token, first in cut:
            where = np.searchsorted(word, token)
            exact = counted[where]
            parts = ((exact > 0).astype(float), np.log10((exact + 1) / (n + v + 1)), model_scores(word, pair, model, token, where, n, v))
            out[0, a:b] = np.diff(first)
            for k, x in enumerate(parts):
                out[k + 1, a:b] = np.add.reduceat(x, first[:-1])
        return pa.table({"doc_id": left["doc_id"], "n_tokens": out[0].astype(np.int64), "n_known": out[1].astype(np.int64), "train_tokens": np.full(size, n), "base_score": out[2], "score": out[3]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(block_scores, schema)

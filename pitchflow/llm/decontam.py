"""Benchmark decontamination by template canonicalisation.

Each word becomes a template token: numbers, units after numbers and names (capitalised words) become typed
placeholders, other words lose case and edge punctuation, punctuation alone stays. Windows of five template tokens of documents
are hash-joined with those of benchmark items. What two placeholders of one type stand for may differ, but
not freely: along one alignment of a document with an item, a value of the item must stand for one value of
the document everywhere (slot consistency). An item is found if its windows on consistent alignments cover
at least ``coverage`` of all its windows. Values that differ consistently mark a re-parameterised question.

Windows need three literal words. Items of which fewer than half of the windows have them, and items of three
or four words, are looked for by windows of their words as they are (five, or the whole item), so that what they
ask for has to be there word for word. Items of one or two words are too common to tell and aren't looked
for; ``searchable`` tells which are.

Items of one template (the same tokens, and slots that agree with one another in the same places) are one row with members, so a
family of re-parameterised items costs a text no more than one item does. A text that covers a template has at least one
of any floor((1 - coverage) windows) + 1 of its windows. So only these many of each template, those that the fewest
templates share, take part in the hash join; a bitmap of them (of 64 bits a window, 32 MB at most; collisions only let more pass)
keeps other windows of documents from the shuffle. What meets is verified pair by pair, text against template. That yields what the
text has in the template's slots: a mask of the slots seen and a hash of their values. Members are summed up by the
masks that texts ask for, and an equi-join of both hashes names the items that are there word for word. If none is, the
template's least item stands for all its members, as re-parameterised.

The unit of work is a distinct text (by a 128-bit hash), so copies cost nothing and hot groups don't meet.

Cases: null and empty texts match nothing; equal items are one row with members, named by the least id (null is the least); item ids
may have any type and be null, repeated items count once; texts and items of any length are read whole; of items covered
alike one that is there word for word is best, then the least id; a text that holds several items of a family names each that
it holds whole in one piece; copies cut apart by insertions are put together slot by slot from the longest pieces; without
a benchmark nothing is found; further columns of docs are kept, but those with the names of results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import remove
from .common import BYTE_VALUE, LOWER, mix, prefix_sums, range_hash, steps, text_arrays, window_hashes, word_bounds, written

WINDOW = 5
LITERALS = 3
SHORT = (3, 4)  # words of items that are looked for whole
LEAST_BITS, MOST_BITS = 20, 28
NAME, NUMBER, UNIT = (mix(np.array([k], dtype=np.uint64))[0] for k in (1, 2, 3))
#: Units that count as such after a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg lb lbs oz ton tons gram grams kilogram kilograms pound pounds ounce ounces ml cl l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years kmh mph "
    "dollar dollars euro euros cent cents usd eur gbp percent degree degrees celsius fahrenheit c f w kw mw v a hz khz mhz ghz kb mb gb tb"
).split()
_EDGE = np.ones(256, dtype=bool)
_EDGE[48:58] = _EDGE[65:91] = _EDGE[97:123] = _EDGE[128:] = False
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def _hash_of(words: list[str]) -> np.ndarray:
    data, off = text_arrays(pa.array(words))
    return range_hash(prefix_sums(BYTE_VALUE[data]), off[:-1], off[1:])


_UNIT_HASHES = np.sort(_hash_of(list(UNITS)))


def _inner(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words' bounds without edge punctuation; none is left of a word of nothing else."""
    place = np.arange(len(data))
    following = np.minimum.accumulate(np.where(_EDGE[data], len(data), place)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(_EDGE[data], -1, place))
    starts = np.minimum(following[starts], ends)
    return starts, np.maximum(before[ends - 1] + 1, starts)


def template(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens, their values (hashes of the words), and the first token of each text (n + 1)."""
    starts, ends, first = word_bounds(data, off)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), first
    inner, till = _inner(data, starts, ends)
    full = till > inner
    starts, ends = np.where(full, inner, starts), np.where(full, till, ends)
    value = range_hash(prefix_sums(BYTE_VALUE[LOWER[data]]), starts, ends)
    lead = data[np.minimum(starts, len(data) - 1)]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    upper = full & (((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E)))
    number = full & _DIGIT[lead]
    after = np.zeros(len(value), dtype=bool)
    after[1:] = number[:-1]
    after[np.minimum(first[:-1], len(value) - 1)] = False
    unit = after & ~number & (_UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, value), len(_UNIT_HASHES) - 1)] == value)
    word = (value & ~np.uint64(1)) | (~full).astype(np.uint64)
    token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(upper, NAME, word)))
    return token, value, first


def slots(token: np.ndarray) -> np.ndarray:
    return (token == NAME) | (token == NUMBER) | (token == UNIT)


def literal(token: np.ndarray) -> np.ndarray:
    """Words of letters; what is punctuation alone has the lowest bit."""
    return ~slots(token) & (token & np.uint64(1) == 0)


def template_windows(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the windows of one or more texts with enough literal words."""
    h = window_hashes(token, WINDOW)
    sums = np.concatenate([[0], np.cumsum(literal(token))])
    at = np.flatnonzero(sums[WINDOW:] - sums[:-WINDOW] >= LITERALS) if len(h) else np.zeros(0, np.int64)
    return at, h[at]


def word_windows(value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of all windows of words; the hashes differ from those of templates."""
    h = window_hashes(value, size)
    return np.arange(len(h)), mix(h + np.uint64(size))


def size_of(token: np.ndarray) -> int:
    """How an item is looked for: 0 by template windows, 3 to 5 by windows of so many words, -1 not at all."""
    if len(token) < WINDOW:
        return len(token) if len(token) in SHORT else -1
    return 0 if 2 * len(template_windows(token)[0]) >= len(token) - WINDOW + 1 else WINDOW


def item_windows(token: np.ndarray, value: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    size = size_of(token)
    if size < 0:
        return size, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return size, *(template_windows(token) if not size else word_windows(value, size))


def agreement(token: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each slot of an item the number of the first slot with its value: what consistency asks of a text."""
    own = value[slots(token)]
    _, first, inverse = np.unique(own, return_index=True, return_inverse=True)
    return first[inverse].astype(np.uint64)


def template_key(token: np.ndarray, value: np.ndarray) -> int:
    """64 bits of what items of one template share; of an item that is looked for word for word, of all its words."""
    size = size_of(token)
    cells = value if size else np.concatenate([token, agreement(token, value)])
    order = mix(np.arange(1, len(cells) + 1, dtype=np.uint64))
    marks = np.concatenate([np.array([len(token), size + 9], dtype=np.uint64), cells ^ order])
    return int(mix(marks).sum(dtype=np.uint64).astype(np.int64))


def masked_hash(values: np.ndarray, seen: np.ndarray) -> int:
    """64 bits of the values in the slots that are seen."""
    at = np.flatnonzero(seen)
    return int(mix(values[at] ^ mix(at.astype(np.uint64) + np.uint64(1))).sum(dtype=np.uint64).astype(np.int64))


def readings(token: np.ndarray, value: np.ndarray, item_token: np.ndarray, item_value: np.ndarray, least: float) -> tuple[float, list[tuple[bytes, int]]]:
    """Share of the item's windows on consistent alignments with the text, and what the text has in its slots, as (mask, hash).

    Every alignment that covers ``least`` of the item is a reading; if none does, the longest alignments give each slot its value. Slots next to
    an alignment's windows are read as far as the tokens go on agreeing.
    """
    size, item_at, item_h = item_windows(item_token, item_value)
    at, h = (template_windows(token) if not size else word_windows(value, size)) if size >= 0 else (item_at, item_h)
    if not len(item_at) or not len(at):
        return 0.0, []
    order = np.argsort(h, kind="stable")
    low, high = (np.searchsorted(h[order], item_h, side=side) for side in ("left", "right"))
    n = high - low
    mine = np.repeat(item_at, n)
    theirs = at[order[np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)]]
    if size:
        return len(np.unique(mine)) / len(item_at), [(b"", 0)]
    cells, on = np.arange(WINDOW), slots(item_token)
    line = (theirs - mine).astype(np.int64)
    i, d, of = (mine[:, None] + cells).ravel(), (theirs[:, None] + cells).ravel(), np.repeat(line, WINDOW)
    keep = on[i]
    i, d, of = i[keep], d[keep], of[keep]
    pair = np.unique(np.stack([of.view(np.uint64), item_value[i], value[d]], axis=1), axis=0)
    # of a line's pairs those of one value of the item stand together
    torn = np.unique(pair[1:, 0][(pair[1:, :2] == pair[:-1, :2]).all(1)]).view(np.int64) if len(pair) else np.zeros(0, np.int64)
    firm = ~np.isin(line, torn)
    share = len(np.unique(mine[firm])) / len(item_at)
    if share < least - 1e-9:
        return share, []
    lines, windows = np.unique(line[firm], return_counts=True)
    lines = lines[np.argsort(-windows, kind="stable")]
    windows = np.sort(windows)[::-1]
    place, among, far = np.flatnonzero(on), np.arange(len(item_token)), len(token) - 1

    def read(some: np.ndarray) -> tuple[bytes, int]:
        seen, got = np.zeros(len(place), bool), np.zeros(len(place), np.uint64)
        for shift in some[::-1]:  # longer alignments come last and win
            beside = among + shift
            alike = (beside >= 0) & (beside <= far) & (token[np.clip(beside, 0, far)] == item_token)
            run = np.cumsum(~alike)  # words that agree in a row around a window
            own = (alike & np.isin(run, run[mine[line == shift]]))[place]
            seen[own], got[own] = True, value[place[own] + shift]
        return np.packbits(seen).tobytes(), masked_hash(got, seen)

    whole = lines[windows >= least * len(item_at) - 1e-9]
    return share, [read(np.array([shift])) for shift in whole] if len(whole) else [read(lines)]


def _members(batches):
    """(q, item) to (q, template, values): the template of each item and the values of its slots."""
    for batch in batches:
        token, value, first = template(*text_arrays(batch.column(1)))
        own = [(token[a:b], value[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        keys = pa.array([template_key(t, v) for t, v in own], pa.int64())
        values = pa.array([v[slots(t)].tobytes() if size_of(t) == 0 else b"" for t, v in own], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), keys, values], ["q", "template", "values"])


def _hashed(values: pa.Array, mask: pa.Array) -> pa.Array:
    out = []
    for v, m in zip(values.to_pylist(), mask.to_pylist(), strict=True):
        own = np.frombuffer(v, dtype=np.uint64)
        out.append(masked_hash(own, np.unpackbits(np.frombuffer(m, np.uint8), count=len(own)) > 0))
    return pa.array(out, pa.int64())


def _item_rows(batches):
    """(template, item) to (template, size, at, h, windows)."""
    for batch in batches:
        token, value, first = template(*text_arrays(batch.column(1)))
        for i in range(batch.num_rows):
            own = slice(first[i], first[i + 1])
            size, at, h = item_windows(token[own], value[own])
            columns = [batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(at), np.int64))), pa.array(np.full(len(at), size, np.int32)), pa.array(at), pa.array(h.view(np.int64)), pa.array(np.full(len(at), len(at), np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["template", "size", "at", "h", "windows"])


def _text_rows(shared):
    """(text, k1, k2) to (k1, k2, h): the windows of texts that the bitmap has."""

    def code(batches):
        bits, sizes = shared.value
        cells = np.uint64(len(bits) * 64 - 1)
        for batch in batches:
            data, off = text_arrays(batch.column(0))
            for a, b in steps(off):
                token, value, first = template(data[off[a] : off[b]], off[a : b + 1] - off[a])
                text, hashes = [], []
                for size in sizes:
                    at, h = template_windows(token) if not size else word_windows(value, size)
                    cell = h & cells
                    on = (bits[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) > 0
                    at, h = at[on], h[on]
                    of = np.searchsorted(first, at, side="right") - 1
                    on = at + (size or WINDOW) <= first[of + 1]
                    text.append(of[on])
                    hashes.append(h[on])
                pair = np.unique(np.stack([np.concatenate([np.zeros(0, np.int64), *text]).astype(np.uint64), np.concatenate([np.zeros(0, np.uint64), *hashes])], axis=1), axis=0)
                if len(pair):
                    keys = [batch.column(k).take(pa.array(pair[:, 0].astype(np.int64) + a)) for k in (1, 2)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(pair[:, 1].view(np.int64))], ["k1", "k2", "h"])

    return code


def _verified(coverage: float):
    """(k1, k2, template, text, item) to (k1, k2, template, coverage, mask, h) of templates that are found, a row for each reading."""

    def code(batches):
        for batch in batches:
            data, off = text_arrays(batch.column(3))
            items, item_off = text_arrays(batch.column(4))
            for a, b in steps(off):
                token, value, first = template(data[off[a] : off[b]], off[a : b + 1] - off[a])
                item_token, item_value, item_first = template(items[item_off[a] : item_off[b]], item_off[a : b + 1] - item_off[a])
                at, rows = [], []
                for i in range(b - a):
                    text, item = slice(first[i], first[i + 1]), slice(item_first[i], item_first[i + 1])
                    share, found = readings(token[text], value[text], item_token[item], item_value[item], coverage)
                    if share >= coverage - 1e-9:
                        at += [a + i] * len(found)
                        rows += [(share, *reading) for reading in found]
                if at:
                    keys = [batch.column(k).take(pa.array(at)) for k in range(3)]
                    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.float64(), pa.binary(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*keys, *columns], ["k1", "k2", "template", "coverage", "mask", "h"])

    return code


def searchable(text: Column | str) -> Column:
    """Whether an item has enough words to be looked for."""

    def code(col: pa.Array) -> pa.Array:
        token, _, first = template(*text_arrays(col))
        return pa.array([size_of(token[a:b]) >= 0 for a, b in zip(first[:-1], first[1:], strict=True)], pa.bool_())

    return F.arrow_udf(code, "boolean")(F.col(text) if isinstance(text, str) else text)


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """64-bit words with a bit for each value of column h, by its lowest bits."""
    count = seeds.select("h").distinct().count()
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(64 * max(1, count))))))
    mask = (1 << bits) - 1
    words = seeds.groupBy(F.shiftright(F.col("h").bitwiseAND(mask), 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(h & {mask} & 63 AS INT))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def members(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, template, values): every item once, with its template and the values of its slots."""
    items = benchmark.where("text IS NOT NULL").select("item_id", F.col("text").alias("item")).distinct()
    keyed = items.select(F.struct("item_id", "item").alias("q"), "item").mapInArrow(_members, f"q struct<item_id:{benchmark.schema['item_id'].dataType.simpleString()},item:string>, template long, values binary")
    return keyed.select("q.item_id", "q.item", "template", "values")


def find(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8, text: str = "text") -> DataFrame:
    """(k1, k2, item_id, coverage, reparameterised, members): items found in texts; k1, k2 = text_key of the text.

    An item that is there word for word has a row with the number of items equal to it; of a template with no such item the
    least item has one, with the number of items of the template.
    """
    items = written(spark, members(benchmark), "items")
    least = F.min(F.struct("item_id", "item"))
    templates = written(spark, items.groupBy("template").agg(least.alias("least"), F.count("*").alias("members")), "templates")
    windows = templates.select("template", "least.item").mapInArrow(_item_rows, "template long, size int, at long, h long, windows long")
    shared_by = windows.groupBy("h").agg(F.count_distinct("template").alias("templates"))
    order = Window.partitionBy("template").orderBy("templates", "h", "at")  # a window's rows are those of one template
    ranked = windows.join(shared_by, "h").withColumn("rank", F.row_number().over(order))
    seeds = ranked.where(F.col("rank") <= F.floor(F.col("windows") * (1 - coverage) + 1e-6) + 1)
    seeds = written(spark, seeds.select("template", "size", "h").distinct(), "seeds")
    sizes = sorted(r[0] for r in seeds.select("size").distinct().collect())
    shared = spark.sparkContext.broadcast((_bitmap(seeds), sizes))
    texts = docs.select(F.col(text).alias("text"), *text_key(F.col(text))).where("text IS NOT NULL")
    hits = texts.select("text", "k1", "k2").mapInArrow(_text_rows(shared), "k1 long, k2 long, h long").distinct()
    pairs = written(spark, hits.join(seeds.select("h", "template"), "h").select("k1", "k2", "template").distinct(), "pairs")
    met = pairs.join(templates.select("template", "least.item"), "template").join(texts.dropDuplicates(["k1", "k2"]), ["k1", "k2"]).select("k1", "k2", "template", "text", "item")
    read = written(spark, met.mapInArrow(_verified(coverage), "k1 long, k2 long, template long, coverage double, mask binary, h long"), "readings")
    remove(spark, seeds, pairs)
    asked = items.select("template", "item_id", "values").join(read.select("template", "mask").distinct(), "template")
    named = asked.groupBy("template", "mask", F.arrow_udf(_hashed, "long")("values", "mask").alias("h")).agg(F.min(F.struct("item_id")).alias("least"), F.count("*").alias("members"))
    whole = read.join(named, ["template", "mask", "h"]).groupBy("k1", "k2", "template", "least").agg(F.max("coverage").alias("coverage"), F.max("members").alias("members"))
    others = read.join(whole.select("k1", "k2", "template").distinct(), ["k1", "k2", "template"], "left_anti").groupBy("k1", "k2", "template").agg(F.max("coverage").alias("coverage"))
    others = others.join(templates.select("template", "least", "members"), "template")
    columns = ["k1", "k2", F.col("least.item_id").alias("item_id"), "coverage"]
    return whole.select(*columns, F.lit(False).alias("reparameterised"), "members").unionByName(others.select(*columns, F.lit(True).alias("reparameterised"), "members"))


def text_key(text) -> tuple:
    """Two 64-bit hashes that stand for a text; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(5), whole).alias("k2")


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8) -> DataFrame:
    """docs' columns and n_items, best_item, coverage, reparameterised, members (0 and nulls for clean rows).

    n_items counts the items that are there word for word; if there are none, those whose templates are. reparameterised and members are
    those of the best item. Columns of docs with one of these names are replaced.
    """
    docs = docs.drop("n_items", "best_item", "coverage", "reparameterised", "members")
    found = find(spark, docs, benchmark, coverage)
    count = lambda changed: F.sum(F.when(F.col("reparameterised") == changed, F.col("members")))
    best = found.groupBy("k1", "k2").agg(F.coalesce(count(False), count(True)).alias("n_items"), F.min(F.struct((-F.col("coverage")).alias("c"), "reparameterised", "item_id", "members")).alias("b"))
    best = best.select(F.col("k1").alias("_pf_k1"), F.col("k2").alias("_pf_k2"), "n_items", F.col("b.item_id").alias("best_item"), (-F.col("b.c")).alias("coverage"), "b.reparameterised", "b.members")
    k1, k2 = text_key(F.col("text"))
    keyed = docs.withColumns({"_pf_k1": k1, "_pf_k2": k2})
    out = keyed.join(best, ["_pf_k1", "_pf_k2"], "left").drop("_pf_k1", "_pf_k2")
    return out.withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("long")))

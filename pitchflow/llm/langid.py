"""Language identification by prediction by partial matching.

For each language a variable-order byte context tree (orders 0 to 3, escape method C, no exclusions) is
counted once over training texts and then frozen. A text's code length under a language is the sum over
its bytes of -log2 P(byte | longest context in the tree); the shortest code wins.

A tree is sparse: sorted codes of the contexts and of the symbols seen in them, with their costs in bits; what
wasn't seen costs the context's escape and is looked up one order lower. Order 1 is a full table of 256 x 256.

Every language is learned, from ``per_lang`` training texts (distinct and whole, those of the lowest hashes) and its ``max_nodes``
most frequent contexts of order 2 and of order 3. Tasks count the texts they hold, Spark sums the counts and picks the contexts, and a
worker lays out each language's tree from these alone, so that no task gathers texts. The driver and workers get trees of some
1.5 MB each: the model grows with the number of languages alone, and one of over ``MOST_BYTES`` is refused.

Cases: null text or no letter gives 'und' and score 0; rows without language teach nothing; with no
training rows every text is 'und'; ties go to the first language by name; texts of any length are scored
whole; repeated rows teach once and are scored alike; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import remove
from .common import steps, text_arrays, written

PAD = 10  # the byte that stands before a text, three times
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
MOST_BYTES = 1 << 29  # of a model, as it is broadcast
MOST_LANGS = 10_000  # whose draws (a row each) are broadcast to the texts


def training_sample(rows: DataFrame, per_lang: int = 300) -> DataFrame:
    """(lang, text): per_lang distinct texts of each language (all, if it has fewer), the same ones on every run."""
    rows = rows.where("lang IS NOT NULL AND text <> ''").select("lang", "text", F.xxhash64(F.lit(17), "text").alias("_draw"))
    # only hashes are shuffled, and of these a task hands on no more than per_lang for each language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_draw"))
    lowest = rows.select("lang", "_draw").distinct().withColumn("_rank", rank).where(F.col("_rank") <= per_lang)
    last = written(rows.sparkSession, lowest.groupBy("lang").agg(F.max("_draw").alias("_last")), "draws")
    if last.count() <= MOST_LANGS:  # else there are so many that texts dealt by language make no large groups
        last = F.broadcast(last)
    return rows.join(last, "lang").where("_draw <= _last").select("lang", "text").distinct()


def _padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with three PAD bytes before each, and the place of each byte of data."""
    place = np.arange(len(data)) + 3 * np.repeat(np.arange(1, len(off)), np.diff(off))
    out = np.full(len(data) + 3 * (len(off) - 1), PAD, dtype=np.uint8)
    out[place] = data
    return out, place


def grams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each byte with the three before it in its text."""
    padded, place = _padded(data, off)
    b = padded.astype(np.uint32)
    return (b[place - 3] << 24) | (b[place - 2] << 16) | (b[place - 1] << 8) | b[place]


def _costs(gram: np.ndarray, n: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> list[np.ndarray]:
    """Of counted grams (context and symbol) of kept contexts, with the contexts' totals and kinds: grams with the symbol's cost, contexts with their escapes'."""
    order = np.argsort(gram)
    gram, n, total, kinds = gram[order], n[order], total[order].astype(np.float64), kinds[order]
    ctx, first = np.unique(gram >> 8, return_index=True)
    return [gram.astype(np.uint32), np.log2((total + kinds) / n).astype(np.float32), ctx.astype(np.uint32), np.log2((total + kinds) / kinds)[first].astype(np.float32)]


def _kept(gram: np.ndarray, n: np.ndarray, most: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grams of the most frequent contexts, with counts, and totals and kinds of their contexts."""
    ctx, at = np.unique(gram >> 8, return_inverse=True)
    total, kinds = np.bincount(at, weights=n, minlength=len(ctx)), np.bincount(at, minlength=len(ctx))
    keep = np.flatnonzero(total >= least)
    on = np.isin(at, keep[np.lexsort((ctx[keep], -total[keep]))][:most])
    return gram[on], n[on], total[at[on]], kinds[at[on]]


def _summed(gram: np.ndarray, n: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    short, at = np.unique(gram & mask, return_inverse=True)
    return short, np.bincount(at, weights=n, minlength=len(short))


class LanguageTree:
    """Frozen context tree of one language."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts
        (self.gram3, self.cost3, self.ctx3, self.esc3, self.gram2, self.cost2, self.ctx2, self.esc2, self.order1) = parts

    @classmethod
    def of(cls, texts: list[bytes], max_nodes: int, least: int) -> LanguageTree:
        three = np.unique(grams(*text_arrays(pa.array(texts, pa.large_binary()))), return_counts=True)
        two, one = _summed(*three, 0xFFFFFF), _summed(*three, 0xFFFF)
        return cls.laid_out(_kept(*three, max_nodes, least), _kept(*two, max_nodes, least), one)

    @classmethod
    def laid_out(cls, three: tuple, two: tuple, one: tuple[np.ndarray, np.ndarray]) -> LanguageTree:
        """From the kept grams of orders 3 and 2 and the counts of all pairs of bytes."""
        p = np.full(256, 1 / 256)
        for count in (np.bincount(one[0] & 255, weights=one[1], minlength=256)[None], np.bincount(one[0], weights=one[1], minlength=1 << 16).reshape(256, 256)):
            total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
            p = np.where(total > 0, np.where(count > 0, count, kinds * p) / np.maximum(total + kinds, 1), p)
        return cls([*_costs(*three), *_costs(*two), -np.log2(np.broadcast_to(p, (256, 256))).astype(np.float32).ravel()])

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each four."""
        out = np.zeros(len(gram))
        left = np.arange(len(gram))
        for mask, grams, cost, ctxs, escape in ((0xFFFFFFFF, self.gram3, self.cost3, self.ctx3, self.esc3), (0xFFFFFF, self.gram2, self.cost2, self.ctx2, self.esc2)):
            if not len(grams):
                continue
            g = gram[left] & np.uint32(mask)
            at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
            hit = grams[at] == g
            out[left[hit]] += cost[at[hit]]
            left, g = left[~hit], g[~hit] >> np.uint32(8)
            at = np.minimum(np.searchsorted(ctxs, g), len(ctxs) - 1)
            out[left] += np.where(ctxs[at] == g, escape[at], 0)
        out[left] += self.order1[gram[left] & np.uint32(0xFFFF)]
        return out


class ContextTrees:
    """Frozen context trees of all languages."""

    def __init__(self, texts: dict[str, list[bytes]] | None = None, max_nodes: int = 12_000, least: int = 2, trees: dict[str, LanguageTree] | None = None):
        made = trees if trees is not None else {k: LanguageTree.of(v, max_nodes, least) for k, v in (texts or {}).items()}
        self.langs = sorted(made)
        self.trees = [made[k] for k in self.langs]

    def code_lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of each text under each language: (texts, languages)."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        for a, b in steps(off):
            o = off[a : b + 1] - off[a]
            gram, at = np.unique(grams(data[off[a] : off[b]], o), return_inverse=True)
            for k, tree in enumerate(self.trees):
                sums = np.concatenate([[0.0], np.cumsum(tree.costs(gram)[at])])
                out[a:b, k] = sums[o[1:]] - sums[o[:-1]]
        return out


def has_letter(col: pa.Array, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(LETTER[data])])
    out = sums[off[1:]] > sums[off[:-1]]
    for i in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[i] = any(map(str.isalpha, col[int(i)].as_py()))
    return out


TREE = [("f" + str(i), kind) for i, kind in enumerate(("u4", "f4", "u4", "f4", "u4", "f4", "u4", "f4", "f4"))]


def _counted(batches):
    """(lang, text) to (lang, gram, n): what a batch's texts count, language by language."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        code = langs.indices.to_numpy().astype(np.uint64)
        data, off = text_arrays(batch.column(1))
        for a, b in steps(off):
            o = off[a : b + 1] - off[a]
            both, n = np.unique((np.repeat(code[a:b], np.diff(o)) << np.uint64(32)) | grams(data[off[a] : off[b]], o), return_counts=True)
            lang = langs.dictionary.take(pa.array((both >> np.uint64(32)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([lang, pa.array((both & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def fit(rows: DataFrame, per_lang: int = 300, max_nodes: int = 12_000, least: int = 2) -> ContextTrees:
    """Trains on the (lang, text) rows. Counts are summed by Spark; a task lays out a language's tree from its kept contexts, and trees come to the driver."""
    spark = rows.sparkSession
    three = training_sample(rows, per_lang).mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    three = written(spark, three, "grams")
    shorter = lambda mask: three.groupBy("lang", F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.sum("n").alias("n"))

    def kept(counts: DataFrame, order: int) -> DataFrame:
        own = counts.withColumn("ctx", F.shiftright("gram", 8))
        total = own.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where(F.col("total") >= least)
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("total"), "ctx"))
        return own.join(total.withColumn("rank", rank).where(F.col("rank") <= max_nodes), ["lang", "ctx"]).select("lang", F.lit(order).alias("order"), "gram", "n", "total", "kinds")

    none = F.lit(0).cast("long")
    parts = kept(three, 3).unionByName(kept(shorter(0xFFFFFF), 2)).unionByName(shorter(0xFFFF).select("lang", F.lit(1).alias("order"), "gram", "n", none.alias("total"), none.alias("kinds")))

    def build(group: pa.Table) -> pa.Table:
        order, *columns = (group[c].to_numpy() for c in ("order", "gram", "n", "total", "kinds"))
        of = lambda k, few: tuple(c[order == k] for c in columns[:few])
        tree = LanguageTree.laid_out(of(3, 4), of(2, 4), of(1, 2))
        return pa.table({"lang": group["lang"][:1], **{name: pa.array([x.tobytes()], pa.binary()) for (name, _), x in zip(TREE, tree.parts, strict=True)}})

    trees = written(spark, parts.groupBy("lang").applyInArrow(build, "lang string, " + ", ".join(f"{name} binary" for name, _ in TREE)), "trees")
    size = trees.agg(F.sum(sum(F.octet_length(name) for name, _ in TREE))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"trees of all languages come to {size >> 20} MB, over {MOST_BYTES >> 20}: lower max_nodes, or check the values of lang")
    got = trees.collect()
    remove(spark, three, trees)
    return ContextTrees(trees={r.lang: LanguageTree([np.frombuffer(r[name], dtype=kind) for name, kind in TREE]) for r in got})


def predict(trees: ContextTrees, text: Column | str, spark) -> Column:
    """Struct (lang_pred, score): score is the winner's share of 2**-length over all languages."""
    shared = spark.sparkContext.broadcast(trees)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def code(col: pa.Array) -> pa.Array:
        model = shared.value
        data, off = text_arrays(col)
        known = has_letter(col, data, off) if model.langs else np.zeros(len(col), bool)
        names, score = np.full(len(col), "und", dtype=object), np.zeros(len(col))
        if known.any():
            bits = model.code_lengths(data, off)
            best = bits.argmin(1)
            share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            names[known] = np.array(model.langs, dtype=object)[best[known]]
            score[known] = share[known]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], ["lang_pred", "score"])

    return code(text)

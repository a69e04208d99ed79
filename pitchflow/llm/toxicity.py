"""Toxicity scores by a counterfactual-regularised classifier.

A sparse logistic model. Its features are a text's distinct words, and the beginnings of words (of 4 to 12
bytes, of longer words), counted: that at least 1, 2 or 4 distinct words of the text begin so. Inflected
languages show an insult in many forms, of which each single one is rare. Each labelled text that names a
group of people gets counterfactual twins in which the term is swapped for the other terms of its kind and
for a neutral one, before features are made; training adds ``pairing`` times the mean squared change of the
log-odds between a text and its twins, so that a neutral mention of a group moves no score. A first-order
penalty leaves few features with a weight, so that the length of a text doesn't matter.

The model is fitted on at most about ``max_rows`` labelled texts of each class (drawn by the hash of
doc_id, weighted back to the true shares; equal texts once). Their features are made, counted and chosen by
the workers; numbers of chosen features come to the driver. Every text is scored whole.

Cases: null text counts as empty; texts of any length are learned and scored whole; labels other than 0 and
1 or null teach nothing; of several labels for one doc_id the highest holds; repeated rows teach once and are
scored alike; with no labelled rows every score is 0.01. Other columns are never read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, mix, prefix_sums, range_hash, steps, text_arrays, word_bounds, written

BEGINNINGS = range(4, 13)  # bytes
BINS = np.array([1, 2, 4])  # a beginning's numbers of distinct words
WHOLE = np.uint64(0x9FB21C651E98DF25)  # tells a word from a beginning
_BIN_MASK = ~np.uint64(3)
FLUSH = 2_000_000

#: Kinds of identity terms; the last of each kind is its neutral term.
IDENTITY_TERMS = (
    ("woman", "man", "girl", "boy", "female", "male", "transgender", "person"),
    ("women", "men", "girls", "boys", "females", "males", "people"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "religious"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "believers"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous", "ethnic"),
    ("gay", "lesbian", "bisexual", "queer", "straight", "heterosexual", "homosexual", "sexual"),
    ("immigrant", "refugee", "migrant", "foreigner", "native", "citizen"),
    ("immigrants", "refugees", "migrants", "foreigners", "natives", "citizens"),
    ("blind", "deaf", "disabled", "autistic", "old", "young", "human"),
    ("mexican", "chinese", "american", "german", "french", "spanish", "russian", "indian", "national"),
    ("mujer", "hombre", "musulmán", "cristiano", "judío", "negro", "blanco", "inmigrante", "persona"),
    ("femme", "homme", "musulman", "chrétien", "juif", "noir", "blanc", "immigré", "personne"),
    ("frau", "mann", "muslim", "christ", "jude", "schwarzer", "weißer", "ausländer", "mensch"),
)


def plain(text: Column) -> Column:
    """Lower-case letters; all else is a space."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")


def plain_text(text: str) -> str:
    return "".join(c if c.isalpha() else " " for c in text.lower())


def stems(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash): each text's distinct words, and the beginnings of each of them, of plain texts."""
    starts, ends, first = word_bounds(data, off)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = prefix_sums(BYTE_VALUE[data])
    whole = range_hash(sums, starts, ends)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    one = np.unique(mix(whole + text.astype(np.uint64) * WHOLE), return_index=True)[1]
    one.sort()
    starts, ends, text, whole = starts[one], ends[one], text[one], whole[one]
    at, out = [text], [whole ^ WHOLE]
    for k in BEGINNINGS:
        on = np.flatnonzero(ends - starts > k)
        at.append(text[on])
        out.append(range_hash(sums, starts[on], starts[on] + k))
    return np.concatenate(at), np.concatenate(out) & _BIN_MASK


def counted(text: np.ndarray, stem: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, stem, count), sorted by text."""
    order = np.lexsort((stem, text))
    text, stem = text[order], stem[order]
    cut = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (stem[1:] != stem[:-1])])) if len(text) else np.zeros(0, np.int64)
    return text[cut], stem[cut], np.diff(np.append(cut, len(text)))


def binned(text: np.ndarray, stem: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature): a feature is a stem whose two lowest bits tell the bin."""
    parts = [(text[count >= b], stem[count >= b] | np.uint64(i)) for i, b in enumerate(BINS)]
    return np.concatenate([t for t, _ in parts]), np.concatenate([f for _, f in parts])


def _word_hash(word: str) -> int:
    data, off = text_arrays(pa.array([word]))
    return int((range_hash(prefix_sums(BYTE_VALUE[data]), off[:1], off[1:]) ^ WHOLE)[0] & _BIN_MASK)


def _stems_of(word: str) -> np.ndarray:
    return np.unique(stems(*text_arrays(pa.array([word])))[1])


TERM_STEMS = {w: _stems_of(w) for kind in IDENTITY_TERMS for w in kind}
_TERM_OF = {_word_hash(w): w for w in TERM_STEMS}


def twins(have: dict[int, int]) -> list[tuple[list[int], list[int]]]:
    """(gained, lost) features of each twin of a text with these counts of stems."""
    terms = {_TERM_OF[s] for s in have.keys() & _TERM_OF.keys()}
    bins = {int(b): i for i, b in enumerate(BINS)}
    out = []
    for kind in IDENTITY_TERMS:
        for term in terms.intersection(kind):
            for other in kind:
                if other in terms:
                    continue
                old, new = TERM_STEMS[term], TERM_STEMS[other]
                lost = [int(s) | bins[have[int(s)]] for s in np.setdiff1d(old, new) if have.get(int(s)) in bins]
                gained = [int(s) | bins[have.get(int(s), 0) + 1] for s in np.setdiff1d(new, old) if have.get(int(s), 0) + 1 in bins]
                out.append((gained, lost))
    return out


@dataclass
class Rows:
    """Training rows: labels, weights, three minimum hashes, features, twins."""

    label: list[int]
    weight: list[float]
    low: list[tuple[int, int, int]]
    features: list[np.ndarray]
    twins: list[list[tuple[list[int], list[int]]]]


_SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def described(data: np.ndarray, off: np.ndarray):
    """For each plain text: minimum hashes of its words, features, twins."""
    terms = np.sort(np.array(list(_TERM_OF), dtype=np.uint64))
    for a, b in steps(off):
        text, stem, count = counted(*stems(data[off[a] : off[b]], off[a : b + 1] - off[a]))
        at, feature = binned(text, stem, count)
        order = np.argsort(at, kind="stable")
        at, feature = at[order], feature[order]
        cut, begin = np.searchsorted(at, np.arange(b - a + 1)), np.searchsorted(text, np.arange(b - a + 1))
        named = np.isin(stem, terms)
        for i in range(b - a):
            own = slice(begin[i], begin[i + 1])
            low = tuple(int(mix(stem[own] * np.uint64(m)).min()) if begin[i] < begin[i + 1] else 0 for m in _SPREAD)
            pairs = twins(dict(zip(stem[own].tolist(), count[own].tolist(), strict=True))) if named[own].any() else []
            yield low, feature[cut[i] : cut[i + 1]], pairs


def no_near_copies(low: list[tuple[int, int, int]]) -> list[int]:
    """Numbers of the rows that aren't near copies of an earlier one (two of three minimum hashes agree)."""
    seen, keep = set(), []
    for k, mins in enumerate(low):
        pairs = {(i, mins[i], mins[i - 1]) for i in range(3)}
        if not pairs & seen:
            keep.append(k)
        seen |= pairs
    return keep


@dataclass
class ToxicityModel:
    """Weights of features; those of a stem are summed up to each bin."""

    stems: np.ndarray
    gain: np.ndarray  # (stems, bins)
    bias: float

    @staticmethod
    def of(features: np.ndarray, weights: np.ndarray, bias: float) -> ToxicityModel:
        on = np.abs(weights) > 1e-6
        features, weights = features[on], weights[on]
        names, at = np.unique(features & _BIN_MASK, return_inverse=True)
        gain = np.zeros((len(names), len(BINS)))
        np.add.at(gain, (at, (features & np.uint64(3)).astype(np.int64)), weights)
        return ToxicityModel(names, gain.cumsum(1), bias)

    def log_odds(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.full(len(off) - 1, self.bias)
        if not len(self.stems):
            return out
        for a, b in steps(off):
            text, stem = stems(data[off[a] : off[b]], off[a : b + 1] - off[a])
            at = np.minimum(np.searchsorted(self.stems, stem), len(self.stems) - 1)
            hit = self.stems[at] == stem
            text, at, count = counted(text[hit], at[hit])
            level = np.searchsorted(BINS, count, side="right") - 1
            out[a:b] += np.bincount(text, weights=self.gain[at, level], minlength=b - a)
        return out

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-self.log_odds(*text_arrays(pa.array([plain_text(text)])))[0])))


def chosen(count: np.ndarray, toxic: np.ndarray, n: int, n1: int, least: int = 3) -> np.ndarray:
    """Features whose number of toxic texts is far from the expected one."""
    mean = count * n1 / max(n, 1)
    return (count >= least) & ((toxic - mean) ** 2 > 9 * mean * (1 - n1 / max(n, 1)) * (1 - count / max(n, 1)) + 1)


def descend(names: np.ndarray, rows: list[np.ndarray], pairs: list[tuple[float, list[int], list[int]]], y: np.ndarray, c: np.ndarray, pairing: float, sparse: float, refit: float, rounds: int) -> ToxicityModel:
    """Accelerated proximal gradient on log loss + pairing * twins' penalty + a multiple of |w|.

    The first pass, with the multiple sparse / sqrt(rows), chooses the features; the second, with ``refit``, weighs them.
    ``rows`` are feature numbers of each text, ``pairs`` weighted twins with the numbers they gain and lose.
    """
    n, size = len(y), len(names)
    c = c / c.sum()
    rate = float(np.clip((c * y).sum(), 1e-4, 1 - 1e-4))
    at, col = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate([np.zeros(0, np.int64), *rows])
    share = np.array([p[0] for p in pairs])
    p_at = np.repeat(np.arange(len(pairs)), [len(g) + len(x) for _, g, x in pairs]) if pairs else np.zeros(0, np.int64)
    p_col = np.array([k for _, g, x in pairs for k in (*g, *x)], dtype=np.int64)
    sign = np.array([s for _, g, x in pairs for s in (*[1.0] * len(g), *[-1.0] * len(x))])

    def gradient(w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        z = bias + np.bincount(at, weights=w[col], minlength=n)
        r = c * (1 / (1 + np.exp(-z)) - y)
        g = np.bincount(col, weights=r[at], minlength=size)
        if len(share):
            d = 2 * pairing * share * np.bincount(p_at, weights=sign * w[p_col], minlength=len(share))
            g = g + np.bincount(p_col, weights=sign * d[p_at], minlength=size)
        return g, r.sum()

    # the largest curvature, by power iteration
    v, curve = np.ones(size) / np.sqrt(max(size, 1)), 1.0
    for _ in range(30):
        g = np.bincount(col, weights=(0.25 * c * np.bincount(at, weights=v[col], minlength=n))[at], minlength=size)
        if len(share):
            g = g + np.bincount(p_col, weights=sign * (2 * pairing * share * np.bincount(p_at, weights=sign * v[p_col], minlength=len(share)))[p_at], minlength=size)
        curve = max(float(np.linalg.norm(g)), 1e-9)
        v = g / curve
    step = 1 / (1.1 * curve + 0.3)
    w, bias, momentum = np.zeros(size), float(np.log(rate / (1 - rate))), 1.0
    v, vb, allowed = w, bias, np.ones(size, dtype=bool)
    for k in range(2 * rounds):
        if k == rounds:
            allowed, momentum, v, vb = np.abs(w) > 1e-6, 1.0, w, bias
        g, gb = gradient(v, vb)
        w2, b2 = v - step * g, vb - step * gb
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * (sparse / np.sqrt(n) if k < rounds else refit), 0) * allowed
        m2 = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, vb = w2 + (momentum - 1) / m2 * (w2 - w), b2 + (momentum - 1) / m2 * (b2 - bias)
        w, bias, momentum = w2, b2, m2
    return ToxicityModel.of(names, w, float(bias))


#: Weight of the twins' penalty, the two first-order penalties, rounds of each pass.
SETTINGS = {"pairing": 5.0, "sparse": 0.08, "refit": 1e-4, "rounds": 300}
NOTHING = ToxicityModel(np.zeros(0, np.uint64), np.zeros((0, len(BINS))), float(np.log(0.01 / 0.99)))


def _numbers(names: np.ndarray, features) -> np.ndarray:
    features = np.asarray(features, dtype=np.uint64)
    at = np.minimum(np.searchsorted(names, features), max(len(names) - 1, 0))
    return at[names[at] == features] if len(names) else np.zeros(0, np.int64)


def _weighted(names: np.ndarray, weight: float, pairs) -> list[tuple[float, list[int], list[int]]]:
    out = [(weight / len(pairs), _numbers(names, g).tolist(), _numbers(names, x).tolist()) for g, x in pairs]
    return [p for p in out if p[1] or p[2]]


def train(texts: list[str], labels: list[int], weights: list[float], **settings) -> ToxicityModel:
    """The same as ``fit`` over texts in memory."""
    rows = list(described(*text_arrays(pa.array([plain_text(t) for t in texts], pa.string()))))
    keep = no_near_copies([r[0] for r in rows])  # else the labels of one group of copies would teach its own words
    if not keep:
        return NOTHING
    y, c = np.array([labels[k] for k in keep], dtype=float), np.array([weights[k] for k in keep], dtype=float)
    every, at = np.unique(np.concatenate([rows[k][1] for k in keep]), return_inverse=True)
    label = np.repeat(y, [len(rows[k][1]) for k in keep])
    names = every[chosen(np.bincount(at, minlength=len(every)), np.bincount(at, weights=label, minlength=len(every)), len(y), int(y.sum()))]
    share = c / c.sum()
    pairs = [p for k, s in zip(keep, share, strict=True) if rows[k][2] for p in _weighted(names, s, rows[k][2])]
    return descend(names, [_numbers(names, rows[k][1]) for k in keep], pairs, y, c, **{**SETTINGS, **settings})


TWINS = "array<struct<gained:array<bigint>,lost:array<bigint>>>"
_PAIR = pa.struct([("gained", pa.list_(pa.int64())), ("lost", pa.list_(pa.int64()))])


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _describe(batches):
    """(text, key, y, c) to (key, y, c, low, features, twins)."""
    for batch in batches:
        data, off = text_arrays(batch.column(0))
        for i, (low, features, pairs) in enumerate(described(data, off)):
            columns = [batch.column(k).slice(i, 1) for k in (1, 2, 3)]
            columns += [pa.array([_signed(list(low))]), pa.array([features.view(np.int64)], pa.list_(pa.int64()))]
            columns.append(pa.array([[{"gained": _signed(g), "lost": _signed(x)} for g, x in pairs]], pa.list_(_PAIR)))
            yield pa.RecordBatch.from_arrays(columns, ["key", "y", "c", "low", "features", "twins"])


def _count(keep):
    """(key, y, features) to (f, n, n1): how many texts, and toxic ones, have a feature."""

    def code(batches):
        kept, held, size = keep.value, ([], []), 0

        def flush():
            f, at = np.unique(np.concatenate([np.zeros(0, np.int64), *held[0]]), return_inverse=True)
            n1 = np.bincount(at, weights=np.concatenate([np.zeros(0), *held[1]]), minlength=len(f)).astype(np.int64)
            n = np.bincount(at, minlength=len(f))
            for a in range(0, len(f), 1 << 17):
                part = slice(a, a + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(f[part]), pa.array(n[part]), pa.array(n1[part])], ["f", "n", "n1"])
            held[0].clear()
            held[1].clear()

        for batch in batches:
            for key, y, features in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (key, y) in kept:
                    held[0].append(features.values.to_numpy())
                    held[1].append(np.full(len(held[0][-1]), float(y)))
                    size += len(held[0][-1])
                    if size >= FLUSH:
                        yield from flush()
                        size = 0
        yield from flush()

    return code


def _numbered(shared):
    """Rows of kept texts with feature numbers instead of features."""

    def code(batches):
        names, kept = shared.value
        for batch in batches:
            for key, y, c, features, pairs in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), batch.column(4).to_pylist(), strict=True):
                if (key, y) not in kept:
                    continue
                mine = _numbers(names, features.values.to_numpy().view(np.uint64))
                some = _weighted(names, c, [(np.array(p["gained"], np.int64).view(np.uint64), np.array(p["lost"], np.int64).view(np.uint64)) for p in pairs])
                out = [{"share": s, "gained": g, "lost": x} for s, g, x in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key]), pa.array([y], pa.int32()), pa.array([c]), pa.array([mine], pa.list_(pa.int64())), pa.array([out], pa.list_(pa.struct([("share", pa.float64()), *_PAIR])))],
                    ["key", "y", "c", "features", "twins"],
                )

    return code


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, **settings) -> ToxicityModel:
    """Trains on docs (doc_id, text) that labels (doc_id, toxic) marks; at most about ``max_rows`` doc_ids of each class."""
    spark = docs.sparkSession
    marks = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y"))
    counts = {r["_y"]: r["n"] for r in marks.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    draw = F.xxhash64(F.lit(23), "doc_id").bitwiseAND((1 << 30) - 1) / float(1 << 30)
    share = F.when(F.col("_y") == 1, min(1.0, max_rows / counts.get(1, 1))).otherwise(min(1.0, max_rows / counts.get(0, 1)))
    drawn = marks.where(draw < share).withColumn("_c", 1 / share)  # of about max_rows ids of each class, whatever the table's size
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(plain(F.col("text")).alias("text"), F.xxhash64("text").alias("key"), "_y", F.col("_c").cast("double").alias("c"))
    rows = rows.dropDuplicates(["key", "_y"])
    known = written(spark, rows.mapInArrow(_describe, f"key long, y int, c double, low array<bigint>, features array<bigint>, twins {TWINS}"), "toxicity-features")
    each = sorted((tuple(r.low), r.y, r.key) for r in known.select("low", "y", "key").collect())
    keep = no_near_copies([e[0] for e in each])  # else the labels of one group of copies would teach its own words
    kept = {(each[k][2], each[k][1]) for k in keep}
    if not kept:
        return NOTHING
    n, n1 = len(kept), sum(y for _, y in kept)
    tally = known.select("key", "y", "features").mapInArrow(_count(spark.sparkContext.broadcast(kept)), "f long, n long, n1 long")
    tally = tally.groupBy("f").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    mean, rate = F.col("n") * (n1 / n), n1 / n
    far = (F.col("n") >= 3) & (F.pow(F.col("n1") - mean, 2) > 9 * mean * (1 - rate) * (1 - F.col("n") / n) + 1)  # as ``chosen``
    names = np.sort(tally.where(far).select("f").toArrow()["f"].to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast((names, kept))
    schema = "key long, y int, c double, features array<bigint>, twins array<struct<share:double,gained:array<bigint>,lost:array<bigint>>>"
    got = sorted(known.select("key", "y", "c", "features", "twins").mapInArrow(_numbered(shared), schema).collect(), key=lambda r: (r.key, r.y))
    y, c = np.array([r.y for r in got], dtype=float), np.array([r.c for r in got])
    pairs = [(t.share / c.sum(), t.gained, t.lost) for r in got for t in r.twins]
    return descend(names, [np.array(r.features, dtype=np.int64) for r in got], pairs, y, c, **{**SETTINGS, **settings})


def score(model: ToxicityModel, text: Column | str, spark) -> Column:
    """Probability that a text is toxic."""
    shared = spark.sparkContext.broadcast(model)

    def code(col: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-shared.value.log_odds(*text_arrays(col)))))

    return F.arrow_udf(code, "double")(plain(F.col(text) if isinstance(text, str) else text))

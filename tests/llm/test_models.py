"""Models: toxicity, language, n-grams."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchflow.llm import langid, lm_bloom, toxicity

from .helpers import empty_documents, odd_documents, odd_texts, words


def test_counterfactual_training_frees_neutral_mentions():
    rng = random.Random(1)
    fill = lambda: words(rng, 12)
    texts, labels = [], []
    for _ in range(200):  # the group term goes with insults in the sample
        texts += [f"{fill()} muslim idiot {fill()}", f"{fill()} christian {fill()}", fill()]
        labels += [1, 0, 0]
    plain = toxicity.train(texts, labels, [1.0] * len(texts), pairing=0.0)
    fair = toxicity.train(texts, labels, [1.0] * len(texts), pairing=20.0)
    gap = lambda m: m.score("the muslim reads") - m.score("the christian reads")
    assert gap(fair) < 0.1 < gap(plain)
    assert fair.score("what an idiot") > 0.3 > fair.score("the muslim reads")


def test_toxicity_on_odd_documents(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, 0), (None, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    out = docs.select(toxicity.score(model, "text", spark).alias("s")).collect()
    assert len(out) == len(odd_texts()) and all(0 <= r.s <= 1 for r in out)
    none = toxicity.fit(empty_documents(spark), labels.limit(0))
    assert none.score("anything") == pytest.approx(0.01)


def test_toxic_word_beginnings_in_every_language(spark):
    """Recall of held-out label-1 rows at 0.3 by language, and false positives; the fit in Spark equals the one in memory."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.fit(docs.where(~held), labels)
    scored = docs.where(held).join(labels, "doc_id").select("lang", "toxic", (toxicity.score(model, "text", spark) >= 0.3).alias("p"))
    got = {(r.lang, r.toxic): (r.n, r.k) for r in scored.groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.sum(F.col("p").cast("int")).alias("k")).collect()}
    assert got["en", 1][1] >= 0.88 * got["en", 1][0]
    assert all(got[lang, 1][1] >= 0.8 * got[lang, 1][0] for lang in ("de", "fr", "es"))
    assert sum(k for (_, y), (_, k) in got.items() if y == 0) < 0.01 * sum(n for (_, y), (n, _) in got.items() if y == 0)


def test_fit_is_train(spark):
    rng = random.Random(6)
    rows = [(i, f"{words(rng, 30)} {'christian' if i % 3 else 'woman'} {' '.join(f'rotne{words(rng, 1)}' for _ in range(3)) if i % 4 == 0 else ''} {words(rng, 30)}", int(i % 4 == 0)) for i in range(400)]
    rows += rows[:50]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = toxicity.fit(docs, spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, quality int, toxic int"))
    want = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows], [1.0] * len(rows))
    for _, t, _ in rows[:60]:
        assert got.score(t) == pytest.approx(want.score(t), abs=0.02)
    assert got.score("a rotnelloq and a rotnevixa, rotneon") > 0.3 > got.score("the christian woman reads")


def test_code_lengths_are_exact():
    """Against a slow walk down the contexts of plain counts."""
    rng = random.Random(3)
    texts = {"aa": [words(rng, 40).encode()], "bb": [b"zzyzx qqq " * 30, "ñandú".encode() * 9]}
    trees = langid.ContextTrees(texts, least=1)
    count: dict = {k: Counter() for k in texts}
    for lang, parts in texts.items():
        for t in parts:
            p = b"\n\n\n" + t
            for i in range(3, len(p)):
                for order in range(4):
                    count[lang][p[i - order : i], p[i]] += 1
    contexts = {c for lang in count for c, _ in count[lang]}

    def prob(lang, ctx, sym):
        lower = 1 / 256 if not ctx else prob(lang, ctx[1:], sym)
        if ctx and ctx not in contexts:
            return lower
        row = {s: n for (c, s), n in count[lang].items() if c == ctx}
        t, d = sum(row.values()), len(row)
        return lower if not t else (row[sym] if sym in row else d * lower) / (t + d)

    sample = [b"", b"zzyzx", "ñoño qq".encode(), texts["aa"][0][:60]]
    import pyarrow as pa

    from pitchflow.llm.common import text_arrays

    got = trees.code_lengths(*text_arrays(pa.array(sample, pa.binary())))
    for i, s in enumerate(sample):
        p = b"\n\n\n" + s
        for k, lang in enumerate(trees.langs):
            want = -sum(np.log2(prob(lang, p[j - 3 : j], p[j])) for j in range(3, len(p)))
            assert got[i, k] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_language_of_odd_documents(spark):
    docs = odd_documents(spark)
    trees = langid.fit(docs.select("lang", "text"))
    out = docs.select("h", langid.predict(trees, F.col("text"), spark).alias("p")).collect()
    texts = odd_texts()
    for r in out:
        assert (r.p.lang_pred == "und") == (not any(map(str.isalpha, texts[r.h] or ""))) and 0 <= r.p.score <= 1
    nothing = langid.fit(empty_documents(spark).select("lang", "text"))
    assert {r.p.lang_pred for r in docs.select(langid.predict(nothing, F.col("text"), spark).alias("p")).collect()} == {"und"}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    trees = langid.fit(docs.where(~held).select("lang", "text"))
    out = docs.where(held).select("lang", langid.predict(trees, F.col("text"), spark).alias("p"))
    assert out.select(F.avg((F.col("lang") == F.col("p.lang_pred")).cast("double"))).first()[0] > 0.98


def test_counts_by_spark_equal_those_in_memory(spark):
    """Whole texts teach, long ones too; trees are those of all texts at once; a model too large to broadcast is refused."""
    rng = random.Random(15)
    texts = {"aa": [words(rng, 300) for _ in range(9)], "bb": [words(rng, 30_000) + " qqqzzz ñandú"], "cc": ["x"]}
    rows = spark.createDataFrame([(k, t) for k, v in texts.items() for t in v for _ in range(2)], "lang string, text string").repartition(5)
    for most in (12_000, 50):
        got, want = langid.fit(rows, max_nodes=most), langid.ContextTrees({k: [t.encode() for t in v] for k, v in texts.items()}, max_nodes=most)
        assert got.langs == want.langs
        for a, b in zip(got.trees, want.trees, strict=True):
            assert all(np.array_equal(x, y) for x, y in zip(a.parts, b.parts, strict=True))
    before, langid.MOST_BYTES = langid.MOST_BYTES, 1000
    try:
        with pytest.raises(ValueError, match="over 0"):
            langid.fit(rows)
    finally:
        langid.MOST_BYTES = before


def test_filter_counts():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 3000).astype(np.uint64)
    n = np.minimum(rng.zipf(1.4, 3000), 10**6)
    cells = np.zeros((2, 1 << (lm_bloom.CELL_BITS - 3)), dtype=np.uint8)
    for x, m in zip(h, n, strict=True):
        at = int(lm_bloom.cell_of(lm_bloom.WORD, np.array([x]), 2)[0])
        key = lm_bloom.filter_key(lm_bloom.WORD, np.array([x]))
        for level in range(1, int(lm_bloom.level_of(np.array([m]))[0]) + 1):
            for bit in (int(b[0]) for b in lm_bloom._bits(key, level)):
                cells[at, bit >> 3] |= 1 << (bit & 7)
    got = lm_bloom.counts(cells, lm_bloom.WORD, h)
    assert np.all(got >= lm_bloom.MEAN_COUNT[lm_bloom.level_of(n)])
    assert np.mean(got == lm_bloom.MEAN_COUNT[lm_bloom.level_of(n)]) > 0.97
    other = lm_bloom.counts(cells, lm_bloom.WORD, rng.integers(0, 2**63, 3000).astype(np.uint64))
    assert np.mean(other > 0) < 0.02


def test_lm_on_odd_documents(spark):
    docs = odd_documents(spark)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    ids = {r.h: r.doc_id for r in docs.collect()}
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = {k: [*(t or "").encode().translate(lower).split(), None] for k, t in enumerate(odd_texts())}
    count = Counter(w for k, t in tokens.items() if not held(ids[k]) for w in t)
    n, v = sum(count.values()), len(count)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7
    out = lm_bloom.score(spark, docs.select("doc_id", "text", (fold != 2).alias("train"))).collect()
    key = lambda i, size, base: (i is None, i or 0, size, round(base, 6))
    want = sorted(key(ids[k], len(t), sum(np.log10((count[w] + 1) / (n + v + 1)) for w in t)) for k, t in tokens.items())
    assert sorted(key(r.doc_id, r.n_tokens, r.base_score) for r in out) == want
    assert all(r.train_tokens == n and r.score < 0 for r in out)
    assert lm_bloom.score(spark, empty_documents(spark).select("doc_id", "text", F.lit(True).alias("train"))).count() == 0
    alone = lm_bloom.score(spark, docs.select("doc_id", "text", F.lit(False).alias("train"))).collect()
    assert len(alone) == len(tokens) and all(r.n_known == 0 for r in alone)


def test_filter_bits_grow_with_items(spark):
    """Whatever the number of items, there are ten bits for each; pairs of one frequent word fill no cell more than others."""
    few, many = (spark.createDataFrame([(lm_bloom.WORD, 1, 1)], "kind int, h long, n long").join(spark.range(k), how="cross") for k in (1, 2_000_000))
    assert lm_bloom.filter_size(few) == 1
    assert lm_bloom.filter_size(many.union(many)) * (1 << lm_bloom.CELL_BITS) >= 4_000_000 * lm_bloom.BITS_PER_ITEM
    big = spark.range(1).select(F.lit(1).alias("n")).join(spark.range(1000), how="cross").select((F.lit(1.5) ** 60).cast("long").alias("n")).join(spark.range(3000), how="cross")
    assert lm_bloom.filter_size(big) * (1 << lm_bloom.CELL_BITS) > 1 << 30
    rng = np.random.default_rng(2)
    the = (rng.integers(0, 2**32, 400_000).astype(np.uint64) << np.uint64(32)) | np.uint64(12345)
    assert np.bincount(lm_bloom.cell_of(lm_bloom.PAIR, the, 20_000), minlength=20_000).max() < 60


def test_sharded_filter_equals_whole(spark):
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 40_000).astype(np.uint64)
    kind = np.repeat([lm_bloom.WORD, lm_bloom.PAIR], 20_000)
    n = np.minimum(rng.zipf(1.5, 40_000), 10**6)
    rows = spark.createDataFrame([(int(k), int(x), int(m)) for k, x, m in zip(kind, h, n, strict=True)], "kind tinyint, h long, n long")
    cells = 7
    table = lm_bloom.build_filter(spark, rows, cells).collect()
    whole = np.zeros((cells, 1 << (lm_bloom.CELL_BITS - 3)), dtype=np.uint8)
    for r in table:
        whole[r.cell] = np.frombuffer(r.bits, dtype=np.uint8)
    word, pair = np.unique(h[:25_000]), np.unique(h[10_000:])
    for per in (1, 3):
        routes = lm_bloom.Routes(word, pair, cells, per)
        asked = routes.rows(5).to_pylist()
        rows = [(r.cell // per, -1, r.cell, None, bytes(r.bits)) for r in table] + [(r["shard"], 5, -1, r["sizes"], r["keys"]) for r in asked]
        held = spark.createDataFrame(rows, "shard int, block int, cell int, sizes binary, keys binary").coalesce(1).sortWithinPartitions("shard", "block")
        got = held.mapInArrow(lm_bloom._answers(per), "block int, shard int, levels binary").collect()
        found = routes.counts(np.array([r.shard for r in got]), [bytes(r.levels) for r in got])
        for x, (k, keys) in zip(found, ((lm_bloom.WORD, word), (lm_bloom.PAIR, pair)), strict=True):
            assert np.array_equal(x, lm_bloom.counts(whole, k, keys))


def test_pairs_seen_once_are_known(spark):
    """A text whose pairs were each seen once in training scores above the same words in another order."""
    rng = random.Random(9)
    vocabulary = words(rng, 400, 4).split()
    text = [rng.choice(vocabulary) for _ in range(300)]
    other = rng.sample(text, len(text))
    docs = spark.createDataFrame([(1, " ".join(text), True), (2, " ".join(text), False), (3, " ".join(other), False)], "doc_id long, text string, train boolean")
    grams = lm_bloom.count_grams(spark, docs.where("train"))
    pairs = set(zip([None, *text], [*text, None], strict=True))
    assert grams.where(F.col("kind") == lm_bloom.PAIR).count() == len(pairs)
    got = {r.doc_id: r.score for r in lm_bloom.score(spark, docs).collect()}
    assert got[2] > got[3] + 30


def test_score_against_brute_force(spark):
    """With quantised counts of words and pairs; a false positive of the filter moves few scores."""
    rng = random.Random(21)
    vocabulary = words(rng, 300, 4).split()
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(300)], k=rng.randrange(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, i % 5 != 0) for i, t in enumerate(texts)], "doc_id long, text string, train boolean")
    rows = [[*t.split(), None] for t in texts]
    one, two = Counter(), Counter()
    for i, t in enumerate(rows):
        if i % 5:
            one.update(t)
            two.update(zip([None, *t], t, strict=False))
    n, v = sum(one.values()), len(one)
    rounded = lambda c: float(lm_bloom.MEAN_COUNT[lm_bloom.level_of(np.array([c]))[0]]) if c else 0.0

    def score(t):
        out = 0.0
        for a, b in zip([None, *t], t, strict=False):
            p1 = min((rounded(one[b]) + 1) / (n + v + 1), 1.0)
            own = min(rounded(two[a, b]), rounded(one[a])) / rounded(one[a]) if one[a] else p1
            out += np.log10((1 - lm_bloom.MU) * p1 + lm_bloom.MU * own)
        return out

    got = {r.doc_id: r.score for r in lm_bloom.score(spark, docs).collect()}
    off = [abs(got[i] - score(t)) > 1e-6 for i, t in enumerate(rows)]
    assert sum(off) < 90 and sum(abs(got[i] - score(t)) for i, t in enumerate(rows)) < 0.02 * sum(abs(score(t)) for t in rows)


def test_every_language_is_learned(spark):
    """Also rare ones among many, ones of copies, and ones of long texts only."""
    rng = random.Random(12)
    rows = [(f"l{i:03}", words(rng, 5)) for i in range(300) for _ in range(2)] + [("rare", words(rng, 5)), ("long", words(rng, 20_000))]
    rows += [("copies", t) for t in (words(rng, 8) for _ in range(20)) for _ in range(500)] + [("many", words(rng, 3)) for _ in range(400)]
    got = Counter(r.lang for r in langid.training_sample(spark.createDataFrame(rows, "lang string, text string"), per_lang=50).collect())
    assert len(got) == 304 and got["copies"] == 20 and got["many"] == 50
    assert {n for k, n in got.items() if k.startswith("l0")} == {2} and got["rare"] == got["long"] == 1


def test_answers_have_exact_counts(spark):
    """The shard that tells a block's levels also tells the exact counts of its words; unknown words have none."""
    h = np.random.default_rng(5).integers(0, 2**64, 9000, dtype=np.uint64)
    n = np.arange(9000) % 50 + 1
    kind = np.repeat([lm_bloom.WORD, lm_bloom.PAIR], [6000, 3000])
    rows = spark.createDataFrame([(int(k), int(x), int(m)) for k, x, m in zip(kind, h.view(np.int64), n, strict=True)], "kind tinyint, h long, n long")
    table = lm_bloom.build_filter(spark, rows, 5).collect()
    word, pair = np.unique(h[3000:7000]), np.unique(h[6000:])
    routes = lm_bloom.Routes(word, pair, 5, 2)
    asked = [(r["shard"], 5, -1, r["sizes"], r["keys"]) for r in routes.rows(5).to_pylist()]
    held = spark.createDataFrame([(r.cell // 2, -1, r.cell, bytes(r.words), bytes(r.bits)) for r in table] + asked, "shard int, block int, cell int, sizes binary, keys binary")
    got = held.coalesce(1).sortWithinPartitions("shard", "block").mapInArrow(lm_bloom._answers(2), "block int, shard int, levels binary").collect()
    count = dict(zip(h[:6000].tolist(), n[:6000].tolist(), strict=True))
    assert routes.exact(np.array([r.shard for r in got]), [bytes(r.levels) for r in got]).tolist() == [count.get(x, 0) for x in word.tolist()]

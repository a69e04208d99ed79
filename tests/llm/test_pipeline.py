"""run() against a brute-force version of its stages."""

import random
import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from pitchflow.llm import decontam, near_copies, toxicity

from .helpers import empty_documents, odd_documents, words
from .test_filters import plain_spans

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def near_groups(texts):
    """A number for each text: equal for those linked by similarities of 0.8 or more."""
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if label[i] != label[j] and (n >= 0.8 * (len(a) + len(sets[j]) - n)):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_near_copies_of_large_groups(spark):
    """Hundreds of edited copies of one text, and chains, against all pairs."""
    rng = random.Random(31)
    base = words(rng, 120).split()

    def edited(ws, k):
        out = list(ws)
        for _ in range(k):
            out[rng.randrange(len(out))] = words(rng, 1)
        return out

    texts = [" ".join(edited(base, rng.choice([0, 1, 1, 2]))) for _ in range(150)]
    chain = words(rng, 100).split()
    for _ in range(8):
        chain = edited(chain, 1)
        texts.append(" ".join(chain))
    texts += [words(rng, 80) for _ in range(40)] + [None, "", " \n", "one two", "One TWO", "one two three"]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "_pf_row long, text string").repartition(3)
    gone = {r.row for r in near_copies.surplus(spark, docs, "_pf_row").collect()}
    labels = near_groups(texts)
    left = [labels[i] for i in range(len(texts)) if i not in gone]
    assert len(left) == len(set(left)) == len(set(labels))


def test_stages_on_test_data(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    base = {r.doc_id: r.text for r in docs.collect()}
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(corpus_pipeline.written(spark, stage(spark, steps[-1], SF), f"test-{name}"))
        if name != "mixing":
            assert steps[-1].columns == columns
    kept = [sorted(r.doc_id for r in s.collect()) for s in steps]
    model = toxicity.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2), spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept[1] == sorted(i for i, t in base.items() if model.score(t or "") < 0.3)
    labels = near_groups([base[i] for i in kept[1]])
    assert len(kept[2]) == len(set(labels)) and len({labels[kept[1].index(i)] for i in kept[2]}) == len(kept[2])
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(item in base[i] for i in kept[3] for item in items)
    assert {i for i in kept[2] if not any(item in base[i] for item in items)} <= set(kept[3])
    cleaned = {r.doc_id: r for r in steps[4].collect()}
    assert sorted(cleaned) == kept[3]
    for i, r in cleaned.items():
        assert not plain_spans(r.text) and r.n_chars == len(r.text) and (r.text == base[i] or plain_spans(base[i]))
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in cleaned.values())
    taken = steps[5].agg(F.sum("n_tokens")).first()[0]
    assert total // 2 <= taken <= total // 2 + 80 * max(r.n_tokens for r in steps[5].collect())
    assert set(kept[5]) <= set(kept[4])


def test_odd_documents(spark, tmp_path):
    odd_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_empty(spark, tmp_path):
    empty_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert decontam and np


def _left(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "_pf_row long, text string").repartition(3)
    gone = {r.row for r in near_copies.surplus(spark, docs, "_pf_row").collect()}
    return [i for i in range(len(texts)) if i not in gone]


def test_pairs_that_bands_and_signatures_miss(spark):
    """2,500 pairs of 4 and 5 shingles, 4 of them shared: a similarity of exactly 0.8, which sketches estimate too low now and then."""
    rng = random.Random(41)
    texts = [t for t in (words(rng, 9) for _ in range(2500)) for t in (t, t.rsplit(" ", 1)[0])]
    assert _left(spark, texts) == list(range(0, 5000, 2))


def test_partners_beyond_the_leaders_of_a_large_group(spark):
    """Families around similarities of 0.8, whose members often have no leader near, against all pairs."""
    rng = random.Random(43)
    texts = []
    for _ in range(3):
        base = words(rng, 90).split()
        for _ in range(150):
            own = list(base)
            for at in rng.sample(range(90), rng.choice([1, 1, 2, 2, 3])):
                own[at] = words(rng, 1)
            texts.append(" ".join(own))
    labels = near_groups(texts)
    left = [labels[i] for i in _left(spark, texts)]
    assert len(left) == len(set(left)) == len(set(labels)) > 3


def test_all_links_without_sketches(spark, monkeypatch):
    """The exact join alone finds every pair, also where a shingle's texts are dealt out by blocks and hash bits are few."""
    rng = random.Random(47)
    passage = words(rng, 60)
    texts = [f"{passage} {words(rng, rng.choice([5, 9, 14, 20]))}" for _ in range(120)] + ["", " ", "a b", "A b", "a b c d e f g h i", "a b c d e f g h"]
    sets = [shingle_set(t) for t in texts]
    want = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if len(a & b) >= 0.8 * len(a | b)}
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "node long, root long, t string").repartition(3)
    for most, common in ((2048, (16, 256, 4096)), (7, (2, 50))):
        monkeypatch.setattr(near_copies, "MOST", most)
        monkeypatch.setattr(near_copies, "COMMON", common)
        got = near_copies.others(spark, docs, 0.8).collect()
        assert len(got) == len(want) > 50 and {(r.a, r.b) for r in got} == want

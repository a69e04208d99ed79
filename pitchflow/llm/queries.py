"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fm_index, langid, lm_bloom, media, mixing, prefix_trie, secret_scan, simhash, suffix_sort, topk, toxicity, whitening
from .common import bounded_batches, fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled rows of the folds but 2. Null texts count as empty; the rest as in ``toxicity``."""
    docs = documents(spark, sf_dir).select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out"))
    model = toxicity.fit(docs.where("NOT held_out"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", "held_out", toxicity.score(model, "text", spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of benchmark items found in it, the best one, its coverage, whether values were changed, and how many items it stands for. Null texts hold none; the rest as in ``decontam``."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontam.contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "best_item", "coverage", "reparameterised", "members")


#: Target weights of the mixing query, for each level of the tree.
WEIGHTS = {"domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, "lang": {"en": 2.0, "de": 1.5, "fr": 1.0, "es": 1.0}, "source": {}}


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the tokens by domain, language and source. Null texts have none; the rest as in ``mixing``."""
    return mixing.mix(spark, documents(spark, sf_dir), WEIGHTS)


ORACLES["op4_mixing"] = mixing.mix_sql(WEIGHTS)


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds but 2; ``und`` without a letter. The rest as in ``langid``."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (fold("doc_id", 4) == 2).alias("held_out"))
    trees = langid.fit(docs.where("NOT held_out").select("lang", "text"))
    out = docs.select("doc_id", "held_out", langid.predict(trees, F.col("text"), spark).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


@query
def op6_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row; null texts have fingerprint zero, repeated rows stay. The rest as in ``simhash``."""
    found = simhash.near_duplicates(spark, documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a GIF, read back through its colours; null counts as empty. The rest as in ``media``."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stored = media.with_gif(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), media.digest("media").alias("d"))
    return stored.select("doc_id", "n_bytes", "d.*").drop("error")


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of secrets of every document; null texts have none. The rest as in ``secret_scan``."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    model = secret_scan.train(secret_scan.sample_values(docs))
    found = secret_scan.scan(docs, model)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in secret_scan.KINDS[:3]), F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


@query
def op2_lm_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document, learned from the folds but 2 of 7; null counts as empty. The rest as in ``lm_bloom``."""
    docs = documents(spark, sf_dir).select("doc_id", "text", (fold("doc_id", 7) != 2).alias("train"))
    scored = lm_bloom.score(spark, docs)
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op8_fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document outside windows of 35 that repeat; null texts have none. The rest as in ``fm_index``."""
    out = fm_index.removed(spark, documents(spark, sf_dir).select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "r.n_words", "r.n_removed", "r.kept_sha256")


ORACLES["op8_fm_substring_dedup"] = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, i, array_to_string(w[i : i + 34], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM t WHERE len(w) >= 35) q),
r AS (SELECT rid, i FROM p WHERE s IN (SELECT s FROM p GROUP BY s HAVING count(*) > 1)),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS j FROM r),
k AS (SELECT rid, w[j] AS x, j FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS j FROM t) q ANTI JOIN c USING (rid, j)),
s AS (SELECT rid, string_agg(x, ' ' ORDER BY j) AS kept, count(*) AS n FROM k GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN s USING (rid)
"""


@query
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document outside strings of 400 that repeat; null counts as empty. The rest as in ``suffix_sort``."""
    out = suffix_sort.removed(spark, documents(spark, sf_dir).select("doc_id", "text"), with_bytes=False)
    return out.select("doc_id", "r.n_bytes", "r.n_removed", "r.n_spans", "r.kept_sha256")


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations. Rows without conv_id are passed over; the rest as in ``prefix_trie``."""
    bounded_batches(spark)
    return prefix_trie.trie(spark, *prefix_trie.rebuilt(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLES["op11_prefix_trie"] = """
WITH RECURSIVE bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s0 AS (SELECT conv_id AS c, conv_id - conv_id % 5 AS b, count(*) AS n FROM t GROUP BY 1, 2),
s1 AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(crc.t[(xor(a, x) % 256) + 1], a >> 8)), 4294967295) % 9 AS h FROM s0, crc),
s AS (SELECT x.c, x.b, x.h, least(x.h, coalesce(y.n, 0)) AS taken FROM s1 x LEFT JOIN s0 y ON y.c = x.b),
r AS (SELECT s.c, t.p + 1 AS d, role, text FROM s JOIN t ON t.conv_id = s.b AND t.p < s.taken UNION ALL SELECT s.c, t.p - s.h + s.taken + 1, role, text FROM s JOIN t ON t.conv_id = s.c AND t.p >= s.h),
k(c, d, key, up, size) AS (SELECT c, 0::BIGINT, '', NULL::VARCHAR, 0::BIGINT FROM s UNION ALL
  SELECT r.c, r.d::BIGINT, md5(concat(k.key, ':', md5(role), md5(text))), k.key, octet_length(encode(text))::BIGINT FROM k JOIN r ON r.c = k.c AND r.d = k.d + 1),
n AS (SELECT key, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n, any_value(up) AS up, any_value(size) AS size FROM k GROUP BY key),
ch AS (SELECT up AS key, count(*) AS children FROM n WHERE up IS NOT NULL GROUP BY 1),
own AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN ch USING (key)),
sub AS (SELECT k.key, count(*) FILTER (WHERE w.children = 0) AS leaves, sum((w.n - 1) * w.size) AS saved FROM own w JOIN k ON k.c = w.conv_id AND k.d <= w.depth GROUP BY k.key),
e AS (SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM k SEMI JOIN (SELECT c, max(d) AS d FROM k GROUP BY c) m USING (c, d) GROUP BY key)
SELECT own.conv_id, own.depth, up.conv_id AS parent_conv_id, own.n AS n_convs, CAST(own.children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN sub USING (key) LEFT JOIN n up ON up.key = own.up LEFT JOIN e ON e.key = own.key
"""


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector along the 32 leading components. Unusable vectors are dropped; the rest as in ``whitening``."""
    bounded_batches(spark)
    return whitening.whiten(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of highest inner product for every vec_id divisible by 20. Unusable vectors take no part; the rest as in ``topk``."""
    bounded_batches(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top(spark, vectors, F.col("vec_id") % 20 == 0, 20)


ORACLES["op13_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x, row_number() OVER () AS row FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.x, r.x), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v r ON q.vec_id % 20 = 0 AND q.row <> r.row)
SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) <= 20
"""

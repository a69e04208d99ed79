"""The corpus pipeline: five stages from ``documents`` to a mixed training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is written and read again as the
next stage's docs. All but the last return the columns of documents (and any more that docs has).

Cases: a stage keeps rows whose other columns are null; a null text has no toxic word, no item and no
secret, and is one near-duplicate group with the other empty texts; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchflow.llm import decontam, mixing, near_copies, secret_scan, toxicity
from pitchflow.llm.common import bounded_batches, fold, written
from pitchflow.llm.queries import WEIGHTS

ORACLE_SQL = None  # no stage but the last can be said in SQL; tests/llm compares run() with a brute-force version


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.3; the model learns from the folds that op1 learns from."""
    bounded_batches(spark)
    model = toxicity.fit(docs.where(fold("doc_id", 4) != 2), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(model, "text", spark) < 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near copies: sets of five-word shingles of a similarity of 0.8 or more."""
    bounded_batches(spark)
    rows = written(spark, docs.withColumn("_pf_row", F.monotonically_increasing_id()), "numbered")
    gone = near_copies.surplus(spark, rows, "_pf_row").select(F.col("row").alias("_pf_row"))
    return rows.join(gone, "_pf_row", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    bounded_batches(spark)
    found = decontam.find(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.select(F.col("k1").alias("_pf_k1"), F.col("k2").alias("_pf_k2")).distinct()
    k1, k2 = decontam.text_key(F.col("text"))
    return docs.withColumns({"_pf_k1": k1, "_pf_k2": k2}).join(gone, ["_pf_k1", "_pf_k2"], "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars follows the text."""
    model = secret_scan.train(secret_scan.sample_values(docs))
    found = secret_scan.scan(docs, model, base="_pf_base", spans="_pf_spans")
    hit = F.size("_pf_spans") > 0
    found = found.withColumn("_pf_text", secret_scan.redacted(F.col("text"), F.col("_pf_spans")))
    columns = {"text": F.col("_pf_text"), "n_chars": F.when(hit, F.length("_pf_text").cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*(columns.get(c, F.col(c)).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, dealt to domains, languages and sources by weight."""
    return mixing.mix(spark, docs, WEIGHTS, extra=("text",))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

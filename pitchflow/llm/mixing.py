"""Mixing sources to target weights, with built-in functions only.

Leaves of the tree are (domain, lang, source). A budget of tokens goes down the tree: each node shares
its tokens among its children by their weights, none above what its leaves can give (their tokens times
``epochs``), and what a child can't take goes to its siblings; only what a whole subtree can't take
reaches the level above. So shares are settled level by level from the root, each by water-filling:
min(capacity, level * weight), where the level follows from the children in order of capacity / weight.

A leaf takes whole epochs, then a prefix of the next epoch's order up to its tokens left: documents are
taken while the tokens before them are below the leaf's share. Each epoch's order is by the md5 of seed,
epoch and doc_id. Running sums over a leaf are split by parts of the hash range, as many as the leaf's
size asks for, so that a hot leaf is no single task.

Cases: null text has no tokens and is never taken in part (it goes with whole epochs); null source, lang or id count as
''; a child that the weights don't name has weight 1; ties in md5 go by doc_id; repeated rows count each time; a
``domain`` column of docs isn't read, as domains follow from sources; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

LEVELS = ("domain", "lang", "source")
PART_ROWS = 512
BROADCAST_LEAVES = 100_000  # rows of some 100 bytes


def tokens(text: Column | str) -> Column:
    """Number of words (runs of bytes other than space and \\x09-\\x0D)."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"^[\x20\x09-\x0D]+", "")
    trimmed = F.regexp_replace(trimmed, r"[\x20\x09-\x0D]+$", "")
    return F.when(F.length(trimmed) == 0, 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def domain_of(source: Column) -> Column:
    """The test data's domains: the source's number modulo 4."""
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]+)$", 1).try_cast("long") % 4, F.lit(0)).cast("string"))


def _weighted(df: DataFrame, level: str, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in sorted(weights.items()):
        out = F.when(F.col(level) == name, float(w)).otherwise(out)
    return out


def shares(leaves: DataFrame, budget: Column | float, weights: dict[str, dict[str, float]]) -> DataFrame:
    """Leaf rows (domain, lang, source, leaf_tokens, capacity) with their share of the budget in tokens.

    ``weights`` has, for each level, weights of its names. Works on one row per node, not on documents. Each level joins the shares of
    the one above once, so that the plan has a few nodes a level instead of doubling with it.
    """
    above = None
    for depth, level in enumerate(LEVELS):
        parent, node = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        if above is None:
            children = leaves.withColumn("b", F.lit(budget) if not isinstance(budget, Column) else budget).groupBy(*node).agg(F.sum("capacity").alias("c"), F.max("b").alias("b"))
        else:
            children = leaves.groupBy(*node).agg(F.sum("capacity").alias("c")).join(above.withColumnRenamed("share", "b"), parent)
        children = children.withColumn("w", _weighted(children, level, weights.get(level, {})))
        order = Window.partitionBy(*parent).orderBy(F.col("c") / F.col("w"), level)
        whole = Window.partitionBy(*parent)
        children = children.withColumn("c0", F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        children = children.withColumn("w0", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        # the level if the children before are full; the highest that this child can hold is the first in order to hold its own
        children = children.withColumn("level", (F.col("b") - F.col("c0")) / F.col("w0"))
        children = children.withColumn("water", F.max(F.when(F.col("level") * F.col("w") <= F.col("c"), F.col("level"))).over(whole))
        children = children.withColumn("take", F.when(F.col("water").isNull(), F.col("c")).otherwise(F.least(F.col("c"), F.col("water") * F.col("w"))))
        above = children.select(*node, F.greatest("take", F.lit(0.0)).alias("share"))
    return leaves.drop("share").join(above, list(LEVELS))


def rank_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(spark: SparkSession, docs: DataFrame, weights: dict[str, dict[str, float]], fraction: float = 0.5, epochs: int = 3, seed: int = 7, extra: tuple[str, ...] = ()) -> DataFrame:
    """The mixed set: doc_id, domain, lang, source, epoch, n_tokens, one row for each time a document is taken.

    The budget is ``fraction`` of all tokens of docs; ``extra`` names more columns of docs to keep.
    """
    named = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), domain_of(F.col("source")).alias("domain"), tokens("text").alias("n_tokens"), *extra)
    rows = written(spark, named, "mix-tokens")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("leaf_tokens"), F.count("*").alias("leaf_docs")).withColumn("capacity", F.col("leaf_tokens").cast("double") * epochs)
    leaves = written(spark, leaves, "mix-leaves")
    total, count = leaves.agg(F.coalesce(F.sum("leaf_tokens"), F.lit(0)), F.count("*")).first()
    settled = shares(leaves, float(int(total * fraction)), weights).withColumn("target", F.floor(F.col("share") + 1e-6).cast("long"))
    settled = settled.withColumn("whole", F.when(F.col("leaf_tokens") > 0, F.floor(F.col("target") / F.col("leaf_tokens"))).otherwise(0).cast("int"))
    settled = settled.withColumn("left", F.col("target") - F.col("whole") * F.col("leaf_tokens")).withColumn("parts", F.ceil(F.col("leaf_docs") / PART_ROWS))
    # read three times below: written, the driver plans the tree once, and what follows is a small plan
    plan = written(spark, settled.select(*LEVELS, "whole", "left", "parts"), "mix-shares")
    # so that a hot source isn't dealt to one task; beyond, adaptive execution splits it
    joined = rows.join(F.broadcast(plan) if count <= BROADCAST_LEAVES else plan, list(LEVELS))
    keep = ["doc_id", *LEVELS, "n_tokens", *extra]
    full = joined.where("whole > 0").select(*keep, F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"))
    last = joined.where("left > 0").withColumn("_key", rank_key(seed, F.col("whole"), F.col("doc_id")))
    last = last.withColumn("_part", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / float(1 << 32) * F.col("parts")).cast("int"))
    sums = last.groupBy(*LEVELS, "_part").agg(F.sum("n_tokens").alias("_sum"))
    by_leaf = Window.partitionBy(*LEVELS).orderBy("_part")
    # a leaf has one row per PART_ROWS documents here
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(by_leaf.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    last = last.join(sums, [*LEVELS, "_part"]).where(F.col("_before") < F.col("left"))
    within = Window.partitionBy(*LEVELS, "_part").orderBy("_key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_at", F.col("_before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return full.unionByName(last.where((F.col("_at") < F.col("left")) & (F.col("n_tokens") > 0)).select(*keep, F.col("whole").alias("epoch")))


def mix_sql(weights: dict[str, dict[str, float]], fraction: float = 0.5, epochs: int = 3, seed: int = 7) -> str:
    """The same in DuckDB's SQL over documents, as an oracle."""
    parts = [
        "d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, 'd' || coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), '') AS BIGINT) % 4, 0) AS domain, "
        "CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents)",
        f"leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS leaf_tokens, CAST(sum(n_tokens) AS DOUBLE) * {epochs} AS capacity FROM d GROUP BY 1, 2, 3)",
        f"take AS (SELECT floor(coalesce(sum(leaf_tokens), 0) * {fraction}) AS b FROM leaf)",
    ]
    before = "take"
    for depth, level in enumerate(LEVELS):
        parent, node = list(LEVELS[:depth]), ", ".join(LEVELS[: depth + 1])
        w = "CASE " + "".join(f"WHEN {level} = '{k}' THEN {v:.6f}e0 " for k, v in sorted(weights.get(level, {}).items())) + "WHEN true THEN 1e0 END"
        by = f"PARTITION BY {', '.join(parent)} " if parent else ""
        join = f"JOIN {before} USING ({', '.join(parent)})" if parent else f"CROSS JOIN {before}"
        parts += [
            f"c{depth} AS (SELECT c.*, {w} AS w, b FROM (SELECT {node}, sum(capacity) AS c FROM leaf GROUP BY {node}) c {join})",
            f"o{depth} AS (SELECT *, coalesce(sum(c) OVER ({by}ORDER BY c / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0, sum(w) OVER ({by}ORDER BY c / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w0 FROM c{depth})",
            f"l{depth} AS (SELECT *, max(CASE WHEN (b - c0) / w0 * w <= c THEN (b - c0) / w0 END) OVER ({by}) AS water FROM o{depth})",
            f"t{depth} AS (SELECT {node}, greatest(CASE WHEN water IS NULL THEN c ELSE least(c, water * w) END, 0) AS b FROM l{depth})",
        ]
        before = f"t{depth}"
    parts += [
        f"s0 AS (SELECT domain, lang, source, leaf_tokens, CAST(floor(b + 1e-6) AS BIGINT) AS target FROM {before} JOIN leaf USING (domain, lang, source))",
        'settled AS (SELECT *, CASE WHEN leaf_tokens > 0 THEN target // leaf_tokens ELSE 0 END AS "whole", target - CASE WHEN leaf_tokens > 0 THEN target // leaf_tokens ELSE 0 END * leaf_tokens AS rest FROM s0)',
        f"""run AS (SELECT d.*, "whole", rest, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || "whole" || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d JOIN settled USING (domain, lang, source))""",
    ]
    return (
        "WITH " + ", ".join(parts) + ' SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, "whole")) AS epoch FROM run WHERE "whole" > 0 '
        'UNION ALL SELECT doc_id, domain, lang, source, n_tokens, "whole" AS epoch FROM run WHERE ahead < rest AND n_tokens > 0'
    )

"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import remove
from .common import written


def _mark(df: DataFrame) -> tuple:
    r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (a, b); root is the smallest node of the component.

    Every round is written to the shared folder, and removed when the next one is. Rounds grow with the logarithm of the longest path; the
    star joins are plain equi-joins, so that adaptive execution can split the rows of a hot node.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = written(spark, edges, "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(spark, large.distinct(), "large-star")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        before, edges = edges, written(spark, small.union(down.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        after = _mark(edges)
        remove(spark, before, large)
        if after == mark:
            break
        mark = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)

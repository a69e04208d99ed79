"""Connected components of small link tables by minimum labels; a round is written, and removed when the next one is."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import remove, shared_dir


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(match_id, node, root) of links (match_id, a, b): root is the least node that can be reached."""

    def kept(df: DataFrame) -> DataFrame:
        path = f"{shared_dir(spark)}/components-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    both = kept(links.select("match_id", "a", "b").union(links.select("match_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = both.groupBy("match_id", F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root"))
    new = None
    while True:
        label = kept(label)
        if new is not None:
            remove(spark, new)
        near = both.join(label.select("match_id", F.col("node").alias("b"), "root"), ["match_id", "b"]).groupBy("match_id", F.col("a").alias("node")).agg(F.min("root").alias("m"))
        moved = label.join(near, ["match_id", "node"])
        # a node takes the least label around it, then the label of that label's node
        new = kept(moved.select("match_id", "node", F.least("root", "m").alias("root"), (F.col("m") < F.col("root")).alias("changed")))
        if not new.where("changed").limit(1).count():
            remove(spark, new)
            return label
        remove(spark, label)
        hop = new.select("match_id", F.col("node").alias("root"), F.col("root").alias("far"))
        label = new.join(hop, ["match_id", "root"], "left").select("match_id", "node", F.least("root", "far").alias("root"))

"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-pitchflow-", dir="/tmp")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a local folder in local mode alone (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or _local_dir()


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table of its own in the shared folder and reads it again."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes the files of tables that were written to the shared folder and are no longer read."""
    for table in tables:
        files = table.inputFiles()
        if files:
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

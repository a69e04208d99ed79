"""Vectors of whole numbers: usable rows, and blocks of rows packed for tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & ~odd


def floored(vector: Column) -> Column:
    """floor(64 * c) of each component, as array<bigint>; what a long can't hold is the nearest long."""
    return F.transform(vector, lambda c: F.floor(64 * c.cast("double")))


def with_blocks(rows: DataFrame, row: str, blocks: int, name: str) -> DataFrame:
    """Deals rows to so many blocks of about equal size, by a hash of their number."""
    return rows.withColumn(name, F.pmod(F.xxhash64(F.col(row)), F.lit(blocks)).cast("int"))

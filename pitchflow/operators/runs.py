"""Runs, cooldowns and votes: shapes that many operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_run(df: DataFrame, by: list[str], order: str, changed: Column, name: str = "run") -> DataFrame:
    """Adds the number of rows so far, in order, for which ``changed`` holds: equal numbers are one run."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_new", changed).withColumn(name, F.sum(F.coalesce(F.col("_new").cast("long"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def changes(by: list[str], order: str, *columns: str) -> Column:
    """Whether any of the columns differs from the row before (true in the first row)."""
    w = Window.partitionBy(*by).orderBy(order)
    out = F.lag(F.lit(1)).over(w).isNull()
    for col in columns:
        out = out | ~F.col(col).eqNullSafe(F.lag(col).over(w))
    return out


def cooldown(df: DataFrame, by: list[str], order: str, gap: int) -> DataFrame:
    """Keeps a row if it is at least ``gap`` after the last kept one of its key. A fold over the key's ordered values."""
    kept = F.aggregate(
        F.array_sort(F.collect_list(order)), F.array().cast("array<long>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= gap), F.concat(acc, F.array(x))).otherwise(acc),
    )
    return df.join(df.groupBy(*by).agg(kept.alias("_kept")).select(*by, F.explode("_kept").alias(order)), [*by, order], "left_semi")


def first_per(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")

"""Whitening of vectors by the leading eigenvectors of their covariance.

Components become whole numbers x = floor(64 c) + 1,000,000. A first pass gives the number of vectors and the exact sums of each
dimension, a second the covariance: rows are centred before they are multiplied, each task adds up one matrix and Spark
sums the matrices cell by cell, so that what reaches the driver is one matrix of d x d cells whatever the number of rows (d is
checked). ``spectrum`` finds the leading eigenvectors there. A third pass measures the covariance of whitened rows, a
last one gives them out. Every pass reads the vectors from their table; nothing is held between passes but sums.

Cases: vectors that are null or hold null or non-finite entries are dropped, and so are those of another length than
most (of lengths as common, the longest stays; empty ones go); entries whose floor doesn't fit 2**61 count as that; repeated rows and ids count
as often as they stand there, null ids too; an eigenvalue that is zero to rounding (1e-11 of the largest) has no
component, as nothing is left to scale, so equal vectors give no rows; a deviation that no long holds is null. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spectrum import leading
from .vectors import floored, usable

SHIFT = 1_000_000
MOST = 1 << 61
WIDEST = 4096  # dimensions: a matrix of 128 MB
ZERO = 1e-11


def _cells(x: pa.Array, width: int | None = None) -> Iterator[np.ndarray]:
    """Arrays of rows of one length each (of length ``width`` alone, where given)."""
    size = np.diff(x.offsets.to_numpy())
    flat = x.flatten().to_numpy()
    at = np.cumsum(size) - size
    for w in [width] if width is not None else np.unique(size):
        own = np.flatnonzero(size == w)
        yield flat[at[own][:, None] + np.arange(w)[None, :]]


def _sums(batches):
    """(x) to (width, place, n, total): exact sums of each place, for every length."""
    n: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for cells in _cells(batch.column(0)):
            w = cells.shape[1]
            n[w] = n.get(w, 0) + len(cells)
            total[w] = total.get(w, np.zeros(w, dtype=object)) + (cells.sum(0) if np.abs(cells).max(initial=0) < 1 << 40 else cells.astype(object).sum(0))
    for w, sums in total.items():
        if w:
            exact = pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(w, w, np.int32)), pa.array(np.arange(w, dtype=np.int32)), pa.array(np.full(w, n[w], np.int64)), exact], ["width", "place", "n", "total"])


def centred(cells: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n as doubles: whole numbers are taken off first, so no digits are lost."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (cells - whole).astype(np.float64) - rest


def deviations(cells: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)² over the places, exact; None where a long can't hold it."""
    away = cells - np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n for s in sums], dtype=object)
    bound = (int(np.abs(away).max(initial=0)) + 1) * n
    if bound**2 * max(1, cells.shape[1]) < 1 << 63:
        return ((away * n - rest.astype(np.int64)) ** 2).sum(1).tolist()
    exact = ((away.astype(object) * n - rest) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def _products(n: int, sums: list[int], turn: np.ndarray | None = None):
    """(x) to (i, j, total) with i <= j: products of centred rows (turned to components, where given), summed by task."""
    width = len(sums)

    def code(batches):
        out = np.zeros((width, width) if turn is None else (turn.shape[1],) * 2)
        for batch in batches:
            for cells in _cells(batch.column(0), width):
                z = centred(cells, n, sums)
                z = z if turn is None else z @ turn
                out += z.T @ z
        i, j = np.triu_indices(len(out))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(out[i, j])], ["i", "j", "total"])

    return code


def _matrix(products: DataFrame, n: int, width: int) -> np.ndarray:
    got = products.groupBy("i", "j").agg(F.sum("total").alias("total")).toArrow()
    i, j, total = (got[c].to_numpy() for c in ("i", "j", "total"))
    out = np.zeros((width, width))
    out[i, j] = out[j, i] = total / n
    return out


def _whitened(n: int, sums: list[int], turn: np.ndarray):
    """(vec_id, x) to (vec_id, deviation, w)."""

    def code(batches):
        for batch in batches:
            x = batch.column(1)
            own = np.flatnonzero(np.diff(x.offsets.to_numpy()) == len(sums))
            for cells in _cells(x, len(sums)):
                w = centred(cells, n, sums) @ turn
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * turn.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(deviations(cells, n, sums), pa.int64()), lists], ["vec_id", "deviation", "w"])

    return code


def whole_numbers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of usable vectors."""
    fit = lambda c: F.least(F.greatest(c, F.lit(-MOST)), F.lit(MOST)) + SHIFT
    return vectors.where(usable(F.col(vector))).select(F.col(vec_id).alias("vec_id"), F.transform(floored(F.col(vector)), fit).alias("x"))


def whiten(spark: SparkSession, vectors: DataFrame, components: int = 32, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    rows = whole_numbers(vectors, vec_id, vector)
    kind = rows.schema["vec_id"].dataType.simpleString()
    sums = rows.select("x").mapInArrow(_sums, "width int, place int, n long, total decimal(38,0)").groupBy("width", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    common = sums.where("place = 0").orderBy(F.desc("n"), F.desc("width")).first()
    turn, n, explained, error = np.zeros((0, 0)), 0, [], 0.0
    totals: list[int] = []
    if common is not None:
        width, n = common["width"], common["n"]
        if width > WIDEST:
            raise ValueError(f"vectors of {width} dimensions: at most {WIDEST} can be whitened")
        totals = [int(r["total"]) for r in sums.where(F.col("width") == width).orderBy("place").collect()]
        covariance = _matrix(rows.select("x").mapInArrow(_products(n, totals), "i int, j int, total double"), n, width)
        values, axes = leading(covariance, components)
        firm = values > ZERO * max(values.max(initial=0.0), np.finfo(np.float64).tiny)
        turn = axes[:, firm] / np.sqrt(values[firm])
        explained = (values[firm] / np.trace(covariance)).tolist() if firm.any() else []
        if explained:
            seen = _matrix(rows.select("x").mapInArrow(_products(n, totals, turn), "i int, j int, total double"), n, len(explained))
            error = float(np.abs(seen - np.eye(len(explained))).max())
    if not explained:
        return rows.where("false").select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))))
    out = rows.mapInArrow(_whitened(n, totals, turn), f"vec_id {kind}, deviation long, w array<double>")
    out = out.select("vec_id", "deviation", F.posexplode("w").alias("place", "whitened"))
    share = F.element_at(F.array(*map(F.lit, explained)), F.col("component"))
    out = out.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened")
    return out.withColumns({"explained": share, "identity_error": F.lit(error)})

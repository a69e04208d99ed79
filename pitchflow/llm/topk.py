"""Exact search for the highest inner products, in three phases with a uniform threshold.

The components are cut in ``PARTS`` parts; for a query each part is a list of partial scores, and a score is the sum of one entry of every
list. The lists are cut once more, in blocks of rows, so that a task holds one block of queries and one of rows.

1. Every task gives out, for each query, the exact scores of the ``k`` best entries of each of its lists. The k-th
   best of all of them is a cutoff: at least k rows score as much.
2. The cutoff goes back to the tasks with the blocks of queries. A row that reaches it has an entry of at least
   cutoff / PARTS in some list (else its sum would be less), so entries below that are passed over in every list.
3. Scores of what is left are resolved exactly, those under the cutoff go, and the k best of each query stay. Rows that tie
   with the cutoff are never lost.

Phases 1 and 3 give out at most PARTS * k and k rows for a query and a block; ranks within a query are taken by a window
that Spark limits to k before it shuffles. A block of queries meets a block of rows by an equi-join on both numbers. Products are
summed as single floats only where every sum is a whole number under 2**24, else as doubles (2**53), longs or Python's integers.

Cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as
filled with zeros (so empty ones score 0); rows that repeat, ids included, are candidates of each other (a query leaves out just
its own row); a null id is no query, and comes last among ties; scores beyond a long are the nearest long;
fewer rows than k give fewer; without queries, or rows, nothing is returned. Other columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import remove
from .common import written
from .vectors import floored, usable, with_blocks

PARTS = 2
CELLS = 1 << 18  # components of a block of rows
QUERIES = 1024  # of a block of queries, at most
LOW, HIGH = -(1 << 63), (1 << 63) - 1
_PACKED = "block int, n int, width int, kind string, rows binary, ids binary, known binary, cutoffs binary, cells binary"


def _pack(batches):
    """(block, row, vec_id, x, cutoff), sorted by block, to one row a block."""
    held: list[pa.RecordBatch] = []

    def packed(batch: pa.RecordBatch):
        block = batch.column(0).to_numpy()
        for lo in np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])):
            own = batch.slice(lo, int(np.searchsorted(block, block[lo], side="right")) - lo)
            x = own.column(3)
            size = np.diff(x.offsets.to_numpy())
            cells = np.zeros((len(size), int(size.max(initial=0))), dtype=np.int64)
            cells[np.arange(cells.shape[1])[None, :] < size[:, None]] = x.flatten().to_numpy()
            kind = next(k for k in ("i1", "i2", "i4", "i8") if cells.size == 0 or (np.iinfo(k).min <= cells.min() and cells.max() <= np.iinfo(k).max))
            ids = own.column(2)
            yield [int(block[lo]), len(size), cells.shape[1], kind, own.column(1).to_numpy().tobytes(), ids.fill_null(0).to_numpy().astype(np.int64).tobytes(),
                   ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), own.column(4).fill_null(LOW).to_numpy().astype(np.int64).tobytes(), cells.astype(kind).tobytes()]

    def out(rows):
        names = [c.split()[0] for c in _PACKED.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 5]
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    for batch in batches:
        held.append(batch)
        if batch.num_rows and held[0].num_rows and held[0].column(0)[0].as_py() != batch.column(0)[-1].as_py():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            block = whole.column(0).to_numpy()
            last = int(np.searchsorted(block, block[-1]))
            yield from out(packed(whole.slice(0, last)))
            held = [whole.slice(last)]
    held = [b for b in held if b.num_rows]
    if held:
        yield from out(packed(pa.Table.from_batches(held).combine_chunks().to_batches()[0]))


def blocks_of(rows: DataFrame, blocks: int, cutoff: Column | None = None) -> DataFrame:
    """One row for each block of rows (row, vec_id, x)."""
    dealt = with_blocks(rows, "row", blocks, "block").select("block", "row", "vec_id", "x", (F.lit(None) if cutoff is None else cutoff).cast("long").alias("cutoff"))
    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_pack, _PACKED)


class Block:
    """A block of rows read back."""

    def __init__(self, n, width, kind, rows, ids, known, cutoffs, cells):
        self.rows, self.ids, self.cutoffs = (np.frombuffer(b, dtype=np.int64) for b in (rows, ids, cutoffs))
        self.known = np.frombuffer(known, dtype=np.uint8)
        self.cells = np.frombuffer(cells, dtype=kind).reshape(n, width)


def partial_scores(queries: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The lists: inner products over each part of the components, exact."""
    width = min(queries.shape[1], rows.shape[1])  # what one side lacks counts as zero
    most = lambda x: max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    bound = most(queries) * most(rows) * width
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < HIGH else object
    q, r = queries[:, :width].astype(kind), rows[:, :width].astype(kind)
    cuts = [width * p // PARTS for p in range(PARTS + 1)]
    return [q[:, a:b] @ r[:, a:b].T for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _longs(values: np.ndarray) -> np.ndarray:
    return np.clip(values, LOW, HIGH).astype(np.int64) if values.dtype == object else values.astype(np.int64)


def _others(queries: Block, rows: Block) -> np.ndarray:
    return queries.rows[:, None] != rows.rows[None, :]


def first_lists(queries: Block, rows: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, score): exact scores of the k best entries of each list, the k best of them for a query."""
    lists = partial_scores(queries.cells, rows.cells)
    total, other = sum(lists), _others(queries, rows)
    met = np.zeros(other.shape, dtype=bool)
    for part in lists:
        part = np.where(other, part, -np.inf) if part.dtype != object else np.where(other, part, LOW)
        best = np.argpartition(part, -k, axis=1)[:, -k:] if part.shape[1] > k else np.broadcast_to(np.arange(part.shape[1]), part.shape)
        np.put_along_axis(met, best, True, axis=1)
    query, row = np.nonzero(met & other)
    return _best(queries, query, rows, row, _longs(total[query, row]), k)[::2]


def reached(queries: Block, rows: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of rows at or above the query's cutoff, the k best of them for a query."""
    lists = partial_scores(queries.cells, rows.cells)
    cutoff = queries.cutoffs
    share = np.where((cutoff > -(1 << 52)) & (cutoff < 1 << 52), np.floor(cutoff / PARTS), -np.inf)[:, None]  # doubles hold it, or it doesn't cut
    if lists[0].dtype == np.float32:
        share = share.astype(np.float32)
    met = lists[0] >= share
    for part in lists[1:]:
        met |= part >= share
    query, row = np.nonzero(met & _others(queries, rows))
    score = _longs(sum(part[query, row] for part in lists)) if len(query) else np.zeros(0, np.int64)
    firm = score >= queries.cutoffs[query]
    return _best(queries, query[firm], rows, row[firm], score[firm], k)


def _best(queries: Block, query: np.ndarray, rows: Block, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((rows.ids[row], 1 - rows.known[row].astype(np.int8), ~score, query))  # ~score falls as score rises
    query, row, score = query[order], row[order], score[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return query[rank < k], row[rank < k], score[rank < k]


def _met(k: int, first: bool):
    """Rows of both blocks' columns to (query, score), or to (query, query_id, vec_id, score)."""

    def code(batches):
        for batch in batches:
            for pair in batch.to_pylist():
                queries, rows = (Block(*(pair[f"{side}_{c.split()[0]}"] for c in _PACKED.split(", ")[1:])) for side in ("q", "r"))
                if first:
                    query, score = first_lists(queries, rows, k)
                    yield pa.RecordBatch.from_arrays([pa.array(queries.rows[query]), pa.array(score)], ["query", "score"])
                else:
                    query, row, score = reached(queries, rows, k)
                    columns = [pa.array(queries.rows[query]), pa.array(queries.ids[query]), pa.array(rows.ids[row], mask=rows.known[row] == 0), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(columns, ["query", "query_id", "vec_id", "score"])

    return code


def _pairs(queries: DataFrame, rows: DataFrame, n_queries: int, n_rows: int) -> DataFrame:
    """Every block of queries with every block of rows, by an equi-join on both numbers."""
    named = lambda df, side: df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns))
    q = named(queries, "q").withColumn("r_block", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    r = named(rows, "r").withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    return q.repartition("q_block", "r_block").join(r.repartition("q_block", "r_block"), ["q_block", "r_block"])


def top(spark: SparkSession, vectors: DataFrame, query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``query`` tells, the k other rows of highest score, ties to the smaller id."""
    if k < 1:
        raise ValueError("k must be positive")
    kept = vectors.where(usable(F.col(vector)))
    rows = kept.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), floored(F.col(vector)).alias("x"), F.coalesce(query, F.lit(False)).alias("asks"))
    rows = written(spark, rows, "vectors")
    n, asked, width = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("x"))).first()
    asks = rows.where("asks")
    n_rows, n_queries = (max(1, math.ceil(m * max(16, width or 1) / cells)) for m, cells in ((n, CELLS), (asked, min(CELLS, QUERIES * max(16, width or 1)))))
    row_blocks = written(spark, blocks_of(rows, n_rows), "row-blocks")
    lists = _pairs(blocks_of(asks, n_queries), row_blocks, n_queries, n_rows).mapInArrow(_met(k, True), "query long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    cutoffs = lists.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    cutoffs = cutoffs.select(F.col("query").alias("row"), F.when(F.col("n") >= k, F.col("least")).alias("cutoff"))
    cut = written(spark, blocks_of(asks.join(cutoffs, "row", "left"), n_queries, F.col("cutoff")), "query-blocks")
    remove(spark, rows)
    found = _pairs(cut, row_blocks, n_queries, n_rows).mapInArrow(_met(k, False), "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

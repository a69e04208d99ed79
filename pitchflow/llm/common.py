"""Shared pieces: the cluster's shared folder, folds, and byte and word arrays over batches of text.

Words are runs of bytes other than space and \\x09-\\x0D. Batches are cut so that the arrays of one
step stay near ``STEP_BYTES`` bytes of text (a longer text is a step of its own).
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

STEP_BYTES = 1 << 18

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within, the shuffle files of a query are removed when it ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it again: cuts lineage, survives lost executors."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Keeps what a Python worker holds at once small, unless the session says otherwise already."""
    for key, usual, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", None, size)):
        if spark.conf.get(key, None) in (None, usual, "-1", "2147483647b", "9223372036854775807b"):
            spark.conf.set(key, value)


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n


def text_arrays(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and their n + 1 offsets. Null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    col = col.cast(pa.large_binary())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def steps(off: np.ndarray, size: int = STEP_BYTES):
    """(first, last) row ranges whose texts together have about ``size`` bytes."""
    first, n = 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + size, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the offset of its first word (n + 1 values)."""
    tok = ~SPACE[data]
    inner = tok[1:] & tok[:-1] if len(tok) else tok
    edge = off[(off > 0) & (off < len(data))] - 1
    inner[edge] = False
    starts = tok.copy()
    starts[1:] &= ~inner
    ends = tok.copy()
    ends[:-1] &= ~inner
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 1 << 22:
            _powers[name] = have
    return have[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * base**i modulo 2**64, with a leading zero."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(_BASE, len(values), "up"), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each range of the values behind ``sums``; equal content gives equal hashes."""
    return mix((sums[end] - sums[start]) * _power(_INVERSE, len(sums), "down")[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(prefix_sums(BYTE_VALUE[data]), starts, ends)


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring 64-bit values (edges of texts are the caller's)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(values)
    return mix((sums[size:] - sums[:-size]) * _power(_INVERSE, len(sums), "down")[:n] + np.uint64(size))

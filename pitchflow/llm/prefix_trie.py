"""The prefix trie of conversations, from sorted shards and a skeleton of splitters.

A turn is known by 128 bits: two hashes of its role, its text and its place. A path is the sequence of a conversation's turns,
cut every ``HEIGHT`` turns into segments, so that a row stays small however long a conversation is; a segment starts from
the node that its conversation has reached there (told by the bits of all turns before, put together by exclusive or).
Equal segments are one row with a number of conversations, so copies don't meet.

Segments are ranged: splitters, drawn from a sample of 20 segments a shard, cut the order of paths into shards. A node whose path no
splitter starts with has all its conversations in one shard, since its paths stand together. The trie of the splitters' paths
(the skeleton, at most ``HEIGHT`` nodes a splitter) is broadcast. Each shard is sorted and read once with the nodes of the path at
hand on a stack: nodes outside the skeleton are finished there, nodes of the skeleton give a partial
sum of what the shard has of them, and those are added up. The sample only balances shards; results don't depend on it.

What hangs below a segment's end (conversations of more than ``HEIGHT`` turns) is carried up: shards of the deeper segments alone are
walked first; the totals of each segment's root are given to the smallest conversation through it, summed along conversations
from their ends, and then by root.

The hash of a node's ends is taken over a stream: ranged and sorted ids are joined to pieces by the tasks that hold them, and a
node's pieces are read in order, so that nothing but the state of the hash is held, whatever the number of ends.

Cases: rows without conv_id are passed over; turns are ordered by number (null first), then by role, then by text; null role or
text is empty; repeated rows are turns of their own; a conversation that is left without turns ends at the root; an empty
table has no node, not even the root. Other columns aren't read. Equality of turns rests on their 128 bits.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import remove
from .common import written

HEIGHT = 256
SAMPLE = 20  # segments a shard from which splitters are drawn
PIECE = 1 << 16  # bytes of joined ids
CELL = 16  # bytes of a turn
_NODE = "k1 long, k2 long, p1 long, p2 long, depth long, root boolean, conv_id long, n long, children long, leaves long, saved long, shared boolean, more_children long, less_saved long"


def numbered(spark: SparkSession, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, at, h1, h2, bytes) in order, and for each conversation and part (conv_id, part, first, before, n).

    The place of a turn is at - first + before. Rows are ranged by conversation and turn, so that a long conversation is spread over tasks.
    """
    role, text = (F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text, F.xxhash64(F.monotonically_increasing_id()).alias("any"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "any"]
    hashed = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(11), "text", "role").alias("h2"), F.octet_length("text").cast("long").alias("bytes")]
    at = F.monotonically_increasing_id()  # partition and place in it
    turns = written(spark, rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", at.alias("at"), *hashed), "turns")
    turns = turns.withColumn("part", F.shiftright("at", 33))
    parts = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return turns, parts.withColumn("before", F.coalesce(before, F.lit(0).cast("long")))


def rebuilt(spark: SparkSession, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place, total, h1, h2, bytes) of rebuilt conversations, and the ids of those without a turn.

    Conversation c gets the first h = crc32(c) % 9 turns of conversation c - c % 5, then its own after its first h.
    """
    turns, parts = numbered(spark, conversations)
    parts = written(spark, parts, "parts")
    h = F.crc32(F.col("conv_id").cast("string")) % 9
    sizes = parts.groupBy("conv_id").agg(F.sum("n").alias("size")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % 5})
    bases = sizes.where("conv_id = base").select("base", F.col("size").alias("had"))
    taken = F.least("h", F.coalesce("had", F.lit(0).cast("long")))
    sizes = sizes.join(bases, "base", "left").withColumn("taken", taken).withColumn("total", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0).cast("long")))
    sizes = written(spark, sizes.select("conv_id", "base", "h", "taken", "total"), "sizes")
    placed = turns.join(parts.select("conv_id", "part", "first", "before").join(sizes, "conv_id"), ["conv_id", "part"]).withColumn("was", F.col("at") - F.col("first") + F.col("before"))
    kept = ["h1", "h2", "bytes"]
    own = placed.where("was >= h").select("conv_id", (F.col("was") - F.col("h") + F.col("taken")).alias("place"), "total", *kept)
    heads = placed.where("conv_id = base AND was < 8").select("base", F.col("was").alias("place"), *kept)
    lent = sizes.where("taken > 0").join(heads, "base").where("place < taken").select("conv_id", "place", "total", *kept)
    return own.unionByName(lent), sizes.where("total = 0").select("conv_id")


def _hex(*longs: Column) -> Column:
    return F.concat(*(F.lpad(F.hex(c), 16, "0") for c in longs))


def segments(spark: SparkSession, turns: DataFrame, turnless: DataFrame) -> DataFrame:
    """(conv_id, level, r1, r2, e1, e2, path, bytes, goes_on): the segments of each conversation; r the node before, e the node at its end."""
    cell = F.struct("place", F.xxhash64("h1", "h2", "place").alias("g1"), F.xxhash64(F.lit(13), "h2", "h1", "place").alias("g2"), "bytes")
    level = F.expr(f"place div {HEIGHT}")
    cut = turns.select("conv_id", level.alias("level"), "total", cell.alias("cell")).groupBy("conv_id", "level")
    cut = cut.agg(F.array_sort(F.collect_list("cell")).alias("cells"), F.bit_xor("cell.g1").alias("x1"), F.bit_xor("cell.g2").alias("x2"), F.max("total").alias("total"))
    path = F.unhex(F.array_join(F.transform("cells", lambda c: _hex(c["g1"], c["g2"])), ""))
    zero = F.lit(0).cast("long")
    bare = turnless.select("conv_id", zero.alias("level"), zero.alias("x1"), zero.alias("x2"), F.unhex(F.lit("")).alias("path"), F.array().cast("array<bigint>").alias("bytes"), F.lit(False).alias("goes_on"))
    rows = cut.select("conv_id", "level", "x1", "x2", path.alias("path"), F.col("cells.bytes").alias("bytes"), (F.col("total") > (F.col("level") + 1) * HEIGHT).alias("goes_on"))
    rows = cells = written(spark, rows.unionByName(bare), "cut")
    so_far = Window.partitionBy("conv_id").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    long = rows.where("level > 0 OR goes_on").select("conv_id", "level", *(F.bit_xor(f"x{k}").over(so_far).alias(f"r{k}") for k in (1, 2))).where("level > 0")
    top = rows.where("level = 0").withColumns({"r1": zero, "r2": zero})
    rows = top.unionByName(rows.where("level > 0").join(long, ["conv_id", "level"]))
    ends = {f"e{k}": F.col(f"r{k}").bitwiseXOR(F.col(f"x{k}")) for k in (1, 2)}
    out = written(spark, rows.withColumns(ends).drop("x1", "x2"), "segments")
    remove(spark, cells)
    return out


class Skeleton:
    """The trie of the splitters' paths. A node is told by 17 bytes: whether it is a segment's root, and its bits."""

    def __init__(self, splitters: list[tuple[bytes, list[int]]]):
        self.keys = [k for k, _ in splitters]
        self.nodes: dict[bytes, list[int]] = {}  # children, bytes of the turns in its subtree
        parents: dict[bytes, bytes] = {}
        own: dict[bytes, int] = {}
        deepest_first: list[tuple[int, bytes]] = []
        for key, sizes in splitters:
            above = b""
            for depth, node in enumerate(_nodes(key)):
                if node not in self.nodes:
                    self.nodes[node], own[node] = [0, 0], sizes[depth - 1] if depth else 0
                    deepest_first.append((-depth, node))
                    if depth:
                        parents[node] = above
                        self.nodes[above][0] += 1
                above = node
        for _, node in sorted(deepest_first):
            self.nodes[node][1] += own[node]
            if node in parents:
                self.nodes[parents[node]][1] += self.nodes[node][1]


def _nodes(key: bytes, first: int = 0) -> list[bytes]:
    """Names of the nodes along a path: its root's bits, then a turn each; from the first-th on."""
    cells = np.frombuffer(key, dtype=">u8").reshape(-1, 2)
    bits = np.bitwise_xor.accumulate(cells, axis=0).astype(">u8").tobytes()
    return [(b"\0" if d else b"\1") + bits[CELL * d : CELL * d + CELL] for d in range(first, len(cells))]


def _common(a: bytes, b: bytes) -> int:
    """Cells that two keys start with alike."""
    n = min(len(a), len(b)) // CELL
    if a[: CELL * n] == b[: CELL * n]:
        return n
    x, y = (np.frombuffer(k, dtype=np.uint64, count=2 * n) for k in (a, b))
    return int(np.argmax(x != y)) // 2


def _walk(shared):
    """Sorted segments (key, level, bytes, n, conv_id, goes_on, children, leaves, saved) to nodes; a shard is read once, the path at hand is on a stack."""

    def code(batches):
        skeleton: dict[bytes, list[int]] = shared.value.nodes
        stack: list[list] = []  # name, depth, bytes, conv_id, n, children, leaves, saved, goes on
        out: list[tuple] = []
        last = b""

        def close(height: int) -> None:
            while len(stack) > height:
                name, depth, size, conv, n, children, leaves, saved, goes_on = stack.pop()
                above = stack[-1] if stack else None
                fixed = skeleton.get(name)
                if not children and not goes_on and not (fixed and fixed[0]):
                    leaves += 1
                saved += (n if fixed else n - 1) * size
                parent = above[0][1:] if above else b"\0" * CELL
                bits = np.frombuffer(name[1:] + parent, dtype=">i8").tolist()
                out.append((*bits, depth, name[0] == 1, conv, n, children, leaves, saved, fixed is not None, *(fixed or (0, 0))))
                if above:
                    above[3] = conv if above[3] is None else min(above[3], conv)
                    above[4] += n
                    above[5] += fixed is None
                    above[6] += leaves
                    above[7] += saved

        def batch_of() -> pa.RecordBatch:
            kinds = {"long": pa.int64(), "boolean": pa.bool_()}
            fields = [c.split() for c in _NODE.split(", ")]
            columns = [pa.array(list(c), kinds[k]) for c, (_, k) in zip(zip(*out, strict=True), fields, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, [c for c, _ in fields])

        for batch in batches:
            for key, level, sizes, n, conv, goes_on, children, leaves, saved in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                same = _common(last, key)
                close(same)
                for d, name in enumerate(_nodes(key, same), same):
                    stack.append([name, level * HEIGHT + d, sizes[d - 1] if d else 0, None, 0, 0, 0, 0, False])
                end = stack[-1]
                end[3] = conv if end[3] is None else min(end[3], conv)
                end[4] += n
                end[5] += children
                end[6] += leaves
                end[7] += saved
                end[8] = end[8] or goes_on
                last = key
                if len(out) > 10_000:
                    yield batch_of()
        close(0)
        if out:
            yield batch_of()

    return code


def skeleton_of(spark: SparkSession, rows: DataFrame, shards: int) -> Skeleton:
    """Splitters from a sample of so many segments a shard, at most ``HEIGHT`` turns each."""
    n = rows.count()
    wanted = SAMPLE * shards
    drawn = rows.select("key", "bytes").sample(fraction=min(1.0, wanted / n), seed=7).collect() if n else []
    drawn = sorted((bytes(r["key"]), list(r["bytes"])) for r in drawn)
    picked = [drawn[len(drawn) * s // shards] for s in range(1, shards)] if drawn else []
    return Skeleton([p for i, p in enumerate(picked) if not i or p[0] != picked[i - 1][0]])


def nodes(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(k1, k2, p1, p2, depth, root, conv_id, n, children, leaves, saved) of all nodes of segments (key, level, bytes, n, conv_id, goes_on, children, leaves, saved)."""
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(skeleton_of(spark, rows, shards))

    def shard(key: pa.Array) -> pa.Array:
        return pa.array([bisect_right(shared.value.keys, k) for k in key.to_pylist()], pa.int32())

    dealt = rows.withColumn("shard", F.arrow_udf(shard, "int")("key")).repartitionById(shards, F.col("shard"))
    dealt = dealt.sortWithinPartitions("key").select("key", "level", "bytes", "n", "conv_id", "goes_on", "children", "leaves", "saved")
    walked = written(spark, dealt.mapInArrow(_walk(shared), _NODE), "walked")
    parts = walked.where("shared").groupBy("k1", "k2", "root", "depth", "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), (F.sum("children") + F.max("more_children")).alias("children"),
        F.sum("leaves").alias("leaves"), (F.sum("saved") - F.max("less_saved")).alias("saved"))
    columns = ["k1", "k2", "p1", "p2", "depth", "root", "conv_id", "n", "children", "leaves", "saved"]
    return walked.where("NOT shared").select(*columns).unionByName(parts.select(*columns))


def _distinct(cut: DataFrame) -> DataFrame:
    """Equal segments as one row with the number of their conversations."""
    key = F.unhex(F.concat(_hex(F.col("r1"), F.col("r2")), F.hex("path")))
    return cut.groupBy(key.alias("key"), "level", "e1", "e2").agg(F.first("bytes").alias("bytes"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.max("goes_on").alias("goes_on"))


def _carried(spark: SparkSession, cut: DataFrame, rows: DataFrame) -> DataFrame:
    """(e1, e2, children, leaves, saved): what hangs below the nodes where segments go on."""
    zero = F.lit(0).cast("long")
    deep = nodes(spark, rows.where("level > 0").withColumns({"children": zero, "leaves": zero, "saved": zero})).where("root")
    deep = written(spark, deep.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.col("conv_id").alias("least"), "children", "leaves", "saved"), "deeper")
    along = cut.where("level > 0").select("conv_id", "level", "r1", "r2").join(deep, ["r1", "r2"])
    own = F.col("conv_id") == F.col("least")
    from_end = Window.partitionBy("conv_id").orderBy(F.desc("level"))
    along = along.select("r1", "r2", *(F.sum(F.when(own, F.col(c)).otherwise(0)).over(from_end).alias(c) for c in ("leaves", "saved")))
    below = along.groupBy("r1", "r2").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    out = below.join(deep.select("r1", "r2", "children"), ["r1", "r2"])
    return written(spark, out.select(F.col("r1").alias("e1"), F.col("r2").alias("e2"), "children", "leaves", "saved"), "carried")


def _pieces(batches):
    """Sorted (k1, k2, conv_id) to (k1, k2, conv_id, piece): ids joined by commas, the least id of each piece."""
    key, first, ids, size, out = None, 0, [], 0, []

    def batch_of():
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["k1", "k2", "conv_id", "piece"])

    for batch in batches:
        for k1, k2, conv in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (k1, k2) != key or size > PIECE:
                if ids:
                    out.append((*key, first, ",".join(ids)))
                key, first, ids, size = (k1, k2), conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
            if len(out) > 2000:
                yield batch_of()
    if ids:
        out.append((*key, first, ",".join(ids)))
    if out:
        yield batch_of()


def _digests(batches):
    """Sorted (k1, k2, conv_id, piece) to (k1, k2, ends_sha256)."""
    key, state, out = None, None, []

    def batch_of():
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["k1", "k2", "ends_sha256"])

    for batch in batches:
        for k1, k2, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if (k1, k2) == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256()
            state.update(piece.encode())
            if len(out) > 10_000:
                yield batch_of()
    if key is not None:
        out.append((*key, state.hexdigest()))
    if out:
        yield batch_of()


def ends(cut: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of nodes at which conversations end."""
    at = cut.where("NOT goes_on").select(F.col("e1").alias("k1"), F.col("e2").alias("k2"), "conv_id")
    pieces = at.repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(_pieces, "k1 long, k2 long, conv_id long, piece string")
    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")


def trie(spark: SparkSession, turns: DataFrame, turnless: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv_id, place, total, h1, h2, bytes), places from 0 without a gap; turnless: (conv_id).
    """
    cut = segments(spark, turns, turnless)
    rows = distinct = written(spark, _distinct(cut), "distinct")
    zero = F.lit(0).cast("long")
    sums = ("children", "leaves", "saved")
    if rows.where("level > 0").limit(1).count():
        rows = rows.join(_carried(spark, cut, rows), ["e1", "e2"], "left").withColumns({c: F.coalesce(c, zero) for c in sums})
        rows = written(spark, rows, "with-carried")
        remove(spark, distinct)
    else:
        rows = rows.withColumns({c: zero for c in sums})
    found = written(spark, nodes(spark, rows).where("NOT root OR depth = 0"), "nodes")
    above = found.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = found.join(ends(cut), ["k1", "k2"], "left").join(above, ["p1", "p2"], "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))

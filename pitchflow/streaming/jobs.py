"""Jobs over arriving rows with event time ``ts``: windows, sessions, de-duplication. All take a streaming or a batch frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.helpers import held_possession


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of a table's files as they arrive (``path``: folder and name), with match and track keys."""
    folder, name = path.rsplit("/", 1)
    return keyed(spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name).parquet(folder))


def keyed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("match_id", F.concat(F.lit("m"), F.pmod("user_id", F.lit(4)).cast("string"))).withColumn("track_id", F.pmod("user_id", F.lit(22)))


def live_quality(rows: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """ST1: rows and active ids per tumbling window."""
    g = rows.withWatermark("ts", late).groupBy("match_id", F.window("ts", size).alias("w"))
    return g.agg(F.count("*").alias("rows"), F.approx_count_distinct("track_id", 0.01).alias("ids")).select("match_id", F.col("w.start").alias("start"), "rows", "ids")


def live_load(rows: DataFrame, size: str = "6 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """ST2: load per track in sliding windows."""
    g = rows.withWatermark("ts", late).groupBy("match_id", "track_id", F.window("ts", size, slide).alias("w"))
    return g.agg(F.count("*").alias("rows"), F.max("value").alias("top")).select("match_id", "track_id", F.col("w.start").alias("start"), "rows", "top")


def possession_sessions(rows: DataFrame, gap: str = "2 hours", late: str = "4 hours") -> DataFrame:
    """ST3: sessions of one carrier."""
    g = rows.withWatermark("ts", late).groupBy("match_id", "track_id", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count("*").alias("rows")).select("match_id", "track_id", F.col("w.start").alias("start"), "rows")


def stretches(ms, last: int | None, quiet_ms: int) -> list[tuple[int, int, bool]]:
    """(from, to, goes on) of ordered times cut where more than ``quiet_ms`` passed; ``last`` is the time before them, if any is kept.

    State is forgotten by this rule and by timers alike, so results don't depend on how rows are cut into batches.
    """
    gone = [i for i, t in enumerate(ms) if (i and t - ms[i - 1] > quiet_ms) or (not i and (last is None or t - last > quiet_ms))]
    cuts = sorted({0, *gone})
    return [(x, y, not x and x not in gone) for x, y in zip(cuts, [*cuts[1:], len(ms)], strict=True)]


def live_possession(rows: DataFrame, least: int = 3, late: str = "2 hours", quiet_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """ST4: W5's hysteresis over arriving (match_id, ts, track_id) rows; the holder and its rival are kept between batches.

    Rows are taken in order of time within a batch; rows later than the watermark are dropped. State is four numbers a match, and
    goes after seven quiet days of event time.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def code(key, parts, state: GroupState):
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        part = pd.concat(list(parts)).sort_values(["ts", "track_id"], kind="stable")
        ms = [int(t.timestamp() * 1000) for t in part.due]
        *now, last = state.get if state.exists else (-1, -1, 0, None)
        held = []
        for a, b, on in stretches(ms, last, quiet_ms):
            some, now = held_possession(part.track_id.to_numpy(dtype="int64")[a:b], least, tuple(now) if on else (-1, -1, 0))
            held.append(some)
        state.update((*now, ms[-1]))
        state.setTimeoutTimestamp(max(ms[-1], state.getCurrentWatermarkMs()) + quiet_ms)
        yield part[["match_id", "ts", "track_id"]].assign(holder=np.concatenate(held))

    # a watermark starts at the epoch: moved on by the delay, rows of its first seconds aren't late
    chosen = rows.select("match_id", "ts", "track_id", (F.col("ts") + F.expr(f"INTERVAL {late}")).alias("due")).withWatermark("due", late)
    return chosen.groupBy("match_id").applyInPandasWithState(code, "match_id string, ts timestamp, track_id long, holder long", "holder long, rival long, n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


#: Settings under which a vector can be kept as state with timers.
KEPT_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def live_drift(rows: DataFrame, trigger: float = 0.70, low: float = 0.5, patience: int = 5, late: str = "2 hours", quiet_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """ST5: I12 over arriving (match_id, player_id, ts, embedding) rows: similarity to the player's anchor, alert under ``trigger``, reset of the anchor.

    A player's state is its anchor and the number of rows under ``low`` on end; after 24 quiet hours of event time a timer removes it, and the
    next row is a new anchor. Rows are taken in order of time within a batch; rows later than the watermark are dropped, and so are those without a vector.
    Run it under ``KEPT_STATE``.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Drift(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("anchor", "anchor array<double>, under int, last long")

        def handleInputRows(self, key, rows, timerValues):
            import numpy as np
            import pandas as pd

            from pitchflow.operators.helpers import drift_from

            part = pd.concat(list(rows)).sort_values("ts", kind="stable")
            vectors, ms = [np.asarray(v, dtype=float) for v in part.embedding], [int(t.timestamp() * 1000) for t in part.ts]
            kept = self.state.get() if self.state.exists() else None
            anchor, under, last = (np.asarray(kept[0], dtype=float), int(kept[1]), int(kept[2])) if kept is not None else (None, 0, None)
            sims, resets = [], []
            for a, b, on in stretches(ms, last, quiet_ms):
                more, again, (anchor, under) = drift_from(vectors[a:b], (anchor, under) if on else None, low, patience)
                sims.append(more)
                resets.append(again)
            self.state.update((anchor.tolist(), under, ms[-1]))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(ms[-1], timerValues.getCurrentWatermarkInMs()) + quiet_ms)
            sims = np.concatenate(sims)
            yield part[["match_id", "player_id", "ts"]].assign(similarity=sims, alert=sims < trigger, reset=np.concatenate(resets))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.state.clear()
            yield from ()

        def close(self) -> None:
            pass

    chosen = rows.where("embedding IS NOT NULL AND size(embedding) > 0").withWatermark("ts", late).select("match_id", "player_id", "ts", "embedding")
    schema = "match_id string, player_id string, ts timestamp, similarity double, alert boolean, reset boolean"
    return chosen.groupBy("match_id", "player_id").transformWithStateInPandas(Drift(), schema, "Append", "EventTime")


def live_referees(rows: DataFrame, enough: int = 4, late: str = "2 hours", quiet_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """ST6: A37 over arriving (match_id, track_id, ts, is_official) rows: votes so far and the first decision, which sticks.

    State is three numbers a track, and is dropped after six quiet hours of event time; rows later than the watermark are.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def code(key, parts, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        n, yes, said = state.get if state.exists else (0, 0, "")
        part = pd.concat(list(parts)).sort_values("ts", kind="stable")
        out = []
        for official in part.is_official:
            n, yes = n + 1, yes + int(official)
            if not said and n >= enough:
                said = "official" if yes / n >= 0.75 else "player" if yes / n < 0.30 else ""
            out.append((n, yes, said or ("suspected" if yes else "player")))
        state.update((n, yes, said))
        state.setTimeoutTimestamp(max(int(part.ts.max().timestamp() * 1000), state.getCurrentWatermarkMs()) + quiet_ms)
        yield part[["match_id", "track_id", "ts"]].assign(votes=[x[0] for x in out], officials=[x[1] for x in out], decision=[x[2] for x in out])

    chosen = rows.withWatermark("ts", late).select("match_id", "track_id", "ts", "is_official")
    schema = "match_id string, track_id long, ts timestamp, votes long, officials long, decision string"
    return chosen.groupBy("match_id", "track_id").applyInPandasWithState(code, schema, "n long, yes long, said string", "append", GroupStateTimeout.EventTimeTimeout)


def without_repeats(rows: DataFrame, late: str = "2 hours") -> DataFrame:
    """ST7: rows whose event_id came before within the watermark are dropped."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def drained(spark: SparkSession, out: DataFrame, name: str, mode: str = "append", settings: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream over all that is there, under these settings, and reads what it wrote to a table of its own."""
    import uuid

    from ..sources.shared import shared_dir

    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    try:
        q = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}.checkpoint").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(out.schema).parquet(path)


def ingested(spark: SparkSession, rows: DataFrame, path: str, put=None) -> DataFrame:
    """ST8: appends what has arrived since the last run to the store at ``path``, and reads the store.

    Where a run stopped is kept beside the store, under the same path on every run. A batch is written to a folder of its number, over whatever an earlier try left
    there, so a run that dies between the write and its note is done again without loss or repeats. ``put`` (rows, folder) writes a batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        folder = f"{path}/batch={number}"
        put(batch, folder) if put else batch.write.mode("overwrite").parquet(folder)

    q = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}.checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(path)

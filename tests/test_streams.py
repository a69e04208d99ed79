"""Replayed in small batches, a stream gives what one batch gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchflow.operators import helpers
from pitchflow.streaming import jobs


def test_state_goes_on_between_batches(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), ((F.col("id") / 5).cast("long") % 3 * 4).alias("user_id"))
    for i in range(3):
        rows.where(f"event_id div 20 = {i}").coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    stream = jobs.keyed(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"))
    got = jobs.drained(spark, jobs.live_possession(stream), "test-st4").orderBy("ts").collect()
    tracks = [r.track_id for r in jobs.keyed(rows).orderBy("ts").collect()]
    assert len(got) == 60 and [r.track_id for r in got] == tracks
    assert [r.holder for r in got] == helpers.held_possession(np.array(tracks))[0].tolist()


def test_repeats_within_the_watermark_go(spark, tmp_path):
    rows = spark.range(30).select((F.col("id") % 20).alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("user_id"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = jobs.keyed(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    assert jobs.drained(spark, jobs.without_repeats(stream), "test-st7").count() == 20


def test_referee_votes_go_on_between_batches(spark, tmp_path):
    seen = {0: "yyyyny", 1: "nnnnyyyyy", 2: "yn", 3: "ynynynyyyyyyyyyyyy"}
    rows = spark.createDataFrame([("m0", k, i, c == "y") for k, v in seen.items() for i, c in enumerate(v)], "match_id string, track_id long, i long, is_official boolean").withColumn("ts", F.timestamp_seconds(F.col("i") + 100))
    for k in range(3):
        rows.where(f"i div 6 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = jobs.drained(spark, jobs.live_referees(stream), "test-st6").collect()
    last = {r.track_id: (r.votes, r.decision) for r in sorted(got, key=lambda r: r.votes)}
    assert len(got) == rows.count() and last == {0: (6, "official"), 1: (9, "player"), 2: (2, "suspected"), 3: (18, "official")}


def stream_of(spark, rows, path, cuts):
    """rows with a column i, arriving in files cut at these values of i, one a batch."""
    for k, (a, b) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        rows.where(f"i >= {a if a is not None else -1}" + (f" AND i < {b}" if b is not None else "")).coalesce(1).write.parquet(f"{path}/part{k}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def test_drift_equals_the_batch_rule_in_any_cut(spark, tmp_path):
    rng = np.random.default_rng(3)
    turns = {"P1": [rng.normal(size=4) for _ in range(40)], "P2": [np.ones(4)] * 12 + [np.array([1.0, -1, 0, 0])] * 9 + [np.ones(4)] * 9, "P3": [np.zeros(4)] * 5}
    rows = spark.createDataFrame([("m", p, i, [float(x) for x in v]) for p, vs in turns.items() for i, v in enumerate(vs)] + [("m", "P4", 3, None)], "match_id string, player_id string, i long, embedding array<double>").withColumn("ts", F.timestamp_seconds(F.col("i") + 1000))
    want = {(r.player_id): (r.n, r.alerts, r.resets, r.least) for r in helpers.embedding_drift(rows.where("embedding IS NOT NULL").withColumn("frame_idx", F.col("i"))).collect()}
    assert want["P2"][2] == 2
    for k, cuts in enumerate(([], [7, 15], [13, 14, 15, 29])):
        out = jobs.drained(spark, jobs.live_drift(stream_of(spark, rows, f"{tmp_path}/{k}", cuts)), "test-st5", settings=jobs.KEPT_STATE).collect()
        for p, vs in turns.items():
            own = [r for r in out if r.player_id == p]
            assert (len(own), sum(r.alert for r in own), sum(r.reset for r in own), round(min(r.similarity for r in own), 5)) == want[p] and len(own) == len(vs)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != jobs.KEPT_STATE["spark.sql.streaming.stateStore.providerClass"]


@pytest.mark.parametrize("cuts", [[3, 4], [], [5]])
def test_quiet_players_are_forgotten(spark, tmp_path, cuts):
    """After quiet days of event time state goes, however rows are cut: the next row is an anchor, the next holder the first one near."""
    day = 86_400
    at = [5, 10, 20, 3 * day, 8 * day, 8 * day + 10]  # the row of day 3 belongs to another key and moves the watermark
    vectors = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.0, 1.0], [1.0, 0.0]]
    rows = spark.createDataFrame([("m" if t != 3 * day else "n", "P" if t != 3 * day else "Q", i, 1 if i < 4 else 2, t, v) for i, (t, v) in enumerate(zip(at, vectors, strict=True))], "match_id string, player_id string, i long, track_id long, t long, embedding array<double>").withColumn("ts", F.timestamp_seconds("t"))
    out = jobs.drained(spark, jobs.live_drift(stream_of(spark, rows, f"{tmp_path}/a", cuts)), "test-st5", settings=jobs.KEPT_STATE).where("match_id = 'm'").orderBy("ts").collect()
    assert [round(r.similarity, 6) for r in out] == [1, 1, 0, 1, 0]
    out = jobs.drained(spark, jobs.live_possession(stream_of(spark, rows, f"{tmp_path}/b", cuts)), "test-st4").where("match_id = 'm'").orderBy("ts").collect()
    assert [r.holder for r in out] == [1, 1, 1, 2, 2]


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    """A run that dies after writing half or all of a batch, but before its note, loses nothing and doubles nothing; later runs take what is new."""
    rows = spark.range(100).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("i"))
    rows.where("event_id < 60").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    source = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    store = f"{tmp_path}/store"

    def dies(share):
        def put(batch, folder):
            batch.where(F.col("event_id") % 2 < share).write.mode("overwrite").parquet(folder)
            raise RuntimeError("the writer is gone")

        return put

    for share in (1, 2):
        with pytest.raises(Exception, match="the writer is gone"):
            jobs.ingested(spark, source(), store, dies(share))
    assert sorted(r.event_id for r in jobs.ingested(spark, source(), store).collect()) == list(range(60))
    rows.where("event_id >= 60").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    for _ in range(2):
        assert sorted(r.event_id for r in jobs.ingested(spark, source(), store).collect()) == list(range(100))

"""Readers for tracking files with declared schemas, and small writers. Every reader takes a path or a glob.

Aliases (snake and camel case, list or dict boxes) are settled here; text booleans become booleans and NaN
becomes null. The match id is the file's name without its ending and without a known suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Suffixes of a match's derived files.
SUFFIXES = ("_final_tactics", "_final_pitch", "_final", "_tactics", "_pitch")


def base_match_id(name: Column | str) -> Column:
    """IO11: the id without one known suffix."""
    return F.regexp_replace(F.col(name) if isinstance(name, str) else name, f"({'|'.join(SUFFIXES)})$", "")


def _match_id() -> Column:
    return base_match_id(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[A-Za-z]+)+$", 1))


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("match_id", _match_id())


def _bool(c: str) -> Column:
    return F.lower(F.col(c).cast("string")) == "true"


def _number(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def _listed(kind: str, *keys: str) -> Column:
    """The array of ``kind`` that a text is, or has under one of the keys; null for another form."""
    out = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{kind}>"))
    for key in keys:
        out = out.when(F.get_json_object("value", f"$.{key}").startswith("["), F.from_json("value", f"struct<{key}:array<{kind}>>")[key])
    return out


def read_tracks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """IO1: tracks[].trajectory[] to (points with boxes, track headers)."""
    point = "frameIndex bigint, timestampSeconds double, bbox array<double>, confidence double, world_x double, world_y double"
    head = "trackId bigint, teamId bigint, role string, hits bigint, firstSeen bigint, lastSeen bigint, confirmed_detections bigint"
    raw = _json(spark, path, f"tracks array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ', 1) for x in head.split(', ')))}, trajectory: array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ', 1) for x in point.split(', ')))}>>>>")
    t = raw.select("match_id", F.explode("tracks").alias("t"))
    heads = t.select("match_id", F.col("t.trackId").alias("track_id"), F.col("t.teamId").alias("team_id"), "t.role", "t.hits", F.col("t.firstSeen").alias("first_seen"), F.col("t.lastSeen").alias("last_seen"), "t.confirmed_detections")
    p = t.select("match_id", F.col("t.trackId").alias("track_id"), F.explode("t.trajectory").alias("p")).where(F.size("p.bbox") == 4)
    box = [F.col("p.bbox")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    points = p.select("match_id", "track_id", F.col("p.frameIndex").alias("frame_idx"), F.col("p.timestampSeconds").alias("ts_s"), *box, _number(F.col("p.confidence")).alias("confidence"), _number(F.col("p.world_x")).alias("world_x"), _number(F.col("p.world_y")).alias("world_y"))
    return points, heads


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """IO2: frames[].players[] with aliases; officials and boxes without four values are dropped."""
    player = "rawTrackId:bigint, raw_track_id:bigint, trackId:bigint, track_id:bigint, playerId:string, player_id:string, team_id:bigint, teamId:bigint, role:string, is_official:string, assignment_source:string, identity_confidence:double, confidence:double, bbox:string"
    raw = _json(spark, path, f"frames array<struct<frameIndex:bigint, frame_index:bigint, players:array<struct<{player}>>>>")
    p = raw.select("match_id", F.explode("frames").alias("f")).select("match_id", F.coalesce("f.frameIndex", "f.frame_index").alias("frame_idx"), F.explode("f.players").alias("p")).select("match_id", "frame_idx", "p.*")
    as_list = F.from_json("bbox", "array<double>")
    as_dict = F.from_json("bbox", "struct<x1:double,y1:double,x2:double,y2:double,x:double,y:double,w:double,h:double>")
    d = p.withColumn("_l", as_list).withColumn("_d", as_dict)
    ok = F.size("_l") == 4
    box = {"x1": F.coalesce("_d.x1", "_d.x"), "y1": F.coalesce("_d.y1", "_d.y"), "x2": F.coalesce(F.col("_d.x2"), F.col("_d.x") + F.col("_d.w")), "y2": F.coalesce(F.col("_d.y2"), F.col("_d.y") + F.col("_d.h"))}
    d = d.withColumns({n: F.when(ok, F.col("_l")[i]).otherwise(c) for i, (n, c) in enumerate(box.items())})
    d = d.where(~F.coalesce(_bool("is_official"), F.lit(False)) & F.col("x1").isNotNull() & F.col("y2").isNotNull() & F.col("x2").isNotNull() & F.col("y1").isNotNull())
    return d.select("match_id", "frame_idx", F.coalesce("rawTrackId", "raw_track_id", "trackId", "track_id").alias("raw_track_id"), F.coalesce("playerId", "player_id").alias("player_id"), F.coalesce("team_id", "teamId").alias("team_id"), "role", "assignment_source", "identity_confidence", "confidence", *box)


def read_teams(spark: SparkSession, path: str) -> DataFrame:
    """IO3: a team map as a list or under ``tracks``."""
    entry = "trackId:bigint, track_id:bigint, teamId:bigint, team_id:bigint"
    text = spark.read.text(path, wholetext=True).withColumn("match_id", _match_id())
    return text.select("match_id", F.explode(_listed(f"struct<{entry}>", "tracks")).alias("t")).select("match_id", F.coalesce("t.trackId", "t.track_id").alias("track_id"), F.coalesce("t.teamId", "t.team_id").alias("team_id"))


def read_pitch(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """IO4: players[].trajectory2d[] to (points, ball rows, homographies)."""
    point = "frameIndex:bigint, x:double, y:double, source:string, confidence:double"
    raw = _json(spark, path, f"players array<struct<trackId:bigint, teamId:bigint, is_ball:string, trajectory2d:array<struct<{point}>>>>, homographies map<string, array<array<double>>>")
    p = raw.select("match_id", F.explode("players").alias("p")).select("match_id", F.col("p.trackId").alias("track_id"), F.col("p.teamId").alias("team_id"), F.coalesce(F.lower("p.is_ball") == "true", F.lit(False)).alias("is_ball"), F.explode("p.trajectory2d").alias("q"))
    p = p.withColumn("is_ball", F.col("is_ball") | (F.col("track_id") == -1)).select("match_id", "track_id", "team_id", "is_ball", F.col("q.frameIndex").alias("frame_idx"), _number(F.col("q.x")).alias("x"), _number(F.col("q.y")).alias("y"), "q.source", "q.confidence")
    h = raw.select("match_id", F.explode("homographies").alias("f", "h")).select("match_id", F.col("f").cast("long").alias("frame_idx"), *(F.flatten("h")[i].alias(f"h{i}") for i in range(9)))
    return p.where("NOT is_ball").select("match_id", "track_id", "team_id", "frame_idx", "x", "y"), p.where("is_ball").select("match_id", "frame_idx", "x", "y", "source", "confidence"), h


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """IO5: events as one list (or under ``events``), or in buckets by kind, which name the kind where it is missing."""
    event = "type:string, frame:bigint, team:bigint, player_track_id:bigint, x:double, y:double"
    text = spark.read.text(path, wholetext=True).withColumn("match_id", _match_id())
    flat = _listed(f"struct<{event}>", "events")
    one = text.where(flat.isNotNull()).select("match_id", F.explode(flat).alias("e")).select("match_id", F.lit(None).cast("string").alias("bucket"), "e")
    many = text.where(flat.isNull()).select("match_id", F.explode(F.from_json("value", f"map<string, array<struct<{event}>>>")).alias("bucket", "es")).select("match_id", "bucket", F.explode("es").alias("e"))
    return one.unionByName(many).select("match_id", F.coalesce("e.type", "bucket").alias("type"), "e.frame", "e.team", "e.player_track_id", "e.x", "e.y")


def read_motion(spark: SparkSession, path: str) -> DataFrame:
    """IO6: camera motion as a list, under ``frames``, or keyed by frame."""
    row = "frameIndex:bigint, dx:double, dy:double, motion_class:string"
    text = spark.read.text(path, wholetext=True).withColumn("match_id", _match_id())
    flat = _listed(f"struct<{row}>", "frames")
    listed = text.where(flat.isNotNull()).select("match_id", F.explode(flat).alias("m")).select("match_id", F.col("m.frameIndex").alias("frame_idx"), "m.dx", "m.dy", "m.motion_class")
    keyed = text.where(flat.isNull()).select("match_id", F.explode(F.from_json("value", f"map<string, struct<{row}>>")).alias("k", "m")).select("match_id", F.coalesce(F.col("m.frameIndex"), F.col("k").cast("long")).alias("frame_idx"), "m.dx", "m.dy", "m.motion_class")
    return listed.unionByName(keyed)


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """IO7: review actions from CSV; blank actions are left out."""
    schema = "event_id string, action string, thread_id string, target_thread_id string, segment_id string, frame bigint, reason string, status string, label string, notes string"
    return spark.read.schema(schema).csv(path, header=True).where("trim(coalesce(action, '')) <> ''")


def write_review(events: DataFrame, path: str) -> None:
    """IO7: the review queue as CSV: rows that need review, with a blank action."""
    events.where("status = 'needs_review'").withColumn("action", F.lit("")).write.mode("error").csv(path, header=True)


def read_memory(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """IO8: stored match summaries, newest first, at most ``limit``; one row for each match, the newest."""
    rows = spark.read.schema("match_id string, ts double, sprints bigint, max_kmh double, width double").json(path)
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("ts")))).where("_rn = 1").drop("_rn").orderBy(F.desc("ts"))
    return rows.limit(limit) if limit else rows


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """IO9: object labels (cls cx cy w h per line) with file and split from the path."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_p"))
    v = F.split(F.trim("value"), r"\s+")
    out = raw.where(F.size(v) == 5).select(F.regexp_extract("_p", r"([^/]+)\.txt$", 1).alias("file"), F.regexp_extract("_p", r"/(train|valid|test)/", 1).alias("split"), v[0].try_cast("int").alias("cls"), *(v[i + 1].try_cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"))))
    return out.where("cls IS NOT NULL")


def label_statistics(labels: DataFrame) -> DataFrame:
    """IO9: for each split and class the files, boxes, mean sides and mean share of the picture."""
    return labels.groupBy("split", "cls").agg(F.count_distinct("file").alias("files"), F.count("*").alias("boxes"), F.avg("w").alias("mean_w"), F.avg("h").alias("mean_h"), F.avg(F.col("w") * F.col("h")).alias("mean_area"))


def export_timeline(timeline: DataFrame, path: str, form: str = "parquet") -> None:
    """IO10: the joined timeline, partitioned by match."""
    timeline.write.mode("error").partitionBy("match_id").format(form).save(path)


def merge_chunks(points: DataFrame, chunk_frames: int) -> DataFrame:
    """IO12: chunked runs as one: frames and track ids are moved on by all chunks before."""
    ids = points.groupBy("match_id", "chunk").agg((F.max("track_id") + 1).alias("_ids"))
    w = Window.partitionBy("match_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    off = ids.withColumn("_off", F.coalesce(F.sum("_ids").over(w), F.lit(0))).drop("_ids")
    out = points.join(off, ["match_id", "chunk"])  # a row for each five-minute chunk
    return out.withColumn("track_id", F.col("track_id") + F.col("_off")).withColumn("frame_idx", F.col("frame_idx") + F.col("chunk") * chunk_frames).drop("_off")

"""Joins in time and space."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, iou, segment_distance

FRAME = ["match_id", "frame_idx"]


def nearest_in_time(left: DataFrame, right: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """J3, unlimited: columns of the right row nearest in frame_idx, the earlier on ties; one window over the union."""
    w = Window.partitionBy(*by).orderBy("frame_idx", "_side")
    value = F.struct(F.col("frame_idx").alias("_at"), *columns)
    a = left.select(*by, "frame_idx", F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).alias("_r"))
    b = right.select(*by, "frame_idx", F.lit(0).alias("_side"), F.lit(None).alias("_l"), value.alias("_r"))
    both = a.withColumn("_r", a["_r"].cast(b.schema["_r"].dataType)).unionByName(b.withColumn("_l", b["_l"].cast(a.schema["_l"].dataType)))
    both = both.withColumn("_b", F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy(*by).orderBy(F.desc("frame_idx"), F.desc("_side"))  # from the end, so that frames only grow
    both = both.withColumn("_a", F.last("_r", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))).where("_side = 1")
    pick = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull() | (F.col("frame_idx") - F.col("_b._at") <= F.col("_a._at") - F.col("frame_idx")), F.col("_b")).otherwise(F.col("_a"))
    return both.select("_l.*", pick.alias("_p")).select(*left.columns, *(F.col(f"_p.{c}").alias(c) for c in columns))


def nearest_within(frames: DataFrame, points: DataFrame, by: list[str], reach: int) -> DataFrame:
    """J3 with a limit: for each frame row and key, the point at most ``reach`` frames off, the earlier on ties."""
    spread = points.withColumn("_d", F.explode(F.array(*[F.lit(k) for k in range(-reach, reach + 1)]))).withColumn("_at", F.col("frame_idx") - F.col("_d")).withColumnRenamed("frame_idx", "source_frame")
    met = frames.join(spread.withColumnRenamed("_at", "frame_idx"), FRAME)
    w = Window.partitionBy("match_id", "frame_idx", *by).orderBy(F.abs("_d"), "source_frame")
    return met.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_d")


def with_ball(points: DataFrame, ball: DataFrame) -> DataFrame:
    """Points on frames with a ball, with bx, by, source and distance d."""
    b = ball.select(*FRAME, F.col("x").alias("bx"), F.col("y").alias("by"), "source")
    return points.join(b, FRAME).withColumn("d", distance("x", "y", "bx", "by"))


def carriers(points: DataFrame, ball: DataFrame, limit: float | None = None) -> DataFrame:
    """The nearest player under the limit (by ball source if None), lower track on ties: one row per frame."""
    reach = F.when(F.col("source") == "yolo", 3.0).when(F.col("source") == "hough_candidate", 5.0).when(F.col("source") == "kalman_prediction", 7.0).otherwise(5.0) if limit is None else F.lit(limit)
    near = with_ball(points, ball).where(F.col("d") < reach)
    best = near.groupBy(*FRAME).agg(F.min(F.struct("d", "track_id", "team_id", "x", "y", "bx", "by")).alias("m"))
    return best.select(*FRAME, F.col("m.track_id").alias("carrier"), F.col("m.team_id").alias("team_id"), F.col("m.d").alias("d"), F.col("m.x").alias("x"), F.col("m.y").alias("y"), F.col("m.bx").alias("bx"), F.col("m.by").alias("by"))


def frame_pairs(players: DataFrame, key: str = "raw_track_id") -> DataFrame:
    """J5's base: all pairs of a frame's boxes, lower key first, with columns a_* and b_*."""
    a = players.select(*FRAME, *(F.col(c).alias(f"a_{c}") for c in players.columns if c not in FRAME))
    b = players.select(*FRAME, *(F.col(c).alias(f"b_{c}") for c in players.columns if c not in FRAME))
    return a.join(b, FRAME).where(F.col(f"a_{key}") < F.col(f"b_{key}"))


def congestion(players: DataFrame) -> DataFrame:
    """Neighbours of each box (centres under 80 px or IoU 0.10 or more); congested from three on."""
    pairs = frame_pairs(players)
    near = (distance((F.col("a_x1") + F.col("a_x2")) / 2, (F.col("a_y1") + F.col("a_y2")) / 2, (F.col("b_x1") + F.col("b_x2")) / 2, (F.col("b_y1") + F.col("b_y2")) / 2) < 80) | (iou("a_", "b_") >= 0.10)
    ends = pairs.where(near).select(*FRAME, F.explode(F.array("a_raw_track_id", "b_raw_track_id")).alias("raw_track_id"))
    return ends.groupBy(*FRAME, "raw_track_id").agg(F.count("*").alias("neighbours")).withColumn("congested", F.col("neighbours") >= 3)


def passing_lanes(points: DataFrame, carrier: DataFrame) -> DataFrame:
    """Team-mates of the carrier within 30 m, and whether an opponent is under 2 m from the line to them."""
    hold = carrier.select(*FRAME, F.col("carrier").alias("passer"), F.col("team_id").alias("_team"), F.col("x").alias("px"), F.col("y").alias("py"))
    met = points.join(hold, FRAME)
    mates = met.where((F.col("team_id") == F.col("_team")) & (F.col("track_id") != F.col("passer"))).withColumn("metres", distance("x", "y", "px", "py")).where("metres <= 30")
    lanes = mates.select(*FRAME, "passer", F.col("track_id").alias("receiver"), "metres", "px", "py", F.col("x").alias("rx"), F.col("y").alias("ry"), "_team")
    foes = points.select(*FRAME, F.col("team_id").alias("_foe_team"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    hit = lanes.join(foes, FRAME).where("_foe_team <> _team").where(segment_distance("ox", "oy", "px", "py", "rx", "ry") < 2).select(*FRAME, "receiver").distinct()
    return lanes.join(hit.withColumn("_hit", F.lit(True)), [*FRAME, "receiver"], "left").select(*FRAME, "passer", "receiver", "metres", F.coalesce("_hit", F.lit(False)).alias("blocked"))


def after_event(events: DataFrame, rows: DataFrame, window: int) -> DataFrame:
    """Rows of the match in [frame, frame + window] of each event; joined by blocks of ``window`` frames."""
    e = events.withColumn("_b", F.explode(F.array(F.floor(F.col("event_frame") / window), F.floor(F.col("event_frame") / window) + 1)))
    r = rows.withColumn("_b", F.floor(F.col("frame_idx") / window))
    return e.join(r, ["match_id", "_b"]).where("frame_idx BETWEEN event_frame AND event_frame + " + str(window)).drop("_b")


def fragments_to_merge(tracks: DataFrame, max_gap: int = 120) -> DataFrame:
    """Pairs (a, b) of track fragments where b starts 0..max_gap frames after a ends; joined by blocks of time."""
    a = tracks.select("match_id", F.col("track_id").alias("a"), F.col("last_seen").alias("a_end"), F.explode(F.sequence(F.floor(F.col("last_seen") / max_gap), F.floor(F.col("last_seen") / max_gap) + 1)).alias("_b"))
    b = tracks.select("match_id", F.col("track_id").alias("b"), F.col("first_seen").alias("b_start"), F.floor(F.col("first_seen") / max_gap).alias("_b"))
    return a.join(b, ["match_id", "_b"]).where("a <> b").withColumn("gap", F.col("b_start") - F.col("a_end")).where(f"gap BETWEEN 0 AND {max_gap}").drop("_b")


def timeline(points: DataFrame, ball: DataFrame, matches: DataFrame) -> DataFrame:
    """J13 and IO10: all frames of a match with their players (empty where none) and ball."""
    frames = matches.select("match_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames_processed") - 1)).alias("frame_idx"))
    per = points.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("track_id", "team_id", "x", "y"))).alias("players"))
    b = ball.select(*FRAME, F.struct("x", "y", "source").alias("ball"))
    out = frames.join(per, FRAME, "left").join(b, FRAME, "left")
    return out.withColumn("players", F.coalesce("players", F.array().cast(per.schema["players"].dataType)))

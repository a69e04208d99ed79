"""Preparation of trajectories: filters, gap filling, smoothing, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clamp, distance, inverted, project
from .joins import nearest_in_time
from .physical import TRACK, over_track


def with_homography(points: DataFrame, homographies: DataFrame) -> DataFrame:
    """P2's join: the homography of the nearest frame that has one, the earlier on ties; columns h0..h8."""
    return nearest_in_time(points, homographies, ["match_id"], [f"h{i}" for i in range(9)])


def to_pitch(points: DataFrame, homographies: DataFrame, px: str = "px", py: str = "py") -> DataFrame:
    """Pixels to metres, clamped to the pitch; rows without any homography are dropped."""
    out = with_homography(points, homographies).where("h8 IS NOT NULL")
    x, y = project(px, py, [F.col(f"h{i}") for i in range(9)])
    return out.withColumn("pitch_x", clamp(x, 0.0, 105.0)).withColumn("pitch_y", clamp(y, 0.0, 68.0))


def to_pixel(points: DataFrame, homographies: DataFrame) -> DataFrame:
    """Metres to pixels by the inverse of the nearest homography."""
    out = with_homography(points, homographies).where("h8 IS NOT NULL")
    px, py = project("x", "y", inverted([F.col(f"h{i}") for i in range(9)]))
    return out.withColumn("px", px).withColumn("py", py)


def drop_staff(points: DataFrame, tracks: DataFrame) -> DataFrame:
    """Tracks with an on-pitch share of 0.3 or more, whose upper-median position is near the pitch or its centre."""
    on = F.col("x").between(0.0, 105.0) & F.col("y").between(0.0, 68.0)
    middle = lambda col: F.element_at(F.array_sort(F.collect_list(col)), (F.floor(F.count("*") / 2) + 1).cast("int"))
    per = points.groupBy(*TRACK).agg(F.avg(on.cast("double")).alias("share"), middle("x").alias("mx"), middle("y").alias("my"))
    near = F.col("mx").between(-15.0, 120.0) & F.col("my").between(-15.0, 83.0) | (distance("mx", "my", 52.5, 34.0) <= 20)
    return points.join(per.where((F.col("share") >= 0.3) & near), TRACK, "left_semi")


def enough_detections(tracks: DataFrame, least: int = 2, fallback: int = 1, tracks_wanted: int = 5) -> DataFrame:
    """Tracks of ``least`` hits, or of ``fallback`` if under five of the match would be left."""
    left = F.sum((F.col("hits") >= least).cast("long")).over(Window.partitionBy("match_id"))
    out = tracks.withColumn("_left", left)
    return out.where(F.col("hits") >= F.when(F.col("_left") < tracks_wanted, fallback).otherwise(least)).drop("_left")


def fill_gaps(points: DataFrame, by: list[str], max_missing: int) -> DataFrame:
    """Linear fill of gaps of up to max_missing frames; filled rows are flagged."""
    w = Window.partitionBy(*by).orderBy("frame_idx")
    out = points.select(*by, "frame_idx", "x", "y").withColumns({"_nf": F.lead("frame_idx").over(w), "_nx": F.lead("x").over(w), "_ny": F.lead("y").over(w)})
    gap = F.col("_nf") - F.col("frame_idx")
    frames = F.when((gap > 1) & (gap - 1 <= max_missing), F.sequence("frame_idx", F.col("_nf") - 1)).otherwise(F.array("frame_idx"))
    out = out.withColumn("_f", F.explode(frames))
    t = (F.col("_f") - F.col("frame_idx")) / gap
    lerp = lambda a, b: F.when(F.col("_f") == F.col("frame_idx"), F.col(a)).otherwise(F.col(a) + t * (F.col(b) - F.col(a)))
    return out.select(*by, F.col("_f").alias("frame_idx"), lerp("x", "_nx").alias("x"), lerp("y", "_ny").alias("y"), (F.col("_f") != F.col("frame_idx")).alias("filled"))


def densify(points: DataFrame, matches: DataFrame, max_gap: int = 10) -> DataFrame:
    """P10: one row for each track and frame: head filled back, gaps up to max_gap frames linear, longer ones and the tail held."""
    grid = points.select(*TRACK).distinct().join(matches.select("match_id", "frames_processed"), "match_id")
    grid = grid.select(*TRACK, F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames_processed") - 1)).alias("frame_idx"))
    w = over_track()
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*TRACK).orderBy(F.desc("frame_idx")).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col("x").isNotNull(), F.struct("frame_idx", "x", "y"))
    out = grid.join(points.select(*TRACK, "frame_idx", "x", "y"), [*TRACK, "frame_idx"], "left")
    out = out.withColumn("_a", F.last(seen, ignorenulls=True).over(before)).withColumn("_b", F.last(seen, ignorenulls=True).over(after))
    gap = F.col("_b.frame_idx") - F.col("_a.frame_idx")
    t = (F.col("frame_idx") - F.col("_a.frame_idx")) / gap

    def value(v: str):
        a, b = F.col(f"_a.{v}"), F.col(f"_b.{v}")
        return F.when(F.col("_a").isNull(), b).when(F.col("_b").isNull() | (gap == 0) | (gap > max_gap), a).otherwise(a + t * (b - a)).alias(v)

    return out.select(*TRACK, "frame_idx", value("x"), value("y"))


def dedupe(points: DataFrame, by: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    from .runs import first_per

    return first_per(points, by, *order)


def smoothed(points: DataFrame, column: str, kind: str, by: list[str] | None = None):
    """mean3 (edges raw), mean5, median3, median5, trail15 (first 14 raw). A column."""
    w = Window.partitionBy(*(by or TRACK)).orderBy("frame_idx")
    whole = Window.partitionBy(*(by or TRACK))
    rn, n = F.row_number().over(w), F.count("*").over(whole)
    if kind == "mean3":
        return F.when((rn == 1) | (rn == n), F.col(column)).otherwise(F.avg(column).over(w.rowsBetween(-1, 1)))
    if kind == "trail15":
        return F.when(rn < 15, F.col(column)).otherwise(F.avg(column).over(w.rowsBetween(-14, 0)))
    k = int(kind[-1]) // 2
    frame = w.rowsBetween(-k, k)
    return F.avg(column).over(frame) if kind.startswith("mean") else F.percentile(column, F.lit(0.5)).over(frame)


def flag_unreliable(points: DataFrame) -> DataFrame:
    """Faster than 35 m/s from two rows before to two rows after."""
    w = over_track()
    dt = (F.lead("frame_idx", 2).over(w) - F.lag("frame_idx", 2).over(w)) / 25.0
    d = distance(F.lead("x", 2).over(w), F.lead("y", 2).over(w), F.lag("x", 2).over(w), F.lag("y", 2).over(w))
    return points.withColumn("reliable", F.coalesce(d / dt <= 35.0, F.lit(True)))


def add_heading(points: DataFrame) -> DataFrame:
    """Degrees towards the next point; the last repeats the one before."""
    w = over_track()
    own = F.degrees(F.atan2(F.lead("y").over(w) - F.col("y"), F.lead("x").over(w) - F.col("x")))
    out = points.withColumn("_h", own)
    return out.withColumn("heading", F.coalesce("_h", F.lag("_h").over(w), F.lit(0.0))).drop("_h")


def separate_collisions(points: DataFrame, every: int = 5, near: float = 1.5, shift: float = 0.75) -> DataFrame:
    """On every fifth frame the higher track of a pair nearer than 1.5 m moves by 0.75 m in x, for each such pair."""
    at = points.where(F.col("frame_idx") % every == 0)
    a, b = at.alias("a"), at.alias("b")
    close = (F.col("a.match_id") == F.col("b.match_id")) & (F.col("a.frame_idx") == F.col("b.frame_idx")) & (F.col("a.track_id") < F.col("b.track_id"))
    pairs = a.join(b, close).where(distance("a.x", "a.y", "b.x", "b.y") < near)
    moved = pairs.groupBy(F.col("b.match_id").alias("match_id"), F.col("b.frame_idx").alias("frame_idx"), F.col("b.track_id").alias("track_id")).agg(F.count("*").alias("conflicts"))
    out = points.join(moved, ["match_id", "frame_idx", "track_id"], "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))
    return out.withColumn("x", F.col("x") + shift * F.col("conflicts"))


def flag_outliers(points: DataFrame, every: int = 10, limit: float = 40.0) -> DataFrame:
    """On sampled frames, rows over 40 m from their team's centroid."""
    w = Window.partitionBy("match_id", "frame_idx", "team_id")
    out = points.where(F.col("frame_idx") % every == 0).withColumn("off", distance("x", "y", F.avg("x").over(w), F.avg("y").over(w)))
    return out.withColumn("outlier", F.col("off") > limit)


def calibration_factor(points: DataFrame, width: float = 50.0) -> DataFrame:
    """P20: upper median over frames of width / lateral spread, within 0.8 and 1.2."""
    per = points.groupBy("match_id", "frame_idx").agg((F.max("y") - F.min("y")).alias("spread"), F.count("*").alias("n")).where("n >= 4 AND spread > 0")
    ratio = per.withColumn("r", F.lit(width) / F.col("spread"))
    middle = F.element_at(F.array_sort(F.collect_list("r")), (F.floor(F.count("*") / 2) + 1).cast("int"))
    return ratio.groupBy("match_id").agg(clamp(middle, 0.8, 1.2).alias("factor"))


def mark_quality(points: DataFrame, windows: DataFrame, size: int = 25) -> DataFrame:
    """Whether a point lies in an unreliable window of 25 frames; windows (match_id, win, reliable)."""
    return points.withColumn("win", F.floor(F.col("frame_idx") / size)).join(windows, ["match_id", "win"], "left").withColumn("quality", F.when(F.coalesce("reliable", F.lit(True)), "metric").otherwise("approximate"))


def camera_offsets(motion: DataFrame) -> DataFrame:
    """Running camera offset, reset at each cut."""
    w = Window.partitionBy("match_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    out = motion.withColumn("scene", F.sum((F.col("motion_class") == "cut").cast("long")).over(w))
    s = Window.partitionBy("match_id", "scene").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    own = lambda c: F.sum(F.when(F.col("motion_class") == "cut", 0.0).otherwise(F.col(c))).over(s)
    return out.withColumn("off_x", own("dx")).withColumn("off_y", own("dy"))


def filter_ball(ball: DataFrame, jump: float = 4.0, still: float = 0.5) -> DataFrame:
    """Drops off-pitch rows, teleports (distance per frame) and balls that have lain still over the last 50 rows."""
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    step = distance("x", "y", F.lag("x").over(w), F.lag("y").over(w)) / (F.col("frame_idx") - F.lag("frame_idx").over(w))
    past = F.collect_list(F.struct("x", "y")).over(w.rowsBetween(-50, -1))
    near = F.size(F.filter(past, lambda p: distance(p["x"], p["y"], "x", "y") <= still))
    out = ball.withColumn("_step", step).withColumn("_n", F.size(past)).withColumn("_near", near)
    ok = F.col("x").between(0.0, 105.0) & F.col("y").between(0.0, 68.0) & F.coalesce(F.col("_step") <= jump, F.lit(True)) & ~((F.col("_n") >= 30) & (F.col("_near") >= 0.8 * F.col("_n")))
    return out.where(ok).drop("_step", "_n", "_near")


def ball_arcs(ball: DataFrame) -> DataFrame:
    """Gaps of 15 m, 15 m/s and half a second or more are flights with an apex by length."""
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    out = ball.withColumns({"end_frame": F.lead("frame_idx").over(w), "_x": F.lead("x").over(w), "_y": F.lead("y").over(w)})
    out = out.withColumn("metres", distance("x", "y", "_x", "_y")).withColumn("dt_s", (F.col("end_frame") - F.col("frame_idx")) / 25.0)
    out = out.where((F.col("metres") >= 15) & (F.col("dt_s") >= 0.5) & (F.col("metres") / F.col("dt_s") >= 15))
    return out.select("match_id", F.col("frame_idx").alias("start_frame"), "end_frame", "metres", F.least(F.lit(4.0), 0.08 * F.col("metres") + 0.2).alias("apex_m"))


def harden(points: DataFrame, ball: DataFrame) -> DataFrame:
    """speed_kmh, is_active (moved over 0.5 m) and is_possession (nearest to the ball, under 2 m)."""
    w = over_track()
    step = distance("x", "y", F.lag("x").over(w), F.lag("y").over(w))
    out = points.withColumn("step", step).withColumn("_dt", (F.col("frame_idx") - F.lag("frame_idx").over(w)) / 25.0)
    out = out.withColumn("speed_kmh", F.coalesce(F.col("step") / F.col("_dt") * 3.6, F.lit(0.0))).withColumn("is_active", F.coalesce(F.col("step") > 0.5, F.lit(False)))
    b = ball.select("match_id", "frame_idx", F.col("x").alias("bx"), F.col("y").alias("by"))
    near = points.join(b, ["match_id", "frame_idx"]).withColumn("d", distance("x", "y", "bx", "by"))
    holder = near.groupBy("match_id", "frame_idx").agg(F.min(F.struct("d", "track_id")).alias("m")).where("m.d < 2").select("match_id", "frame_idx", F.col("m.track_id").alias("_holder"))
    out = out.join(holder, ["match_id", "frame_idx"], "left")
    return out.select("match_id", "track_id", "frame_idx", "x", "y", "speed_kmh", "is_active", F.coalesce(F.col("_holder") == F.col("track_id"), F.lit(False)).alias("is_possession"))


def resampled(points: DataFrame, part: float = 0.5, carry: int = 8, gap: int = 15) -> DataFrame:
    """Each track at frame + part from its first to its last row: linear, and as a Catmull-Rom spline.

    Linear: between neighbouring frames; with one of them missing the other; else the last of up to ``carry`` frames before.
    Spline: between rows up to ``gap`` frames apart, else the row before; neither goes on for more than ``carry`` frames.
    """
    w = over_track()
    at = lambda c, k: F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w)
    cols = {f"_{c}{k}": at(c, k) for c in ("frame_idx", "x", "y") for k in (-1, 1, 2)}
    rows = points.select(*TRACK, "frame_idx", "x", "y").withColumns(cols).where("_frame_idx1 IS NOT NULL")
    dt = F.col("_frame_idx1") - F.col("frame_idx")
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), dt - 1))).withColumn("at", F.col("frame_idx") + F.col("_k") + part)
    u = (F.col("_k") + part) / dt

    def linear(c: str):
        last = F.col("_k") == dt - 1
        return F.when((F.col("_k") == 0) & last, F.col(c) * (1 - part) + F.col(f"_{c}1") * part).when(F.col("_k") == 0, F.col(c)).when(last, F.col(f"_{c}1")).when(F.col("_k") <= carry, F.col(c))

    def spline(c: str):
        v0, v1, v2, v3 = (F.col(n) for n in (f"_{c}-1", c, f"_{c}1", f"_{c}2"))
        flat = (v2 - v1) / dt
        m1 = F.when(v0.isNull(), flat).otherwise((v2 - v0) / (F.col("_frame_idx1") - F.col("_frame_idx-1")))
        m2 = F.when(v3.isNull(), flat).otherwise((v3 - v1) / (F.col("_frame_idx2") - F.col("frame_idx")))
        u2, u3 = u * u, u * u * u
        curve = (2 * u3 - 3 * u2 + 1) * v1 + (u3 - 2 * u2 + u) * dt * m1 + (-2 * u3 + 3 * u2) * v2 + (u3 - u2) * dt * m2
        return F.when(F.col("_k") > carry, None).when(dt > gap, v1).otherwise(curve)

    step = distance("_x1", "_y1", "x", "y") / dt * 25.0 * 3.6
    state = F.when(step > 20, "sprint").when(step > 8, "run").otherwise("idle")
    return rows.select(*TRACK, "at", *(linear(c).alias(c) for c in ("x", "y")), *(spline(c).alias(f"spline_{c}") for c in ("x", "y")), state.alias("state"))

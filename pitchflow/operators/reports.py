"""Composites over several operators: ball flight, highlights, match summaries, cards, fingerprints, case files."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clamp, distance
from .joins import FRAME, after_event, nearest_within
from .physical import FPS, TRACK
from .runs import first_per

GRAVITY = 9.81


def to_world_fraction(boxes: DataFrame, visible: float, frame_w: float = 1920.0, frame_h: float = 1080.0) -> DataFrame:
    """Box centres to metres by the visible share of the pitch, clamped with a 5 m margin; moved rows are flagged."""
    wx = (F.col("x1") + F.col("x2")) / 2 / frame_w * (105.0 * visible)
    wy = (F.col("y1") + F.col("y2")) / 2 / frame_h * (68.0 * visible)
    out = boxes.withColumn("_x", wx).withColumn("_y", wy).withColumn("world_x", clamp("_x", -5.0, 110.0)).withColumn("world_y", clamp("_y", -5.0, 73.0))
    return out.withColumn("corrected", (F.col("_x") != F.col("world_x")) | (F.col("_y") != F.col("world_y"))).drop("_x", "_y")


def ball_to_pitch(ball: DataFrame, frame_w: float = 3840.0, frame_h: float = 2160.0, px: str = "px", py: str = "py") -> DataFrame:
    """Ball pixels to metres by scaling."""
    return ball.withColumn("x", F.col(px) / frame_w * 105.0).withColumn("y", F.col(py) / frame_h * 68.0)


def ball_heights(ball: DataFrame) -> DataFrame:
    """Contacts cut the ball's path into arcs; arcs of 0.3 to 4 s at 8 m/s or more fly as a parabola."""
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    dt = (F.lead("frame_idx").over(w) - F.col("frame_idx")) / FPS
    b = ball.select(*FRAME, "x", "y").withColumn("vx", (F.lead("x").over(w) - F.col("x")) / dt).withColumn("vy", (F.lead("y").over(w) - F.col("y")) / dt)
    b = b.withColumn("v", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))).withColumn("s", F.avg("v").over(w.rowsBetween(-1, 1)))
    b = b.withColumns({"px": F.lag("vx").over(w), "py": F.lag("vy").over(w), "ps": F.lag("s").over(w)})
    cos = clamp((F.col("px") * F.col("vx") + F.col("py") * F.col("vy")) / (F.col("ps") * F.col("s")), -1.0, 1.0)
    hit = (F.col("ps") >= 1e-3) & (F.col("s") >= 1e-3) & F.col("v").isNotNull() & ((cos < math.cos(math.radians(45))) | (F.abs(F.col("s") - F.col("ps")) / F.col("ps") > 0.6))
    b = b.withColumn("cut", F.coalesce(hit, F.lit(False)) & F.col("px").isNotNull())
    # a contact ends one arc and starts the next; arc numbers count contacts before the row
    b = b.withColumn("arc", F.coalesce(F.sum(F.col("cut").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = b.groupBy("match_id", "arc").agg(F.max("frame_idx").alias("f1"), F.min("frame_idx").alias("first"), F.count("*").alias("n"))
    a = Window.partitionBy("match_id").orderBy("arc")
    own = own.withColumn("f0", F.coalesce(F.lag("f1").over(a), F.col("first"))).withColumn("rows", F.col("n") + F.when(F.lag("f1").over(a).isNotNull(), 1).otherwise(0))
    step = b.withColumn("step", F.coalesce(distance("x", "y", F.lag("x").over(w), F.lag("y").over(w)), F.lit(0.0)))
    metres = step.groupBy("match_id", "arc").agg(F.sum("step").alias("metres"))
    arcs = own.join(metres, ["match_id", "arc"]).withColumn("seconds", (F.col("f1") - F.col("f0")) / FPS)
    flies = (F.col("rows") >= 3) & F.col("seconds").between(0.3, 4.0) & (F.col("metres") / F.col("seconds") >= 8.0)
    out = b.select(*FRAME, "arc").join(arcs.select("match_id", "arc", "f0", "f1", flies.alias("flies")), ["match_id", "arc"])
    t, t0, t1 = (F.col(c) / FPS for c in ("frame_idx", "f0", "f1"))
    z = F.when(F.col("flies"), F.greatest(F.lit(0.0), GRAVITY / 2 * (t - t0) * (t1 - t))).otherwise(0.0)
    return out.select(*FRAME, F.round(z, 3).alias("z"))


def long_runs(points: DataFrame, least_m: float = 15.0, seconds: float = 3.0) -> DataFrame:
    """The first row of each track from which the path over the next 3 s (to the first row beyond) is 15 m or more."""
    w = Window.partitionBy(*TRACK).orderBy("frame_idx")
    p = points.withColumn("step", F.coalesce(distance("x", "y", F.lag("x").over(w), F.lag("y").over(w)), F.lit(0.0)))
    p = p.withColumn("path", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    frames = int(seconds * FPS)
    # each row asks, 3 s on, for the first row from there; asked from the end, so that window frames only grow
    rows = p.select(*TRACK, "frame_idx", "path", F.col("frame_idx").alias("_at"), F.lit(0).alias("_ask"), F.struct("frame_idx", "path").alias("_own"))
    asks = p.select(*TRACK, "frame_idx", "path", (F.col("frame_idx") + frames).alias("_at"), F.lit(1).alias("_ask"), F.lit(None).cast(rows.schema["_own"].dataType).alias("_own"))
    back = Window.partitionBy(*TRACK).orderBy(F.desc("_at"), "_ask").rowsBetween(Window.unboundedPreceding, 0)
    p = rows.unionByName(asks).withColumn("_end", F.last("_own", ignorenulls=True).over(back)).withColumn("_last", F.max("_own").over(Window.partitionBy(*TRACK))).where("_ask = 1")
    p = p.withColumn("_e", F.coalesce("_end", "_last")).withColumn("metres", F.col("_e.path") - F.col("path")).where(F.col("metres") >= least_m)
    out = first_per(p, TRACK, F.col("frame_idx"))
    return out.select(*TRACK, F.col("frame_idx").alias("start_frame"), F.col("_e.frame_idx").alias("end_frame"), F.round("metres", 5).alias("metres"), F.round(F.least(F.lit(1.0), F.col("metres") / 30), 3).alias("score"))


def penetrating_runs(points: DataFrame, seconds: float = 4.0) -> DataFrame:
    """The first row of each track behind 70 m that gets beyond 85 m within 4 s."""
    w = Window.partitionBy(*TRACK).orderBy("frame_idx").rangeBetween(1, int(seconds * FPS))
    deep = F.when(F.col("x") > 85, F.struct("frame_idx", "x"))
    p = points.withColumn("_to", F.first(deep, ignorenulls=True).over(w)).where("x < 70 AND _to IS NOT NULL")
    out = first_per(p, TRACK, F.col("frame_idx"))
    return out.select(*TRACK, F.col("frame_idx").alias("start_frame"), F.col("_to.frame_idx").alias("end_frame"), F.round(0.7 + F.least(F.lit(0.3), (F.col("_to.x") - 85) / 20), 3).alias("score"))


def bursts(points: DataFrame, least_ms: float = 8.0) -> DataFrame:
    """The peak mean of five row speeds of each track, from 8 m/s on; the earliest on ties."""
    w = Window.partitionBy(*TRACK).orderBy("frame_idx")
    p = points.withColumn("v", distance(F.lead("x").over(w), F.lead("y").over(w), "x", "y") / ((F.lead("frame_idx").over(w) - F.col("frame_idx")) / FPS)).where("v IS NOT NULL")
    p = p.withColumn("m", F.round(F.avg("v").over(w.rowsBetween(-2, 2)), 6)).withColumn("_n", F.count("v").over(w.rowsBetween(-2, 2))).where("_n = 5")
    top = p.groupBy(*TRACK).agg(F.max(F.struct("m", (-F.col("frame_idx")).alias("f"))).alias("t")).where(F.col("t.m") >= least_ms)
    return top.select(*TRACK, (-F.col("t.f")).alias("peak_frame"), F.col("t.m").alias("peak_ms"), F.round(F.least(F.lit(1.0), F.col("t.m") / 15), 3).alias("score"))


def around_ball(points: DataFrame, ball: DataFrame, near: float = 12.0, per_team: int = 4, fill: int = 8) -> DataFrame:
    """The four nearest of each team within 12 m of the ball, topped up to eight within 1.3 times that."""
    b = ball.select(*FRAME, F.col("x").alias("bx"), F.col("y").alias("by"))
    p = points.join(b, FRAME).withColumn("d", distance("x", "y", "bx", "by")).where(F.col("d") <= near * 1.3)
    team = Window.partitionBy(*FRAME, "team_id").orderBy("d", "track_id")
    p = p.withColumn("core", (F.row_number().over(team) <= per_team) & (F.col("d") <= near))
    frame = Window.partitionBy(*FRAME).orderBy(F.desc("core"), "d", "track_id")
    return p.withColumn("place", F.row_number().over(frame).cast("long")).where((F.col("place") <= fill) | F.col("core")).select(*FRAME, "track_id", "team_id", "d", "core", "place")


def nearest_mates(points: DataFrame, carrier: DataFrame, near: float = 12.0) -> DataFrame:
    """The carrier's nearest team-mate within 12 m."""
    c = carrier.select(*FRAME, "carrier", F.col("team_id").alias("_t"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    m = points.join(c, FRAME).where("team_id = _t AND track_id <> carrier").withColumn("d", distance("x", "y", "cx", "cy")).where(F.col("d") <= near)
    return m.groupBy(*FRAME, "carrier").agg(F.min(F.struct("d", "track_id")).alias("m")).select(*FRAME, "carrier", F.col("m.track_id").alias("mate"), F.col("m.d").alias("d"))


def event_windows(events: DataFrame, points: DataFrame, reach: int = 37, keep: int = 3) -> DataFrame:
    """Of the players at each event's frames to ``reach`` frames on, the three with most rows."""
    e = events.select("match_id", F.col("frame_idx").alias("event_frame"), "kind")
    n = after_event(e, points.select(*FRAME, "track_id"), reach).groupBy("match_id", "event_frame", "kind", "track_id").agg(F.count("*").alias("rows"))
    w = Window.partitionBy("match_id", "event_frame", "kind").orderBy(F.desc("rows"), "track_id")
    return n.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= keep)


def match_summary(players: DataFrame, passed: DataFrame, lost: DataFrame, shot: DataFrame, control: DataFrame, tracks_ok: DataFrame) -> DataFrame:
    """A row for each match and team: load, passes, turnovers, xG, control share; load is null where tracking isn't usable."""
    load = players.groupBy("match_id", "team_id").agg(F.sum("distance_m").alias("distance_m"), F.max("top_ms").alias("top_ms"), F.sum("sprints").alias("sprints"))
    p = passed.groupBy("match_id", "team_id").agg(F.count("*").alias("passes"))
    t = lost.groupBy("match_id", "team_id").agg(F.count("*").alias("won"))
    x = shot.where("team_id IS NOT NULL").groupBy("match_id", "team_id").agg(F.sum("xg").alias("xg"), F.count("*").alias("shots"), F.count_if(F.col("xg") >= 0.15).alias("big_chances"))
    w = Window.partitionBy("match_id")
    c = control.where("team_id IS NOT NULL").groupBy("match_id", "team_id").agg(F.count("*").alias("_n")).withColumn("control", F.col("_n") / F.sum("_n").over(w)).drop("_n")
    key = ["match_id", "team_id"]
    out = load.join(p, key, "left").join(t, key, "left").join(x, key, "left").join(c, key, "left").join(tracks_ok, "match_id", "left")
    out = out.na.fill(0, ["passes", "won", "shots", "big_chances"]).na.fill(0.0, ["xg", "control"])
    return out.select(*key, *(F.when(F.col("usable"), F.round(k, 4)).alias(k) for k in ("distance_m", "top_ms", "sprints")), "passes", "won", F.round("xg", 4).alias("xg"), "shots", "big_chances", F.round("control", 6).alias("control"))


def report_card(players: DataFrame, passed: DataFrame, carried: DataFrame, lost: DataFrame) -> DataFrame:
    """Load and event counts of each player."""
    made = passed.groupBy("match_id", F.col("passer").alias("track_id")).agg(F.count("*").alias("made"))
    got = passed.groupBy("match_id", F.col("receiver").alias("track_id")).agg(F.count("*").alias("received"))
    run = carried.groupBy("match_id", F.col("player").alias("track_id")).agg(F.count("*").alias("carries"))
    won = lost.groupBy("match_id", F.col("player").alias("track_id")).agg(F.count("*").alias("won"))
    out = players.select(*TRACK, "team_id", F.round("distance_m", 3).alias("distance_m"), "sprints")
    for extra in (made, got, run, won):
        out = out.join(extra, TRACK, "left")
    return out.na.fill(0, ["made", "received", "carries", "won"])


def fingerprint(widths: DataFrame, sprints: DataFrame, phases: DataFrame, speeds: DataFrame) -> DataFrame:
    """Over matches, by team: mean width, mean sprints (from two on), the most frequent main phase, upper-median top speed."""
    width = widths.groupBy("team_id").agg(F.round(F.avg("width"), 4).alias("width"))
    s = sprints.groupBy("team_id").agg(F.when(F.count("*") >= 2, F.round(F.avg("sprints"), 4)).alias("sprints"))
    at = Window.partitionBy("team_id").orderBy("top_ms")
    ranked = speeds.select("team_id", "top_ms", F.row_number().over(at).alias("_rn"), F.count("*").over(Window.partitionBy("team_id")).alias("_n"))
    top = ranked.where(F.col("_rn") == F.floor(F.col("_n") / 2) + 1).select("team_id", "top_ms")
    main = phases.groupBy("match_id").agg(F.max(F.struct("frames", "label")).alias("m")).groupBy(F.col("m.label").alias("label")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "label")).alias("m")).select(F.col("m.label").alias("phase"))
    return width.join(s, "team_id").join(top, "team_id").crossJoin(F.broadcast(main))  # one row


def case_files(found: DataFrame, points: DataFrame, offsets: tuple[int, ...] = (-10, -5, 0, 5, 10)) -> DataFrame:
    """For each conflict frame the players at offsets around it (within two frames), as counts and mean places."""
    at = found.select("match_id", F.col("frame_idx").alias("conflict_frame")).distinct().withColumn("offset", F.explode(F.array(*map(F.lit, offsets)))).withColumn("frame_idx", F.col("conflict_frame") + F.col("offset"))
    near = nearest_within(at.select(*FRAME).distinct(), points, ["track_id"], 2)
    met = at.join(near, FRAME)
    return met.groupBy("match_id", "conflict_frame", "offset").agg(F.count("*").alias("players"), F.round(F.avg("x"), 6).alias("mean_x"), F.round(F.avg("y"), 6).alias("mean_y"))


#: Frames that a service needs, and the services that need world coordinates.
MINIMUM_FRAMES = {"pass_network": 150, "pressing": 150, "xg": 75, "formations": 75, "heatmaps": 50, "events": 150, "counter_press": 150, "set_pieces": 500, "defensive_lines": 50, "tactics": 75}
WORLD_SERVICES = ("pass_network", "pressing", "events", "counter_press", "set_pieces", "defensive_lines", "xg")


def service_confidence(quality: DataFrame, matches: DataFrame, tracks: DataFrame, ball: DataFrame, homographies: DataFrame) -> DataFrame:
    """For each match and service whether its result can be used, with which confidence, and what speaks against it.

    ``quality`` has id_switches, mean_length and stable of each match (A22).
    """
    seen = ball.groupBy("match_id").agg(F.count("*").alias("_ball"))
    mapped = homographies.groupBy("match_id").agg(F.count("*").alias("_maps"))
    teams = tracks.groupBy("match_id").agg(F.count_if(F.expr("team_id = 0")).alias("_t0"), F.count_if(F.expr("team_id = 1")).alias("_t1"))
    m = matches.select("match_id", "frames_processed", "valid_frames").join(quality.select("match_id", "id_switches", "mean_length", "stable"), "match_id")
    for other in (seen, mapped, teams):
        m = m.join(other, "match_id", "left")
    m = m.na.fill(0, ["_ball", "_maps", "_t0", "_t1"])
    needs = F.explode(F.array(*[F.struct(F.lit(k).alias("service"), F.lit(v).alias("frames_required"), F.lit(k in WORLD_SERVICES).alias("_world")) for k, v in MINIMUM_FRAMES.items()]))
    m = m.withColumn("_n", needs).select("*", "_n.*").drop("_n")
    frames, least = F.col("frames_processed"), F.col("frames_required")
    invalid = F.col("valid_frames") / frames < 0.5
    calibrated, ball_there = F.col("_maps") > 0, F.col("_ball") / frames >= 0.05
    reasons = F.array_compact(F.array(
        F.when(invalid, "invalid_frames"), F.when(F.col("id_switches") > 50, "id_churn"), F.when(F.col("mean_length") < 10, "short_tracks"), F.when(F.col("stable") < 10, "few_stable_tracks"), F.when(frames < least, "few_frames"),
        F.when(~calibrated, "no_calibration"), F.when((F.col("_ball") > 0) & ~ball_there, "ball_coverage"), F.when(~ball_there & calibrated, "no_ball"), F.when(F.greatest("_t0", "_t1") / F.nullif(F.col("_t0") + F.col("_t1"), F.lit(0)) > 0.70, "team_imbalance"),
    ))
    blind = F.col("_world") & (~calibrated | ~ball_there)
    level = F.when(invalid, "low").when(blind | (frames < least * 0.5), "unavailable").when(frames < least, "low").when(F.size(reasons) > 0, "medium").otherwise("high")
    usable = F.when(invalid, frames >= least * 0.5).otherwise(level != "unavailable")
    return m.select("match_id", "service", "frames_required", level.alias("confidence"), usable.alias("usable"), F.array_join(reasons, "+").alias("reasons"))


def report_quality(players: DataFrame, tracks: DataFrame, matches: DataFrame, homographies: DataFrame, stride: int = 5, collapse: int = 8) -> DataFrame:
    """The quality block of a match report, one row a match.

    Locked share of assignments, share of lost locks that were revived, id switches a minute, coverage by known ids and by
    homographies (of every ``stride``-th frame), share of frames with under ``collapse`` players, and their weighted mix.
    """
    by = Window.partitionBy("match_id", "player_id").orderBy("frame_idx", "raw_track_id")
    rows = players.where("NOT is_official").withColumn("_p", F.lag("assignment_source").over(by)).withColumn("_r", F.lag("raw_track_id").over(by))
    source = F.col("assignment_source")
    m = rows.groupBy("match_id").agg(
        F.avg((source == "locked").cast("double")).alias("stable_ids"), F.count_if((source == "revived") & (F.col("_p") != "revived")).alias("_revived"), F.count_if((F.col("_p") == "locked") & (source == "unassigned")).alias("_expired"),
        F.count_if(F.col("_r") != F.col("raw_track_id")).alias("_switches"), F.avg((source != "unassigned").cast("double")).alias("valid_id_coverage"), F.count_if(source == "unassigned").alias("unknown_boxes"), F.count_distinct("player_id").alias("unique_ids"),
    )
    thin = rows.groupBy(*FRAME).agg(F.count("*").alias("n")).groupBy("match_id").agg(F.count_if(F.col("n") < collapse).alias("_thin"))
    teams = tracks.groupBy("match_id").agg(F.avg(F.col("team_id").isin(0, 1, 2).cast("double")).alias("team_assignment"))
    maps = homographies.groupBy("match_id").agg(F.count_distinct("frame_idx").alias("_maps"))
    out = matches.select("match_id", "fps", F.col("frames_processed").alias("_f")).join(m, "match_id").join(thin, "match_id").join(teams, "match_id").join(maps, "match_id", "left")
    pitch = F.least(F.lit(1.0), F.coalesce("_maps", F.lit(0)) / F.greatest(F.lit(1), F.floor(F.col("_f") / stride)))
    out = out.withColumn("pitch_coverage", F.round(pitch, 3)).withColumn("soft_collapse", F.round(F.col("_thin") / F.col("_f"), 3)).withColumn("stable_ids", F.round("stable_ids", 3))
    mixed = 0.35 * F.col("stable_ids") + 0.25 * F.col("valid_id_coverage") + 0.20 * F.col("pitch_coverage") + 0.20 * (1.0 - F.least(F.lit(1.0), F.col("soft_collapse")))
    lost = F.col("_revived") + F.col("_expired")
    return out.select(
        "match_id", "stable_ids", F.round(F.when(lost > 0, F.col("_revived") / lost).otherwise(0.0), 3).alias("resurrection"), F.round(F.col("_switches") * 60.0 / (F.col("_f") / F.col("fps")), 3).alias("switches_a_minute"),
        F.round("team_assignment", 3).alias("team_assignment"), "pitch_coverage", F.round(mixed, 3).alias("confidence"), F.round("valid_id_coverage", 6).alias("valid_id_coverage"), "soft_collapse", "unique_ids", "unknown_boxes",
    )


def report_teams(tracks: DataFrame) -> DataFrame:
    """Players of each side; keepers go one each to the side with fewer players first, the rest to the home side."""
    gk = F.col("role") == "goalkeeper"
    n = tracks.groupBy("match_id").agg(F.count_if(~gk & (F.col("team_id") == 0)).alias("_h"), F.count_if(~gk & (F.col("team_id") == 1)).alias("_a"), F.count_if(gk).alias("_g"))
    first = (F.col("_h") <= F.col("_a")).cast("int")  # the home side takes the first keeper
    home_one = F.when(F.col("_g") == 0, 0).when(first == 1, 1).otherwise(0)
    left = F.col("_g") - home_one
    away_one = F.least(left, F.lit(1))
    return n.select("match_id", (F.col("_h") + home_one + left - away_one).alias("home_players"), (F.col("_a") + away_one).alias("away_players"))


def report_players(players: DataFrame) -> DataFrame:
    """A player's line: side, metres, sprints, top speed."""
    side = F.when(F.col("team_id") == 0, "home").when(F.col("team_id") == 1, "away")
    return players.select(*TRACK, F.concat(F.lit("P"), F.col("track_id")).alias("player_id"), side.alias("team"), F.round("distance_m", 1).alias("distance_m"), "sprints", F.round(F.col("top_ms") * 3.6, 2).alias("top_speed_kmh"))


def report_events(events: DataFrame, fps: float = FPS) -> DataFrame:
    """Events in order, with their second."""
    w = Window.partitionBy("match_id").orderBy("frame_idx", "kind", "team_id")
    return events.select("match_id", F.row_number().over(w).cast("long").alias("place"), F.col("frame_idx").alias("frame"), F.round(F.col("frame_idx") / fps, 2).alias("timestamp_s"), F.col("kind").alias("type"), "team_id")


def run_report(services: DataFrame, counts: DataFrame) -> DataFrame:
    """Each service of a match with its confidence (A21) and what it found; what isn't usable counts nothing."""
    out = services.join(counts, ["match_id", "service"], "left")
    status = F.when(~F.col("usable"), "unavailable").when(F.coalesce("found", F.lit(0)) == 0, "empty").otherwise("complete")
    return out.select("match_id", "service", "confidence", status.alias("status"), F.when(F.col("usable"), F.coalesce("found", F.lit(0))).otherwise(0).alias("found"), "reasons")

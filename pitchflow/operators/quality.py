"""Tracking quality, sanity limits, reports and trends over matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clock
from .helpers import trend
from .joins import FRAME
from .physical import TRACK
from .runs import with_run


def id_switches(players: DataFrame) -> DataFrame:
    """Changes of raw track within a player's rows, by match."""
    w = Window.partitionBy("match_id", "player_id").orderBy("frame_idx", "raw_track_id")
    rows = players.where("player_id IS NOT NULL AND NOT is_official").withColumn("_p", F.lag("raw_track_id").over(w))
    return rows.groupBy("match_id").agg(F.count_if(F.col("_p") != F.col("raw_track_id")).alias("id_switches"))


def tracking_quality(points: DataFrame, tracks: DataFrame, matches: DataFrame, players: DataFrame) -> DataFrame:
    """Ids, id switches, mean length, short and stable tracks, sudden drops of over five players, team balance, valid frames."""
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    n = points.groupBy(*FRAME).agg(F.count("*").alias("n")).withColumn("_drop", F.lag("n").over(w) - F.col("n") > 5)
    drops = n.groupBy("match_id").agg(F.count_if("_drop").alias("drops"), F.avg("n").alias("mean_players"))
    t = tracks.groupBy("match_id").agg(
        F.count_distinct("track_id").alias("ids"), F.avg("hits").alias("mean_length"), F.count_if(F.expr("hits < 5")).alias("short"), F.count_if(F.expr("hits >= 5")).alias("stable"),
        (F.least(F.count_if(F.expr("team_id = 0")), F.count_if(F.expr("team_id = 1"))) / F.greatest(F.count_if(F.expr("team_id = 0")), F.count_if(F.expr("team_id = 1")))).alias("balance"),
    )
    v = matches.select("match_id", (F.col("valid_frames") / F.col("frames_processed")).alias("valid_share"))
    return t.join(drops, "match_id").join(v, "match_id").join(id_switches(players), "match_id", "left").na.fill(0, ["id_switches"])


def frame_health(points: DataFrame) -> DataFrame:
    """Per frame a health of 0 to 1 by the number of tracks, less after a sudden change, and the camera's mode.

    From ten tracks on 1, from five on 0.6 and more, from one on 0.3 and more; times 0.7 if the number changed by over four since
    the frame before, 0.4 by over eight.
    """
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    n = points.groupBy(*FRAME).agg(F.count("*").alias("n")).withColumn("_by", F.abs(F.col("n") - F.lag("n").over(w)))
    base = F.when(F.col("n") >= 10, 1.0).when(F.col("n") >= 5, 0.6 + (F.col("n") - 5) / 12.5).otherwise(0.3 + (F.col("n") - 1) / 13.3)
    steady = F.when(F.col("_by") > 8, 0.4).when(F.col("_by") > 4, 0.7).otherwise(1.0)
    mode = F.when(F.col("n") < 3, "close_up").when(F.col("n") < 8, "medium_broadcast").otherwise("wide_broadcast")
    return n.select(*FRAME, F.round(F.least(base * steady, F.lit(1.0)), 3).alias("health"), mode.alias("camera"))


def observed(points: DataFrame, matches: DataFrame) -> DataFrame:
    """Every frame of a match with tracks n, health, camera (cut without any track) and phase.

    A frame with eight tracks or more speaks for open_play, one with under two and a health under 0.3 for dead_ball, others for nothing. The phase
    is what three frames on end said last, unknown before: what speaks for nothing keeps the phase, and starts the count anew.
    """
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    frames = matches.select("match_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames_processed") - 1)).alias("frame_idx"))
    rows = frames.join(points.groupBy(*FRAME).agg(F.count("*").alias("n")), FRAME, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    rows = rows.withColumn("was", F.lag("n").over(w)).withColumn("_by", F.abs(F.col("n") - F.col("was")))
    base = F.when(F.col("n") >= 10, 1.0).when(F.col("n") >= 5, 0.6 + (F.col("n") - 5) / 12.5).otherwise(0.3 + (F.col("n") - 1) / 13.3)
    steady = F.when(F.col("_by") > 8, 0.4).when(F.col("_by") > 4, 0.7).otherwise(1.0)
    health = F.round(F.least(base * steady, F.lit(1.0)), 3)
    rows = rows.withColumn("health", F.when(F.col("n") == 0, 0.1).when(F.col("n") < 3, F.least(health, F.lit(0.4))).otherwise(health))
    rows = rows.withColumn("camera", F.when(F.col("n") == 0, "cut").when(F.col("n") < 3, "close_up").when(F.col("n") < 8, "medium_broadcast").otherwise("wide_broadcast"))
    rows = rows.withColumn("_says", F.when((F.col("n") < 2) & (F.col("health") < 0.3), "dead_ball").when(F.col("n") >= 8, "open_play"))
    sure = F.when((F.col("_says") == F.lag("_says").over(w)) & (F.col("_says") == F.lag("_says", 2).over(w)), F.col("_says"))
    rows = rows.withColumn("_sure", sure).withColumn("phase", F.coalesce(F.last("_sure", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("unknown")))
    return rows.select(*FRAME, "n", "was", "health", "camera", "phase")


def match_phases(seen: DataFrame, fps: float = 25.0) -> DataFrame:
    """Runs of one phase with their first second, the second at which the next one starts (the last: its last frame's) and mean health."""
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    rows = with_run(seen, ["match_id"], "frame_idx", ~F.col("phase").eqNullSafe(F.lag("phase").over(w)))
    runs = rows.groupBy("match_id", "run", "phase").agg(F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"), F.round(F.avg("health"), 4).alias("health"))
    following = F.lead("first").over(Window.partitionBy("match_id").orderBy("run"))
    return runs.select("match_id", "run", "phase", F.round(F.col("first") / fps, 1).alias("start_s"), F.round(F.coalesce(following, F.col("last")) / fps, 1).alias("end_s"), "health")


def anomalies(seen: DataFrame, points: DataFrame, speeds: DataFrame, wide: float = 68.0) -> DataFrame:
    """(match_id, frame_idx, anomaly, subject): interrupted camera, a jump of the number of tracks by over eight, over 25 tracks, a track over 10 m/s, a team
    wider than the pitch; the last as long as the team's width, taken where three of its tracks are seen by a camera that isn't near, stays so.
    """
    shape = points.where(F.col("team_id").isin(0, 1)).groupBy(*FRAME, "team_id").agg(F.count("*").alias("_n"), F.round(F.max("x") - F.min("x"), 1).alias("_w"))
    teams = seen.select(*FRAME, "camera", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("team_id")).join(shape, [*FRAME, "team_id"], "left")
    width = F.when((F.col("_n") >= 3) & ~F.col("camera").isin("cut", "close_up"), F.col("_w"))
    up_to = Window.partitionBy("match_id", "team_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    teams = teams.withColumn("_wide", F.last(width, ignorenulls=True).over(up_to))
    one = lambda rows, name, who: rows.select(*FRAME, F.lit(name).alias("anomaly"), who.cast("string").alias("subject"))
    parts = [
        one(seen.where("n = 0"), "camera_interruption", F.lit(None)), one(seen.where("abs(n - was) > 8"), "track_instability", F.concat_ws("-", "was", "n")), one(seen.where("n > 25"), "overcounting", F.col("n")),
        one(speeds.where("speed_ms > 10"), "speed_spike", F.col("track_id")), one(teams.where(F.col("_wide") > wide), "geometry_unreliable", F.col("team_id")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


def best_worst_runs(health: DataFrame, size: int = 10) -> DataFrame:
    """Starts of the best and worst run of ten rows; the earliest on ties."""
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    runs = health.withColumn("h", F.round(F.avg("health").over(w.rowsBetween(0, size - 1)), 6)).withColumn("_n", F.count("*").over(w.rowsBetween(0, size - 1))).where(F.col("_n") == size)
    return runs.groupBy("match_id").agg(F.max(F.struct("h", (-F.col("frame_idx")).alias("f"))).alias("b"), F.min(F.struct("h", "frame_idx")).alias("w")).select("match_id", F.col("b.h").alias("best"), (-F.col("b.f")).alias("best_start"), F.col("w.h").alias("worst"), F.col("w.frame_idx").alias("worst_start"))


def track_confidence(tracks: DataFrame) -> DataFrame:
    """0.5, changed by detections, merges and continuity of a track; level high from 0.8, medium from 0.5; with reasons."""
    hits, merges = F.col("hits"), F.coalesce("reid_merges", F.lit(0))
    continuity = F.least(hits / F.greatest(F.col("last_seen") - F.col("first_seen"), F.lit(1)), F.lit(1.0))
    score = F.lit(0.5) + F.when(hits >= 20, 0.25).when(hits >= 10, 0.10).otherwise(-0.20) + F.when(merges <= 1, 0.15).when(merges <= 3, 0.05).otherwise(-0.15) + F.when(continuity >= 0.70, 0.10).when(continuity >= 0.40, 0.0).otherwise(-0.10)
    reasons = F.array_compact(F.array(
        F.when(hits < 10, F.format_string("only %d detections", hits)), F.when(merges > 3, F.format_string("%d merges (high fragmentation)", merges)).when(merges > 1, F.format_string("%d merges", merges)),
        F.when(continuity < 0.40, F.format_string("visible in only %d%% of expected frames", F.round(continuity * 100).cast("int"))),
    ))
    out = tracks.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2))
    level = F.when(F.col("score") >= 0.8, "high").when(F.col("score") >= 0.5, "medium").otherwise("low")
    return out.select(*TRACK, "score", level.alias("level"), F.round(continuity, 2).alias("continuity"), F.array_join(reasons, "; ").alias("reasons"))


#: Percent of error of a speed and a distance, and sprints more or less, by level; low sprints are a range.
MARGINS = {"speed": {"high": 10, "medium": 20, "low": 35}, "distance": {"high": 12, "medium": 25, "low": 40}}
SPRINT_MARGIN = {"high": 1, "medium": 3}


def metric_display(metrics: DataFrame) -> DataFrame:
    """Rows (match_id, track_id, metric, value, level) with margin_of_error and display; nothing is shown of nulls and zeros."""
    value, level, kind = F.col("value"), F.col("level"), F.col("metric")
    pct = F.lit(30)
    for name, by in MARGINS.items():
        for lv, p in by.items():
            pct = F.when((kind == name) & (level == lv), p).otherwise(pct)
    count = F.floor(value).cast("int")
    sprints = F.when(level == "low", F.format_string("%d-%d sprints", F.greatest(count - 3, F.lit(0)), count + 3)).otherwise(F.format_string("%d ±%d sprints", count, F.when(level == "high", 1).otherwise(3)))
    other = F.concat(F.format_string("%.1f", value), F.when(kind == "speed", " km/h").otherwise(" m"), F.format_string(" ±%d%%", pct))
    none = value.isNull() | (value == 0)
    margin = F.when(none, "N/A").when(kind == "sprint_count", F.when(level == "low", "±3 (range)").when(level == "high", "±1").otherwise("±3")).otherwise(F.format_string("±%d%%", pct))
    shown = F.when(none, "data insufficient").when(kind == "sprint_count", sprints).otherwise(other)
    return metrics.select(*TRACK, "metric", F.when(none, "low").otherwise(level).alias("confidence"), margin.alias("margin_of_error"), shown.alias("display"))


#: What a body, a team and a match can do.
TOP_MS, METRES_A_SECOND, PPDA, LINE_DEPTH, PASSES_A_MINUTE = 12.0, 9.0, (1.0, 50.0), (0.0, 105.0), 60.0


def _without(df: DataFrame, bad: list) -> DataFrame:
    """Columns whose test fails become null; failures lists them, ready tells that there are none."""
    bad = [(name, F.coalesce(test, F.lit(False))) for name, test in bad]
    out = df.withColumn("failures", F.array_join(F.array_compact(F.array(*[F.when(b, name) for name, b in bad])), "+"))
    return out.withColumns({name: F.when(~b, F.col(name)) for name, b in bad}).withColumn("ready", F.col("failures") == "")


def sane(players: DataFrame, matches: DataFrame) -> DataFrame:
    """A25 for players: a top speed over 12 m/s, or more metres than 9 a second of the match, become null."""
    rows = players.join(matches.select("match_id", (F.col("frames_processed") / F.col("fps")).alias("seconds")), "match_id")
    return _without(rows, [("distance_m", F.col("distance_m") > METRES_A_SECOND * F.col("seconds")), ("top_ms", F.col("top_ms") > TOP_MS)]).drop("seconds")


def sane_matches(summary: DataFrame) -> DataFrame:
    """A25 for teams of matches (ppda, line_depth, passes, seconds): PPDA off 1 to 50, lines off the pitch, over 60 passes a minute become null."""
    ppda, depth = F.col("ppda"), F.col("line_depth")
    return _without(summary, [("ppda", ~ppda.between(*PPDA)), ("line_depth", ~depth.between(*LINE_DEPTH)), ("passes", F.col("passes") / (F.col("seconds") / 60) > PASSES_A_MINUTE)])


def agreement(runs: DataFrame) -> DataFrame:
    """Over runs of one key, the median and whether all values are within 10 % of the largest."""
    out = runs.groupBy("match_id", "track_id").agg(F.median("value").alias("median"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    return out.withColumn("confirmed", F.when(F.col("_hi") == 0, True).otherwise((F.col("_hi") - F.col("_lo")) / F.col("_hi") <= 0.1)).drop("_lo", "_hi")


def event_counts(events: DataFrame) -> DataFrame:
    """Counts of event kinds by team, as a pivot with fixed kinds."""
    return events.groupBy("match_id", "team_id").pivot("kind", ["pass", "turnover", "carry", "shot"]).agg(F.count("frame_idx")).na.fill(0, ["pass", "turnover", "carry", "shot"])


def feed(events: DataFrame) -> DataFrame:
    """The match feed: mm:ss, kind and team in order."""
    w = Window.partitionBy("match_id").orderBy("frame_idx", "kind", "team_id")
    return events.select("match_id", F.row_number().over(w).cast("long").alias("line"), clock(F.col("frame_idx") / 25.0).alias("clock"), "kind", "team_id")


def development(appearances: DataFrame) -> DataFrame:
    """Trend of a player's values over matches by date: slope, R2, direction beyond 5 % of the mean, next value, consistency.

    Values are tenths, so slopes and means are often just on an edge, where the last bit decides: they are added up and rounded as the SQL does it.
    """
    rows = appearances.where("confidence IN ('high', 'medium')").withColumn("_i", F.row_number().over(Window.partitionBy("player_id").orderBy("date", "match_id")).cast("double"))
    own = rows.where("value > 0").groupBy("player_id").agg(F.array_sort(F.collect_list(F.struct("_i", "value"))).alias("v")).where(F.size("v") >= 2)
    out = own.select("player_id", F.size("v").cast("long").alias("n"), trend()("v").alias("t")).select("player_id", "n", "t.*")
    direction = F.when(F.col("slope") / F.col("mean") > 0.05, "improving").when(F.col("slope") / F.col("mean") < -0.05, "declining").otherwise("stable")
    near = lambda c, digits: F.round(c * 10.0**digits) / 10.0**digits
    return out.select("player_id", "n", near(F.col("slope"), 4).alias("slope"), near(F.col("r2"), 4).alias("r2"), direction.alias("direction"), near(F.greatest(F.lit(0.0), F.col("last") + F.col("slope")), 3).alias("next"), near(1 - F.col("sd") / F.col("mean"), 4).alias("consistency"))


def first_last(appearances: DataFrame) -> DataFrame:
    """Last against first value by date."""
    order = F.struct("date", "match_id")
    out = appearances.groupBy("player_id").agg(F.min_by("value", order).alias("first"), F.max_by("value", order).alias("last"), F.count("*").alias("n"))
    return out.withColumn("change", F.col("last") - F.col("first"))


def sound_matches(matches: DataFrame, sprints: int = 50, kmh: float = 36.0, width: float = 70.0) -> DataFrame:
    """Matches (sprints, max_kmh, width) with ``corrupted``: more sprints, speed or width than a match can have."""
    bad = (F.col("sprints") > sprints) | (F.col("max_kmh") > kmh) | (F.col("width") > width)
    return matches.withColumn("corrupted", F.coalesce(bad, F.lit(False)))

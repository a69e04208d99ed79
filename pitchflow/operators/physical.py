"""Physical load: steps, sprints, distances, heatmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance

FPS = 25.0
TRACK = ["match_id", "track_id"]


def over_track() -> Window:
    return Window.partitionBy(*TRACK).orderBy("frame_idx")


def steps(points: DataFrame) -> DataFrame:
    """Each row's step to the next: dt_s, step_m, speed_ms (null if invalid), spikes replaced by the local median."""
    w = over_track()
    out = points.withColumn("_nf", F.lead("frame_idx").over(w)).withColumn("_nx", F.lead("x").over(w)).withColumn("_ny", F.lead("y").over(w))
    out = out.withColumn("dt_s", (F.col("_nf") - F.col("frame_idx")) / FPS).withColumn("step_m", distance("_nx", "_ny", "x", "y"))
    ok = (F.col("dt_s") > 0) & (F.col("dt_s") <= 2) & (F.col("step_m") <= 3 * (F.col("_nf") - F.col("frame_idx")))
    out = out.withColumn("raw_ms", F.when(ok, F.least(F.col("step_m") / F.col("dt_s"), F.lit(12.0))))
    valid = out.where("raw_ms IS NOT NULL")
    valid = valid.withColumn("_med", F.percentile("raw_ms", F.lit(0.5)).over(w.rowsBetween(-5, 5)))
    valid = valid.withColumn("speed_ms", F.when(F.col("raw_ms") > 3 * F.col("_med"), F.col("_med")).otherwise(F.col("raw_ms")))
    rest = out.where("raw_ms IS NULL").withColumn("speed_ms", F.lit(None).cast("double"))
    keep = ["match_id", "track_id", "team_id", "frame_idx", "x", "y", "dt_s", "step_m", "speed_ms"]
    return valid.select(*keep).unionByName(rest.select(*keep))


def sprint_bursts(stepped: DataFrame) -> DataFrame:
    """Bursts above 7 m/s; one ends when three rows below, or invalid, follow each other."""
    rows = stepped.withColumn("_rn", F.row_number().over(over_track()))
    fast = rows.where("speed_ms > 7.0").withColumn("_gap", F.col("_rn") - F.lag("_rn").over(over_track()))
    fast = fast.withColumn("burst", F.sum(F.when(F.col("_gap").isNull() | (F.col("_gap") > 3), 1).otherwise(0)).over(over_track().rowsBetween(Window.unboundedPreceding, 0)))
    return fast.groupBy(*TRACK, "burst").agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.count("*").alias("fast_rows"), F.max("speed_ms").alias("peak_ms"))


def high_intensity_runs(stepped: DataFrame, threshold: float = 5.5) -> DataFrame:
    """Rising edges at the threshold, and the top of the one-second rolling maximum."""
    above = F.coalesce(F.col("speed_ms") >= threshold, F.lit(False))
    rows = stepped.withColumn("_hi", above)
    rows = rows.withColumn("_edge", F.col("_hi") & ~F.coalesce(F.lag("_hi").over(over_track()), F.lit(False)))
    rows = rows.withColumn("_roll", F.max("speed_ms").over(Window.partitionBy(*TRACK).orderBy("frame_idx").rangeBetween(-25, 0)))
    return rows.groupBy(*TRACK).agg(F.count_if("_edge").alias("runs"), F.max("_roll").alias("top_ms"))


def block_speed(points: DataFrame, block: int = 5) -> DataFrame:
    """km/h over blocks of frames from first to last row of each, and distance so far."""
    b = points.withColumn("block", F.floor(F.col("frame_idx") / block)).groupBy(*TRACK, "block").agg(
        F.min("frame_idx").alias("f0"), F.max("frame_idx").alias("f1"), F.min_by(F.struct("x", "y"), "frame_idx").alias("a"), F.max_by(F.struct("x", "y"), "frame_idx").alias("z")
    ).where("f1 > f0")
    b = b.withColumn("metres", distance("a.x", "a.y", "z.x", "z.y")).withColumn("speed_kmh", F.col("metres") / ((F.col("f1") - F.col("f0")) / FPS) * 3.6)
    w = Window.partitionBy(*TRACK).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn("total_m", F.sum("metres").over(w)).select(*TRACK, "block", "speed_kmh", "total_m")


def player_table(stepped: DataFrame, bursts: DataFrame) -> DataFrame:
    """A2: distance, sprint and high-intensity distance, top and mean speed, sprints of each player."""
    valid = F.col("speed_ms").isNotNull()
    metres = F.col("speed_ms") * F.col("dt_s")
    per = stepped.groupBy("match_id", "track_id", "team_id").agg(
        F.sum(F.when(valid, metres)).alias("distance_m"),
        F.sum(F.when(F.col("speed_ms") > 7, metres).otherwise(0.0)).alias("sprint_m"),
        F.sum(F.when(F.col("speed_ms") > 5.5, metres).otherwise(0.0)).alias("high_intensity_m"),
        F.max("speed_ms").alias("top_ms"), F.avg("speed_ms").alias("mean_ms"),
    )
    n = bursts.groupBy(*TRACK).agg(F.count("*").alias("sprints"))
    return per.join(n, TRACK, "left").withColumn("sprints", F.coalesce("sprints", F.lit(0)))


def totals(players: DataFrame) -> DataFrame:
    """A3: player, team and match levels in one pass of grouping sets."""
    out = players.rollup("match_id", "team_id", "track_id").agg(F.sum("distance_m").alias("distance_m"), F.max("top_ms").alias("top_ms"), F.sum("sprints").alias("sprints"), F.count("*").alias("players"), F.grouping_id().alias("level"))
    return out.where("match_id IS NOT NULL")


def heatmap(points: DataFrame, by: list[str], columns: int = 21, rows: int = 14) -> DataFrame:
    """A1: points of each grid cell and their share of the fullest cell of the key."""
    cell_x = F.least(F.greatest(F.floor(F.col("x") / 105.0 * columns), F.lit(0)), F.lit(columns - 1)).alias("col")
    cell_y = F.least(F.greatest(F.floor(F.col("y") / 68.0 * rows), F.lit(0)), F.lit(rows - 1)).alias("row")
    cells = points.select(*by, cell_x, cell_y).groupBy(*by, "col", "row").agg(F.count("*").alias("n"))
    return cells.withColumn("heat", F.col("n") / F.max("n").over(Window.partitionBy(*by)))


def team_summary(players: DataFrame) -> DataFrame:
    """A5: team sums, top sprinter and top runner."""
    order = lambda c: F.struct(c, -F.col("track_id"))
    return players.groupBy("match_id", "team_id").agg(
        F.sum("distance_m").alias("distance_m"), F.avg("distance_m").alias("mean_distance_m"), F.max("top_ms").alias("top_ms"),
        F.max_by("track_id", order("sprints")).alias("top_sprinter"), F.max_by("track_id", order(F.round("distance_m", 3))).alias("top_runner"),
    )


def ball_speed(ball: DataFrame) -> DataFrame:
    """Mean of five positions, then central difference in m/s, capped at 40."""
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    s = ball.withColumn("sx", F.avg("x").over(w.rowsBetween(-2, 2))).withColumn("sy", F.avg("y").over(w.rowsBetween(-2, 2)))
    s = s.withColumn("_dt", (F.lead("frame_idx").over(w) - F.lag("frame_idx").over(w)) / FPS)
    d = distance(F.lead("sx").over(w), F.lead("sy").over(w), F.lag("sx").over(w), F.lag("sy").over(w))
    return s.withColumn("speed_ms", F.when(F.col("_dt") > 0, F.least(d / F.col("_dt"), F.lit(40.0))).otherwise(0.0)).drop("_dt")


def position_label(points: DataFrame) -> DataFrame:
    """Mean x by thirds in the direction of attack."""
    ahead: Column = F.when(F.col("team_id") == 0, F.col("x")).otherwise(105.0 - F.col("x"))
    out = points.groupBy("match_id", "track_id", "team_id").agg(F.avg(ahead).alias("mean_x"))
    return out.withColumn("position", F.when(F.col("mean_x") < 35, "Defender").when(F.col("mean_x") < 70, "Midfielder").otherwise("Forward"))

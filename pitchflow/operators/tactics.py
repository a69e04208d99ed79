"""Shape, lines, space and situations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance
from .helpers import nearest_share, press_geometry
from .joins import FRAME
from .runs import changes, cooldown, with_run

#: Known formations as defenders, midfielders, forwards, in order of preference.
FORMATIONS = ((4, 4, 2), (4, 3, 3), (3, 5, 2), (5, 3, 2), (4, 5, 1), (3, 4, 3), (5, 4, 1), (4, 2, 4), (3, 6, 1))


def without_keeper(rows: DataFrame, by: list[str], least: int) -> DataFrame:
    """Drops each group's deepest player; groups of fewer than ``least`` are dropped."""
    deep = F.when(F.col("team_id") == 0, F.col("x")).otherwise(-F.col("x"))
    out = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(deep, "track_id")))
    return out.where((F.col("_n") >= least) & (F.col("_rn") > 1)).drop("_n", "_rn")


def with_lines(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds line (def, mid, att) by the 33rd and 66th percentiles of x, in the direction of attack."""
    p = rows.groupBy(*by).agg(F.percentile("x", F.lit(0.33)).alias("_p33"), F.percentile("x", F.lit(0.66)).alias("_p66"))
    out = rows.join(p, by)
    zero = F.when(F.col("x") <= F.col("_p33"), "def").when(F.col("x") <= F.col("_p66"), "mid").otherwise("att")
    one = F.when(F.col("x") >= F.col("_p66"), "def").when(F.col("x") >= F.col("_p33"), "mid").otherwise("att")
    return out.withColumn("line", F.when(F.col("team_id") == 0, zero).otherwise(one)).drop("_p33", "_p66")


def defensive_lines(points: DataFrame) -> DataFrame:
    """Per frame and team the depth of the last line, width and length of the outfield."""
    by = ["match_id", "frame_idx", "team_id"]
    rows = with_lines(without_keeper(points, by, 4), by)
    depth = F.avg(F.when(F.col("line") == "def", F.when(F.col("team_id") == 0, F.col("x")).otherwise(105 - F.col("x"))))
    return rows.groupBy(*by).agg(depth.alias("depth"), (F.max("y") - F.min("y")).alias("width"), (F.max("x") - F.min("x")).alias("length"), F.count("*").alias("outfield"))


def line_summary(lines: DataFrame) -> DataFrame:
    """Averages, and shares of high-line and low-block frames on the trailing mean of 15 rows (first 14 raw)."""
    w = Window.partitionBy("match_id", "team_id").orderBy("frame_idx")
    s = lines.withColumn("_rn", F.row_number().over(w)).withColumn("s", F.when(F.col("_rn") < 15, F.col("depth")).otherwise(F.avg("depth").over(w.rowsBetween(-14, 0))))
    return s.groupBy("match_id", "team_id").agg(F.avg("s").alias("mean_depth"), F.avg("width").alias("mean_width"), F.avg("length").alias("mean_length"), (F.count_if(F.expr("s > 40")) / F.count("*")).alias("high_line"), (F.count_if(F.expr("s < 25")) / F.count("*")).alias("low_block"))


def formations(points: DataFrame, window: int = 75) -> DataFrame:
    """Per window of 75 frames from the match's first, the known formation nearest to the three lines."""
    f0 = points.groupBy("match_id").agg(F.min("frame_idx").alias("_f0"))
    rows = points.join(f0, "match_id").withColumn("win", F.floor((F.col("frame_idx") - F.col("_f0")) / window))
    by = ["match_id", "win", "team_id"]
    mean = rows.groupBy(*by, "track_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    lined = with_lines(without_keeper(mean, by, 7), by)
    n = lined.groupBy(*by).agg(*(F.count_if(F.col("line") == k).alias(k) for k in ("def", "mid", "att")))
    off = [(F.abs(F.col("def") - a) + F.abs(F.col("mid") - b) + F.abs(F.col("att") - c), i, f"{a}-{b}-{c}") for i, (a, b, c) in enumerate(FORMATIONS)]
    best = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")) for d, i, name in off]))
    return n.withColumn("formation", best["name"])


def dominant_formation(found: DataFrame) -> DataFrame:
    n = found.groupBy("match_id", "team_id", "formation").agg(F.count("*").alias("n"))
    top = n.groupBy("match_id", "team_id").agg(F.max(F.struct("n", F.col("formation").alias("f"))).alias("m"), F.sum("n").alias("windows"))
    return top.select("match_id", "team_id", F.col("m.f").alias("formation"), (F.col("m.n") / F.col("windows")).alias("share"))


def formation_shifts(found: DataFrame, gap: int = 2) -> DataFrame:
    """Windows whose formation differs from the one before, ``gap`` windows apart at least."""
    w = Window.partitionBy("match_id", "team_id").orderBy("win")
    moved = found.withColumn("before", F.lag("formation").over(w)).where("before <> formation")
    return cooldown(moved, ["match_id", "team_id"], "win", gap).select("match_id", "team_id", "win", "before", "formation")


def shape(points: DataFrame) -> DataFrame:
    """X-range, y-range and mean distance to the centroid per frame and team, nulled above 68, 105 and 80 m."""
    w = Window.partitionBy("match_id", "frame_idx", "team_id")
    rows = points.withColumn("_d", distance("x", "y", F.avg("x").over(w), F.avg("y").over(w)))
    out = rows.groupBy("match_id", "frame_idx", "team_id").agg((F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("depth"), F.avg("_d").alias("compactness"))
    cut = lambda c, m: F.when(F.col(c) <= m, F.col(c)).alias(c)
    return out.select("match_id", "frame_idx", "team_id", cut("width", 68), cut("depth", 105), cut("compactness", 80)).where("width IS NOT NULL AND depth IS NOT NULL")


def out_of_shape(lines: DataFrame) -> DataFrame:
    """Spells of frames with length > 40, width > 55 or line < 18 m, and the first frame's reason."""
    reason = F.when(F.col("length") > 40, "too_long").when(F.col("width") > 55, "too_wide").when(F.col("depth") < 18, "too_deep")
    rows = lines.withColumn("reason", reason).withColumn("bad", F.col("reason").isNotNull())
    rows = with_run(rows, ["match_id", "team_id"], "frame_idx", changes(["match_id", "team_id"], "frame_idx", "bad"))
    return rows.where("bad").groupBy("match_id", "team_id", "run").agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.count("*").alias("rows"), F.min_by("reason", "frame_idx").alias("reason")).drop("run")


def entropy(points: DataFrame, every: int = 5) -> DataFrame:
    """Entropy of a team's players over 6 x 4 zones on every fifth frame, over log2(24); needs three players."""
    zone = F.least(F.greatest(F.floor(F.col("x") / 105 * 6), F.lit(0)), F.lit(5)) * 4 + F.least(F.greatest(F.floor(F.col("y") / 68 * 4), F.lit(0)), F.lit(3))
    n = points.where(F.col("frame_idx") % every == 0).groupBy("match_id", "frame_idx", "team_id", zone.alias("zone")).agg(F.count("*").alias("n"))
    p = n.withColumn("_all", F.sum("n").over(Window.partitionBy("match_id", "frame_idx", "team_id"))).where("_all >= 3").withColumn("p", F.col("n") / F.col("_all"))
    return p.groupBy("match_id", "frame_idx", "team_id").agg(F.round(-F.sum(F.col("p") * F.log2("p")) / math.log2(24), 3).alias("entropy"))


def entropy_trend(values: DataFrame) -> DataFrame:
    """Last third against first third, beyond 0.05, from six values on."""
    w = Window.partitionBy("match_id", "team_id")
    rows = values.withColumn("_rn", F.row_number().over(w.orderBy("frame_idx"))).withColumn("_n", F.count("*").over(w)).withColumn("_k", F.floor(F.col("_n") / 3))
    out = rows.groupBy("match_id", "team_id").agg(F.avg("entropy").alias("mean_entropy"), F.count("*").alias("n"), (F.avg(F.when(F.col("_rn") > F.col("_n") - F.col("_k"), F.col("entropy"))) - F.avg(F.when(F.col("_rn") <= F.col("_k"), F.col("entropy")))).alias("d"))
    trend = F.when(F.col("n") < 6, "insufficient").when(F.col("d") > 0.05, "increasing").when(F.col("d") < -0.05, "decreasing").otherwise("stable")
    return out.select("match_id", "team_id", F.round("mean_entropy", 6).alias("mean_entropy"), trend.alias("trend"))


def _lattice(nx: int, ny: int, step_x: float, step_y: float, off: float):
    return F.transform(F.sequence(F.lit(0), F.lit(nx * ny - 1)), lambda i: F.struct((F.floor(i / ny) * step_x + off * step_x).alias("gx"), ((i % ny) * step_y + off * step_y).alias("gy"), i.alias("cell")))


def control_share(points: DataFrame, every: int = 10, nx: int = 53, ny: int = 35, step: float = 2.0, least: int = 4) -> DataFrame:
    """Per sampled frame the share of a 2 m lattice nearest to team 0 (lower track on ties).

    A frame's players (28 at most) are one row, and the lattice is laid over the frames of a batch at once.
    """
    rows = points.where(F.col("frame_idx") % every == 0).groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("track_id", "team_id", "x", "y"))).alias("ps")).where(F.size("ps") >= least)
    return rows.select(*FRAME, nearest_share(nx, ny, step)("ps").alias("share"))


def pressure_map(points: DataFrame) -> DataFrame:
    """Per team and cell of a 10 x 10 grid, the sum of 1/d over its opponents' mean positions under 10 m from the cell's centre, over the maximum."""
    mean = points.groupBy("match_id", "team_id", "track_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    rows = mean.select("match_id", (1 - F.col("team_id")).alias("team_id"), "x", "y", F.explode(_lattice(10, 10, 10.5, 6.8, 0.5)).alias("g"))
    d = distance("x", "y", "g.gx", "g.gy")
    rows = rows.withColumn("d", d).where("d < 10").groupBy("match_id", "team_id", F.col("g.cell").alias("cell")).agg(F.sum(1 / F.greatest(F.col("d"), F.lit(0.1))).alias("p"))
    return rows.withColumn("pressure", F.col("p") / F.max("p").over(Window.partitionBy("match_id", "team_id"))).drop("p")


def space_grid(points: DataFrame) -> DataFrame:
    """The team with the nearest mean position to each cell's centre of a 10 x 10 grid; -1 if none is nearer."""
    mean = points.groupBy("match_id", "team_id", "track_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    rows = mean.select("match_id", "team_id", "x", "y", F.explode(_lattice(10, 10, 10.5, 6.8, 0.5)).alias("g")).withColumn("d", distance("x", "y", "g.gx", "g.gy"))
    near = lambda t: F.coalesce(F.min(F.when(F.col("team_id") == t, F.col("d"))), F.lit(999.0))
    cells = rows.groupBy("match_id", F.col("g.cell").alias("cell"), F.col("g.gx").alias("gx"), F.col("g.gy").alias("gy")).agg(near(0).alias("_0"), near(1).alias("_1"))
    owner = F.when(F.col("_0") < F.col("_1"), 0).when(F.col("_1") < F.col("_0"), 1).otherwise(-1)
    return cells.select("match_id", F.col("cell").cast("long").alias("cell"), "gx", "gy", owner.alias("owner"))


def territory(grid: DataFrame) -> DataFrame:
    """Percent of cells of each team and of none, and the cells within 20 m of a goal that its attackers hold."""
    pct = lambda t: F.round(F.count_if(F.col("owner") == t) / F.count("*") * 100, 1)
    return grid.groupBy("match_id").agg(
        pct(0).alias("team0"), pct(1).alias("team1"), pct(-1).alias("contested"), F.count_if((F.col("gx") < 20) & (F.col("owner") == 1)).alias("threats_to_0"), F.count_if((F.col("gx") > 85) & (F.col("owner") == 0)).alias("threats_to_1")
    )


def situations(points: DataFrame, speeds: DataFrame, players: DataFrame) -> DataFrame:
    """Per frame dead_ball (under four players), set_piece (ball under 0.5 m/s), transition (over 3), high_press, else open_play; with confidence.

    It's a high press if three boxes or more end in the upper 35 % of the picture, whose height follows from the lowest box.
    """
    n = points.groupBy(*FRAME).agg(F.count("*").alias("n"))
    low = players.select(*FRAME, "y2", F.max("y2").over(Window.partitionBy(*FRAME)).alias("_low"))
    high = low.groupBy(*FRAME).agg(F.count_if(F.col("y2") < F.col("_low") / 0.88 * 0.35).alias("_high"))
    out = n.join(speeds.select(*FRAME, "speed_ms"), FRAME, "left").join(high, FRAME, "left")
    label = F.when(F.col("n") < 4, "dead_ball").when(F.col("speed_ms") < 0.5, "set_piece").when(F.col("speed_ms") > 3.0, "transition").when(F.col("_high") >= 3, "high_press").otherwise("open_play")
    sure = F.when(F.col("label") == "dead_ball", 0.95).when(F.col("label") == "set_piece", 0.8).when(F.col("label") == "transition", 0.75).otherwise(0.7)
    return out.withColumn("label", label).withColumn("confidence", sure).drop("_high")


def situation_segments(labelled: DataFrame, least_s: float = 0.5) -> DataFrame:
    """Runs of one label of half a second (a fifth for dead_ball) or more."""
    rows = with_run(labelled, ["match_id"], "frame_idx", changes(["match_id"], "frame_idx", "label"))
    out = rows.groupBy("match_id", "run", "label").agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"))
    out = out.withColumn("seconds", (F.col("end_frame") - F.col("start_frame") + 1) / 25.0)
    return out.where(F.col("seconds") >= F.when(F.col("label") == "dead_ball", 0.2).otherwise(least_s)).drop("run")


def phase_widths(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Mean y-range of each team over the frames of each situation."""
    per = points.groupBy("match_id", "frame_idx", "team_id").agg((F.max("y") - F.min("y")).alias("width"))
    s = segments.select("match_id", "label", F.explode(F.sequence("start_frame", "end_frame")).alias("frame_idx"))
    return per.join(s, FRAME).groupBy("match_id", "team_id", "label").agg(F.avg("width").alias("width"), F.count("*").alias("frames"))


#: Fixed values of a pressing trap: metres to a touchline, radius of pressers, their number, degrees of spread, square metres.
TRAP = {"touchline": 6.0, "radius": 8.0, "pressers": 2, "spread": 45.0, "area": 80.0}


def pressing_stories(points: DataFrame, carrier: DataFrame, trap: dict | None = None) -> DataFrame:
    """At each carrier's frame whether it is a pressing trap, and if not, the story that it is; with its geometry and a score to rank by.

    Pressers are opponents within the radius; spread is the largest angle between two of them as the carrier sees them, area the
    convex hull of all.
    """
    t = trap or TRAP
    c = carrier.select(*FRAME, "carrier", F.col("team_id").alias("_t"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    near = points.join(c, FRAME).where("team_id <> _t").where(distance("x", "y", "cx", "cy") <= t["radius"]).groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("ps"))
    rows = c.join(near, FRAME, "left").withColumn("ps", F.coalesce("ps", F.array().cast("array<struct<x:double,y:double>>")))
    rows = rows.withColumn("_g", press_geometry()("cx", "cy", "ps")).withColumn("pressers", F.size("ps")).withColumn("touchline_m", F.least(F.abs("cy"), F.abs(68.0 - F.col("cy"))))
    spread, area, n = F.col("_g.spread"), F.col("_g.area"), F.col("pressers")
    wide, many, split, tight = F.col("touchline_m") <= t["touchline"], n >= t["pressers"], spread >= t["spread"], area <= t["area"]
    valid = wide & many & split & tight
    story = (
        F.when(valid, "PRESSING_TRAP").when(many & split & tight & ~wide, "PRESSING_TRIANGLE").when(wide & (n == 1), "WIDE_CHANNEL_CHASE").when((n >= 2) & ~split, "TRANSITION_PRESSURE")
        .when((n == 1) & ~wide, "RECOVERY_RUN").otherwise("1V1_PRESSURE")
    )
    third = F.when(F.col("cx") < 35, "def").when(F.col("cx") < 70, "mid").otherwise("att")
    score = n * 10.0 + F.greatest(F.lit(0.0), t["touchline"] * 2 - F.col("touchline_m")) * 0.8 + F.least(spread, F.lit(90.0)) / 9.0 - F.greatest(F.lit(0.0), area - t["area"]) * 0.05
    return rows.select(*FRAME, "carrier", valid.alias("valid"), story.alias("story"), n.cast("long").alias("pressers"), F.round("touchline_m", 2).alias("touchline_m"), F.round(spread, 1).alias("spread_deg"), F.round(area, 1).alias("area_m2"), third.alias("third"), F.round(score, 4).alias("score"))


def team_shape(points: DataFrame) -> DataFrame:
    """A team's mean-position length, width, depth of its last four, height of its first three, mean pair distance."""
    mean = points.groupBy("match_id", "team_id", "track_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumn("ahead", F.when(F.col("team_id") == 0, F.col("x")).otherwise(105 - F.col("x")))
    w = Window.partitionBy("match_id", "team_id")
    r = mean.withColumn("_low", F.row_number().over(w.orderBy("ahead", "track_id"))).withColumn("_high", F.row_number().over(w.orderBy(F.desc("ahead"), "track_id")))
    base = r.groupBy("match_id", "team_id").agg((F.max("x") - F.min("x")).alias("length"), (F.max("y") - F.min("y")).alias("width"), F.avg(F.when(F.col("_low").between(2, 5), F.col("ahead"))).alias("back_four"), F.avg(F.when(F.col("_high") <= 3, F.col("ahead"))).alias("front_three"))
    a, b = mean.alias("a"), mean.alias("b")
    pairs = a.join(b, (F.col("a.match_id") == F.col("b.match_id")) & (F.col("a.team_id") == F.col("b.team_id")) & (F.col("a.track_id") < F.col("b.track_id")))
    comp = pairs.groupBy(F.col("a.match_id").alias("match_id"), F.col("a.team_id").alias("team_id")).agg(F.avg(distance("a.x", "a.y", "b.x", "b.y")).alias("compactness"))
    return base.join(comp, ["match_id", "team_id"])


def densest_window(events: DataFrame, window: int = 200) -> DataFrame:
    """The event that starts the match's densest window of 8 s; the earliest on ties."""
    w = Window.partitionBy("match_id").orderBy("frame_idx").rangeBetween(0, window)
    n = events.select("match_id", "frame_idx", F.count("*").over(w).alias("n")).distinct()
    return n.groupBy("match_id").agg(F.max(F.struct("n", (-F.col("frame_idx")).alias("f"))).alias("m")).select("match_id", (-F.col("m.f")).alias("start_frame"), F.col("m.n").alias("events"))


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """Overlapping [start_frame, end_frame] ranges of a match as one."""
    w = Window.partitionBy("match_id").orderBy("start_frame", "end_frame")
    rows = ranges.withColumn("_top", F.max("end_frame").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("_top").isNull() | (F.col("start_frame") > F.col("_top")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("match_id", "run").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.count("*").alias("merged")).drop("run")

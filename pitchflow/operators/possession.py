"""Possession, passes, shots and other events from ball and player positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, expected_goals
from .joins import FRAME, carriers, with_ball
from .runs import changes, cooldown, with_run


def over_match() -> Window:
    return Window.partitionBy("match_id").orderBy("frame_idx")


def common_frames(points: DataFrame, ball: DataFrame) -> DataFrame:
    """Frames that have a ball and a player."""
    return ball.select(*FRAME).intersect(points.select(*FRAME))


def confirmed(points: DataFrame, ball: DataFrame, least: int = 3, limit: float = 3.0) -> DataFrame:
    """Per common frame the nearest player under ``limit`` m, confirmed from the least-th common frame in a row on."""
    rows = common_frames(points, ball).join(carriers(points, ball, limit), FRAME, "left")
    rows = with_run(rows, ["match_id"], "frame_idx", changes(["match_id"], "frame_idx", "carrier"), "streak_id")
    rows = rows.withColumn("streak", F.row_number().over(Window.partitionBy("match_id", "streak_id").orderBy("frame_idx")))
    return rows.where(F.col("carrier").isNotNull() & (F.col("streak") >= least)).select(*FRAME, "carrier", "team_id", "bx", "by", "x", "y")


def sequences(held: DataFrame) -> DataFrame:
    """Runs of one carrier over confirmed frames, with ball positions at both ends."""
    runs = with_run(held, ["match_id"], "frame_idx", changes(["match_id"], "frame_idx", "carrier"))
    ends = lambda f, c: f(c, "frame_idx")
    out = runs.groupBy("match_id", "run", "carrier", "team_id").agg(
        F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.count("*").alias("rows"),
        ends(F.min_by, "bx").alias("start_x"), ends(F.min_by, "by").alias("start_y"), ends(F.max_by, "bx").alias("end_x"), ends(F.max_by, "by").alias("end_y"),
    )
    return out.withColumn("duration", F.col("end_frame") - F.col("start_frame") + 1)


def _next(seq: DataFrame, *columns: str) -> DataFrame:
    w = Window.partitionBy("match_id").orderBy("start_frame")
    return seq.withColumns({f"n_{c}": F.lead(c).over(w) for c in columns})


def passes(seq: DataFrame, max_gap: int = 60, least_m: float = 2.0) -> DataFrame:
    """Neighbouring runs of one team with ball travel; a later rule of progressive, back_pass, cross wins."""
    n = _next(seq, "carrier", "team_id", "start_frame", "start_x", "start_y")
    ahead = F.when(F.col("team_id") == 0, F.col("n_start_x") - F.col("end_x")).otherwise(F.col("end_x") - F.col("n_start_x"))
    d = distance("end_x", "end_y", "n_start_x", "n_start_y")
    n = n.where((F.col("n_team_id") == F.col("team_id")) & (F.col("team_id") >= 0) & (F.col("n_start_frame") - F.col("end_frame") <= max_gap)).withColumn("distance_m", d).where(F.col("distance_m") >= least_m)
    kind = F.when((F.col("distance_m") > 25) & (F.abs(F.col("n_start_y") - F.col("end_y")) > 15), "cross").when(F.col("advance_m") < -5, "back_pass").when(F.col("advance_m") > 10, "progressive").otherwise("simple")
    n = n.withColumn("advance_m", ahead).withColumn("sub_type", kind)
    return n.select("match_id", F.col("n_start_frame").alias("frame_idx"), "team_id", F.col("carrier").alias("passer"), F.col("n_carrier").alias("receiver"), F.col("end_x").alias("x"), F.col("end_y").alias("y"), "distance_m", "advance_m", "sub_type")


def turnovers(seq: DataFrame, speeds: DataFrame, max_gap: int = 45) -> DataFrame:
    """The next run is of the other team within 45 frames; a clearance if the ball left the loser's half-side fast."""
    n = _next(seq, "carrier", "team_id", "start_frame", "start_x", "start_y").where((F.col("n_team_id") != F.col("team_id")) & (F.col("n_start_frame") - F.col("end_frame") <= max_gap))
    n = n.join(speeds.select("match_id", F.col("frame_idx").alias("end_frame"), "speed_ms"), ["match_id", "end_frame"], "left")
    own_half = F.when(F.col("team_id") == 0, F.col("end_x") < 52.5).otherwise(F.col("end_x") > 52.5)
    kind = F.when((F.col("speed_ms") > 6) & own_half, "clearance").otherwise("ball_recovery")
    return n.select("match_id", F.col("n_start_frame").alias("frame_idx"), F.col("n_team_id").alias("team_id"), F.col("n_carrier").alias("player"), F.col("carrier").alias("lost_by"), F.col("n_start_x").alias("x"), F.col("n_start_y").alias("y"), kind.alias("sub_type"))


def carries(seq: DataFrame) -> DataFrame:
    """Runs of five frames and over 5 m, by direction."""
    dx = F.when(F.col("team_id") == 0, F.col("end_x") - F.col("start_x")).otherwise(F.col("start_x") - F.col("end_x"))
    out = seq.withColumn("distance_m", distance("start_x", "start_y", "end_x", "end_y")).where("duration >= 5 AND distance_m > 5")
    kind = F.when(dx < -2, "backward").when(F.abs(dx) <= 2, "lateral").otherwise("forward")
    return out.select("match_id", F.col("start_frame").alias("frame_idx"), "team_id", F.col("carrier").alias("player"), "distance_m", kind.alias("sub_type"))


def dribbles(seq: DataFrame, points: DataFrame, ball: DataFrame) -> DataFrame:
    """Runs of eight frames and 3 m that meet an opponent under 3.5 m; failed if one is under 3 m of the ball in the ten frames on."""
    runs = seq.withColumn("metres", distance("start_x", "start_y", "end_x", "end_y")).where("duration >= 8 AND metres >= 3").select("match_id", "run", "carrier", F.col("team_id").alias("team"), "start_frame", "end_frame")
    spread = runs.withColumn("frame_idx", F.explode(F.sequence("start_frame", "end_frame")))
    own = points.select(*FRAME, F.col("track_id").alias("carrier"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    foes = points.select(*FRAME, "track_id", "team_id", "x", "y")
    at = spread.join(foes, FRAME).where("team_id <> team AND track_id <> carrier")
    met = at.join(own, [*FRAME, "carrier"]).where(distance("x", "y", "cx", "cy") < 3.5).groupBy("match_id", "run", "carrier", "team").agg(F.min("frame_idx").alias("f"))
    b = ball.select(*FRAME, F.col("x").alias("bx"), F.col("y").alias("by"))
    close = at.join(b, FRAME).where(distance("x", "y", "bx", "by") < 3.0).select("match_id", "run", F.col("frame_idx").alias("_f")).distinct()
    lost = met.join(close, ["match_id", "run"]).where("_f BETWEEN f AND f + 9").select("match_id", "run").distinct().withColumn("_lost", F.lit(True))
    return met.join(lost, ["match_id", "run"], "left").select("match_id", F.col("f").alias("frame_idx"), F.col("team").alias("team_id"), F.col("carrier").alias("player"), F.col("_lost").isNull().alias("success"))


def shot_frames(speeds: DataFrame) -> DataFrame:
    """Over 8 m/s near a goal, with a row under 4 m/s in the ten frames before."""
    w = Window.partitionBy("match_id").orderBy("frame_idx").rangeBetween(-10, -1)
    out = speeds.withColumn("_slow", F.min("speed_ms").over(w))
    return out.where("speed_ms > 8 AND (x > 68 OR x < 37) AND _slow < 4").drop("_slow")


def shots(speeds: DataFrame, points: DataFrame, look_back: int = 10) -> DataFrame:
    """Shots 30 frames apart with xG; the shooter is the nearest player under 5 m, at the frame or up to ten before."""
    kept = cooldown(shot_frames(speeds), ["match_id"], "frame_idx", 30).withColumn("xg", expected_goals("x", "y"))
    back = kept.select("match_id", F.col("frame_idx").alias("shot"), "x", "y", F.explode(F.sequence(F.lit(0), F.lit(look_back))).alias("k")).withColumn("frame_idx", F.col("shot") - F.col("k"))
    ball = speeds.select(*FRAME, F.col("x").alias("bx"), F.col("y").alias("by"))
    near = back.select("match_id", "shot", "k", "frame_idx").join(ball, FRAME).join(points.select(*FRAME, "track_id", "team_id", F.col("x").alias("px"), F.col("y").alias("py")), FRAME)
    near = near.withColumn("d", distance("px", "py", "bx", "by")).where("d < 5").groupBy("match_id", "shot").agg(F.min(F.struct("k", "d", "track_id", "team_id")).alias("m"))
    out = kept.join(near.withColumnRenamed("shot", "frame_idx"), FRAME, "left")
    return out.select("match_id", "frame_idx", F.col("m.track_id").alias("player"), F.col("m.team_id").alias("team_id"), "x", "y", "xg")


def control(held: DataFrame, matches: DataFrame) -> DataFrame:
    """The team in control of each frame, carried forward; null before the first."""
    frames = matches.select("match_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames_processed") - 1)).alias("frame_idx"))
    out = frames.join(held.select(*FRAME, "team_id"), FRAME, "left")
    return out.withColumn("team_id", F.last("team_id", ignorenulls=True).over(over_match().rowsBetween(Window.unboundedPreceding, 0)))


def votes(near: DataFrame, reach: int = 6) -> DataFrame:
    """W6's votes: the carrier with most frames within ``reach`` of each frame; lower track on ties."""
    spread = near.select("match_id", "carrier", F.explode(F.sequence(F.col("frame_idx") - reach, F.col("frame_idx") + reach)).alias("frame_idx"))
    n = spread.groupBy(*FRAME, "carrier").agg(F.count("*").alias("votes")).join(near.select(*FRAME), FRAME, "left_semi")
    return n.groupBy(*FRAME).agg(F.max(F.struct("votes", (-F.col("carrier")).alias("c"))).alias("m")).select(*FRAME, (-F.col("m.c")).alias("carrier"), F.col("m.votes").alias("votes"))


def smoothed_carriers(rows: DataFrame, reach: int = 6, margin: int = 3) -> DataFrame:
    """The carrier by votes of the frames within ``reach``, with hysteresis: the ball changes hands if another has ``margin`` votes more than the carrier last had.

    rows: match_id, frame_idx, carrier (null: none), confidence, missing (the ball wasn't seen: no vote); one a frame. Ties of votes go to who votes first.
    Adds smooth_carrier, smooth_confidence, votes and switched. A confidence is the carrier's mean in the window, less if it has under half of the votes; where
    a carrier is kept against the vote, its mean times its share, or if it has no vote half of the other's, 0.30 at least.

    Frames whose winner and votes are those of the frame before can't change the state, so what is folded is one row for each run of such frames.
    """
    own = rows.select(*FRAME, "carrier", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("missing", F.lit(False)).alias("missing"))
    cast = own.where("carrier IS NOT NULL AND NOT missing").select("match_id", "carrier", "confidence", F.col("frame_idx").alias("_at"), F.explode(F.sequence(F.col("frame_idx") - reach, F.col("frame_idx") + reach)).alias("frame_idx"))
    tally = cast.groupBy(*FRAME, "carrier").agg(F.count("*").alias("votes"), F.sum("confidence").alias("total"), F.min("_at").alias("first")).join(own.select(*FRAME), FRAME, "left_semi")
    best = tally.groupBy(*FRAME).agg(F.min(F.struct((-F.col("votes")).alias("v"), "first", "carrier", "total")).alias("m"), F.sum("votes").alias("voters"))
    votes, share = -F.col("m.v"), -F.col("m.v") / F.col("voters")
    sure = F.col("m.total") / votes
    won = own.join(best, FRAME, "left").select(*FRAME, "carrier", "confidence", F.col("m.carrier").alias("winner"), F.coalesce(votes, F.lit(0).cast("long")).alias("winner_votes"), F.when(share >= 0.5, sure).otherwise(sure * 2 * share).alias("winner_confidence"), "voters")
    w = over_match()
    same = F.col("winner").isNotNull() & F.col("winner").eqNullSafe(F.lag("winner").over(w)) & (F.col("winner_votes") == F.lag("winner_votes").over(w))
    won = with_run(won, ["match_id"], "frame_idx", ~same)
    runs = won.groupBy("match_id", "run").agg(F.min("frame_idx").alias("frame_idx"), F.first("winner").alias("winner"), F.first("winner_votes").alias("winner_votes"), F.min_by("carrier", "frame_idx").alias("carrier"))

    def code(p):
        import pandas as pd

        p = p.sort_values("run")
        held, had, out = None, 0, []
        for winner, n, raw in zip(p.winner, p.winner_votes, p.carrier, strict=True):
            took = False
            if pd.isna(winner):
                held, n = held if held is not None else None if pd.isna(raw) else int(raw), 0
            elif held is None or int(winner) == held or n >= had + margin:
                took, held = held != int(winner), int(winner)
            else:
                n = had
            had = int(n) if held is not None else had
            out.append((held, int(n), took))
        got = pd.DataFrame(out, columns=["smooth_carrier", "votes", "took"]).astype({"smooth_carrier": "Int64"})
        return pd.concat([p[["match_id", "run"]].reset_index(drop=True), got], axis=1)

    folded = runs.groupBy("match_id").applyInPandas(code, "match_id string, run long, smooth_carrier long, votes long, took boolean")
    out = won.join(folded, ["match_id", "run"]).join(runs.select("match_id", "run", F.col("frame_idx").alias("_from")), ["match_id", "run"])
    mine = tally.select(*FRAME, F.col("carrier").alias("smooth_carrier"), F.col("votes").alias("_n"), F.col("total").alias("_total"))
    out = out.join(mine, [*FRAME, "smooth_carrier"], "left")
    confidence = (
        F.when(F.col("winner").isNull(), F.col("confidence")).when(F.col("winner") == F.col("smooth_carrier"), F.col("winner_confidence"))
        .when(F.col("_n").isNotNull(), F.col("_total") / F.col("voters")).otherwise(F.greatest(F.lit(0.30), F.col("winner_confidence") * 0.5))
    )
    return out.select(*FRAME, "carrier", "smooth_carrier", F.round(confidence, 4).alias("smooth_confidence"), "votes", (F.col("took") & (F.col("frame_idx") == F.col("_from"))).alias("switched"))


def smoothing_report(smoothed: DataFrame) -> DataFrame:
    """Frames, frames with a carrier, changes of carrier before and after smoothing, and the share of them that is gone."""
    w = over_match()
    before = F.last("carrier", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    had = F.last("smooth_carrier", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = smoothed.withColumn("_raw", before.isNotNull() & (F.col("carrier") != before)).withColumn("_new", F.col("switched") & had.isNotNull())
    out = rows.groupBy("match_id").agg(F.count("*").alias("frames"), F.count("smooth_carrier").alias("with_carrier"), F.count_if("_raw").alias("changes"), F.count_if("_new").alias("smooth_changes"))
    return out.withColumn("reduction", F.when(F.col("changes") > 0, F.round(1 - F.col("smooth_changes") / F.col("changes"), 3)).otherwise(0.0))


def stationary(speeds: DataFrame, limit: float = 0.3, least: int = 20) -> DataFrame:
    """Runs of rows under 0.3 m/s; a run ends at the next faster row, or one after its last."""
    w = over_match()
    rows = speeds.withColumn("_next", F.lead("frame_idx").over(w)).withColumn("slow", F.col("speed_ms") < limit)
    rows = rows.withColumn("_new", ~F.col("slow").eqNullSafe(F.lag("slow").over(w))).withColumn("run", F.sum(F.col("_new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.where("slow").groupBy("match_id", "run").agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("last_frame"), F.max_by("_next", "frame_idx").alias("_end"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    out = out.withColumn("frames", F.coalesce(F.col("_end"), F.col("last_frame") + 1) - F.col("start_frame"))
    return out.where(F.col("frames") >= least).select("match_id", "start_frame", "last_frame", "frames", "x", "y")


def set_pieces(still: DataFrame) -> DataFrame:
    """E8's kinds by the mean place of a stationary ball: corner, penalty, kick-off, goal kick, throw-in, free kick."""
    edge_y, end_x = F.least(F.col("y"), 68 - F.col("y")), F.least(F.col("x"), 105 - F.col("x"))
    goal_area = (F.col("x").between(0.0, 18.0) | F.col("x").between(87.0, 105.0)) & F.col("y").between(25.0, 45.0)
    kind = (
        F.when((end_x <= 3) & (edge_y <= 3), "corner").when((F.abs(end_x - 11) <= 2) & (F.abs(F.col("y") - 34) <= 2), "penalty")
        .when((F.abs(F.col("x") - 52.5) <= 3) & (F.abs(F.col("y") - 34) <= 3), "kick_off").when(goal_area, "goal_kick").when(edge_y <= 2, "throw_in").otherwise("free_kick")
    )
    return still.withColumn("kind", kind)


def press_actions(points: DataFrame, held: DataFrame, near: float = 4.0, gap: int = 10) -> DataFrame:
    """Opponents under 4 m of a carrier, ten frames apart for each presser."""
    h = held.select(*FRAME, "carrier", F.col("team_id").alias("team"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    hit = points.join(h, FRAME).where((F.col("team_id") != F.col("team")) & (distance("x", "y", "cx", "cy") < near))
    return cooldown(hit.select(*FRAME, "track_id", "team_id", "x", "cx"), ["match_id", "track_id"], "frame_idx", gap)


def ppda(actions: DataFrame, held: DataFrame) -> DataFrame:
    """Passes of the other team in its zone per press action in the far zone (as coded); null under five actions."""
    w = over_match()
    p = held.withColumns({"_c": F.lag("carrier").over(w), "_t": F.lag("team_id").over(w)}).where("_c <> carrier AND _t = team_id")
    p = p.groupBy("match_id").agg(F.count_if(F.expr("team_id = 1 AND bx < 35")).alias("p0"), F.count_if(F.expr("team_id = 0 AND bx > 70")).alias("p1"))
    a = actions.groupBy("match_id").agg(F.count_if(F.expr("team_id = 0 AND cx > 70")).alias("a0"), F.count_if(F.expr("team_id = 1 AND cx < 35")).alias("a1"), F.count_if(F.expr("team_id = 0")).alias("n0"), F.count_if(F.expr("team_id = 1")).alias("n1"))
    both = p.join(a, "match_id", "full")
    rate = lambda k: F.when((F.col(f"n{k}") >= 5) & (F.col(f"a{k}") > 0), F.col(f"p{k}") / F.col(f"a{k}")).alias(f"ppda_{k}")
    return both.select("match_id", rate(0), rate(1))


def pass_edges(passed: DataFrame) -> DataFrame:
    """Passes from player to player with mean distance; frequent from the match's 75th percentile of counts on."""
    e = passed.groupBy("match_id", "team_id", "passer", "receiver").agg(F.count("*").alias("passes"), F.avg("distance_m").alias("mean_m"))
    p75 = e.groupBy("match_id").agg(F.percentile("passes", F.lit(0.75)).alias("_p"))
    return e.join(p75, "match_id").withColumn("frequent", F.col("passes") >= F.col("_p")).drop("_p")


def pass_nodes(passed: DataFrame, points: DataFrame) -> DataFrame:
    """Passes made and received by each player, mean position, key passer and progressive flags."""
    ends = passed.select("match_id", "team_id", F.col("passer").alias("track_id"), F.lit(1).alias("made"), F.lit(0).alias("got"), F.col("advance_m").alias("adv")).unionByName(
        passed.select("match_id", "team_id", F.col("receiver").alias("track_id"), F.lit(0).alias("made"), F.lit(1).alias("got"), F.lit(None).cast("double").alias("adv"))
    )
    n = ends.groupBy("match_id", "team_id", "track_id").agg(F.sum("made").alias("made"), F.sum("got").alias("received"), F.avg("adv").alias("_adv"))
    p75 = n.groupBy("match_id").agg(F.percentile("made", F.lit(0.75)).alias("_p"))
    mean = points.groupBy("match_id", "track_id").agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
    out = n.join(p75, "match_id").join(mean, ["match_id", "track_id"], "left")
    return out.select("match_id", "team_id", "track_id", "made", "received", "mean_x", "mean_y", ((F.col("made") >= F.col("_p")) & (F.col("_p") > 0)).alias("key_passer"), F.coalesce(F.col("_adv") > 10, F.lit(False)).alias("progressive"))


def counter_press(lost: DataFrame, points: DataFrame, ball: DataFrame, held: DataFrame, seconds: float = 5.0, near: float = 5.0) -> DataFrame:
    """Pressers within 5 m of the ball in the five seconds after a turnover while the other side has it; intensity by the peak of one frame."""
    from .joins import after_event

    e = lost.select("match_id", F.col("frame_idx").alias("event_frame"), F.col("team_id").alias("won"))
    h = held.select(*FRAME, F.col("team_id").alias("holder"))
    rows = with_ball(points, ball).join(h, FRAME).where((F.col("d") < near) & (F.col("team_id") != F.col("holder")))
    inside = after_event(e, rows.select(*FRAME, "track_id", "team_id", "holder"), int(25 * seconds)).where("team_id <> won AND holder = won")
    per = inside.groupBy("match_id", "event_frame", "won", "frame_idx").agg(F.count_distinct("track_id").alias("n"))
    peak = per.groupBy("match_id", "event_frame", "won").agg(F.max("n").alias("peak"), F.min("frame_idx").alias("first"))
    out = e.join(peak, ["match_id", "event_frame", "won"], "left").withColumn("peak", F.coalesce("peak", F.lit(0).cast("long")))
    level = F.when(F.col("peak") >= 3, "high").when(F.col("peak") == 2, "medium").when(F.col("peak") == 1, "low").otherwise("none")
    return out.select("match_id", "event_frame", (1 - F.col("won")).alias("pressing_team"), "peak", level.alias("intensity"), ((F.col("first") - F.col("event_frame")) / 25.0).alias("first_press_s"))


def simple_passes(points: DataFrame, ball: DataFrame) -> DataFrame:
    """E9's rules over ball steps: shot (over 5 m near a goal line), else pass (over 8 m between two nearest players)."""
    w = over_match()
    near = carriers(points, ball, 1e9).select(*FRAME, F.col("carrier").alias("who"))
    b = ball.join(near, FRAME, "left")
    b = b.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w), "pw": F.lag("who").over(w)}).withColumn("step", distance("x", "y", "px", "py"))
    kind = F.when((F.col("step") > 5) & ((F.col("x") > 95) | (F.col("x") < 10)), "shot").when((F.col("step") > 8) & (F.col("who") != F.col("pw")), "pass")
    return b.withColumn("kind", kind).where("kind IS NOT NULL").select(*FRAME, "kind", "step", F.col("pw").alias("from_player"), F.col("who").alias("to_player"))


def passes_without_ball(points: DataFrame, drop: float = 0.60, frames: int = 10, metres: float = 30.0) -> DataFrame:
    """E5: a player that slows by over 60 % and a team-mate that speeds up as much within ten frames and 30 m; a passer counts once in ten frames.

    Speeds are means over five frames before and from a frame on; candidates meet by blocks of ten frames.
    """
    w = Window.partitionBy("match_id", "track_id").orderBy("frame_idx")
    gap = F.col("frame_idx") - F.lag("frame_idx").over(w)
    step = distance("x", "y", F.lag("x").over(w), F.lag("y").over(w)) / gap
    rows = points.withColumn("_g", gap).withColumn("_s", step).where((F.col("_g") > 0) & (F.col("_g") <= 10) & (F.col("_s") <= 3.0)).withColumn("speed", F.col("_s") * 25.0)
    rows = rows.withColumn("before", F.coalesce(F.avg("speed").over(w.rangeBetween(-5, -1)), F.lit(0.0))).withColumn("after", F.avg("speed").over(w.rangeBetween(0, 4)))
    key = ["match_id", "team_id"]
    a = rows.where((F.col("before") > 1) & (F.col("after") < F.col("before") * (1 - drop))).select(*key, F.col("track_id").alias("passer"), F.col("frame_idx").alias("_f"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    b = rows.where((F.col("after") > 1) & (F.col("before") < F.col("after") * (1 - drop))).select(*key, F.col("track_id").alias("receiver"), "frame_idx", "x", "y").withColumn("_k", F.floor(F.col("frame_idx") / frames))
    a = a.withColumn("_k", F.explode(F.array(F.floor(F.col("_f") / frames), F.floor(F.col("_f") / frames) + 1)))
    met = a.join(b, [*key, "_k"]).where((F.col("passer") != F.col("receiver")) & (F.col("frame_idx") - F.col("_f")).between(0, frames)).withColumn("distance_m", distance("x", "y", "_x", "_y")).where(F.col("distance_m") <= metres)
    best = met.groupBy(*key, "passer", "frame_idx").agg(F.min(F.struct("distance_m", "receiver")).alias("m"))
    out = best.select(*key, "passer", "frame_idx", F.col("m.receiver").alias("receiver"), F.round("m.distance_m", 2).alias("distance_m"))
    return cooldown(out, ["match_id", "passer"], "frame_idx", frames)

"""Checks of a story's geometry at a carrier's frame: pressing triangle and trap, one against one, pressure before goal, carry.

A carrier's frame has some eleven opponents, so they are one array in the row; each check is column expressions over it and gives the codes of
what fails (none: the story holds). Angles are rounded to a millionth of a degree before they are compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance
from .joins import FRAME

PITCH = (105.0, 68.0)
#: Fixed values in metres and degrees: the ball at the carrier, confidences; triangle; trap; one against one; goalmouth; carry.
BALL_NEAR, CARRIER_SURE, MAP_SURE = 1.8, 0.65, 0.85
PRESSER, COVER, EDGE, APART = 4.5, 8.0, 11.0, 25.0
INFLUENCE, INNER, ESCAPE, ESCAPE_MOST = 10.0, 6.0, 90.0, 120.0
DUEL, SUPPORT = 3.0, 5.0
THIRD, MOUTH, ACTIVE = 2 / 3, 20.0, 8.0
CARRY, CARRY_FRAMES, CARRY_PRESSERS = 5.0, 25, 1
RUN_SPEED, RUN_SECONDS = 5.5, 0.7


def codes(*pairs: tuple[Column, str]) -> Column:
    """The codes whose conditions hold, joined by +; null conditions don't."""
    return F.array_join(F.array_compact(F.array(*(F.when(when, code) for when, code in pairs))), "+")


def scenes(points: DataFrame, carriers: DataFrame) -> DataFrame:
    """A row for each carrier's frame (match_id, frame_idx, carrier, team_id, x, y, d: the ball's distance) with opponents (d, track_id, x, y, vx, vy), nearest first.

    vx and vy are the steps since the track's row before (null in its first).
    """
    w = Window.partitionBy("match_id", "track_id").orderBy("frame_idx")
    moved = points.select(*FRAME, "track_id", F.col("team_id").alias("_team"), F.col("x").alias("px"), F.col("y").alias("py"), (F.col("x") - F.lag("x").over(w)).alias("vx"), (F.col("y") - F.lag("y").over(w)).alias("vy"))
    met = carriers.select(*FRAME, "carrier", "team_id", "x", "y", "d").join(moved, FRAME).where(F.col("_team") != F.col("team_id"))
    one = F.struct(distance("x", "y", "px", "py").alias("d"), "track_id", F.col("px").alias("x"), F.col("py").alias("y"), "vx", "vy")
    near = met.groupBy(*FRAME).agg(F.array_sort(F.collect_list(one)).alias("opponents"))
    past = points.select("match_id", (F.col("frame_idx") + CARRY_FRAMES).alias("frame_idx"), F.col("track_id").alias("carrier"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    out = carriers.select(*FRAME, "carrier", "team_id", "x", "y", "d").join(near, FRAME, "left").join(past, [*FRAME, "carrier"], "left")
    none = F.array().cast(near.schema["opponents"].dataType)
    return out.withColumns({"opponents": F.coalesce("opponents", none), "carried": F.coalesce(distance("x", "y", "x0", "y0"), F.lit(0.0))}).drop("x0", "y0")


def within(metres: float) -> Column:
    return F.size(F.filter("opponents", lambda o: o["d"] <= metres))


def truth(ball: Column, carrier_confidence: Column, map_confidence: Column) -> list[tuple[Column, str]]:
    """What any story asks for: a ball that is seen near its carrier, a sure carrier, a sure map of the pitch."""
    return [(ball.isNull(), "ball_not_visible"), (map_confidence < MAP_SURE, "low_homography_confidence"), (carrier_confidence < CARRIER_SURE, "low_carrier_confidence"), (ball > BALL_NEAR, "ball_too_far_from_carrier")]


def _angle(a: Column, b: Column) -> Column:
    """Degrees between two opponents as the carrier sees them; 0 if one stands on the carrier."""
    ax, ay, bx, by = a["x"] - F.col("x"), a["y"] - F.col("y"), b["x"] - F.col("x"), b["y"] - F.col("y")
    size = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    return F.when((a["d"] < 1e-6) | (b["d"] < 1e-6), 0.0).otherwise(F.round(F.degrees(F.acos(F.greatest(F.least((ax * bx + ay * by) / size, F.lit(1.0)), F.lit(-1.0)))), 6))


def escape_angle(metres: float = INFLUENCE) -> Column:
    """The widest way out between neighbouring opponents within so many metres, in degrees; 360 with fewer than two."""
    turn = F.array_sort(F.transform(F.filter("opponents", lambda o: o["d"] <= metres), lambda o: F.degrees(F.atan2(o["y"] - F.col("y"), o["x"] - F.col("x")))))
    n = F.size(turn)
    gap = lambda i: F.when(i + 1 < n, F.get(turn, i + 1)).otherwise(F.get(turn, F.lit(0)) + 360) - F.get(turn, i)
    return F.when(n < 2, 360.0).otherwise(F.round(F.array_max(F.transform(F.sequence(F.lit(0), n - 1), gap)), 6))


def checks(rows: DataFrame, carrier_confidence: Column | None = None, map_confidence: Column | None = None) -> DataFrame:
    """E15's other checks over scenes: for each story the codes of what fails; pressers, escape and carried as evidence. The goal that is attacked lies at the end of x."""
    sure, mapped = carrier_confidence if carrier_confidence is not None else F.lit(1.0), map_confidence if map_confidence is not None else F.lit(1.0)
    base = truth(F.col("d"), sure, mapped)
    a, b = F.get("opponents", F.lit(0)), F.get("opponents", F.lit(1))
    between = F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    edge = reduce(F.greatest, [a["d"], b["d"], between])
    lone = b.isNull()
    triangle = [*base, (a.isNull() | (a["d"] > PRESSER), "presser_too_far"), (lone | (b["d"] > COVER) | (between > COVER), "no_real_cover_defender"), (~lone & (edge > EDGE), "triangle_too_large"), (~lone & (_angle(a, b) < APART), "defenders_collinear")]
    escape = escape_angle()
    trap = [*base, ((within(INFLUENCE) < 3) | (within(INNER) < 2), "insufficient_defenders_for_trap"), (escape > ESCAPE_MOST, "escape_angle_too_large"), (escape > ESCAPE, "no_directional_force")]
    toward = (a["vx"] * (F.col("x") - a["x"]) + a["vy"] * (F.col("y") - a["y"])) < 0  # the sign of the cosine
    duel = [*base, (a.isNull() | (a["d"] > DUEL), "presser_too_far"), (within(SUPPORT) - F.when(a["d"] <= SUPPORT, 1).otherwise(0) > 0, "second_defender_present"), (toward, "defender_not_engaging")]
    side = F.least(F.abs("y"), F.abs(PITCH[1] - F.col("y")))
    mouth = [(F.col("x") < PITCH[0] * THIRD, "not_in_attacking_third"), (within(ACTIVE) < 1, "no_presser"), (side > MOUTH, "far_from_touchline")]
    carry = [(F.col("carried") < CARRY, "short_carry"), (within(ACTIVE) > CARRY_PRESSERS, "pressed")]
    return rows.select(*FRAME, "carrier", "team_id", within(ACTIVE).alias("pressers"), escape.alias("escape_deg"), F.round("carried", 6).alias("carried_m"), *(codes(*c).alias(n) for n, c in (("triangle", triangle), ("trap", trap), ("duel", duel), ("goalmouth", mouth), ("carry", carry))))


def recovery_codes(speed: Column, seconds: Column, homeward: Column, nearing: Column, carrier_confidence: Column, map_confidence: Column) -> Column:
    """What fails of a recovery run: speed over a time, towards the own goal, nearing the threat; the ball needn't be seen."""
    base = truth(F.lit(0.0), carrier_confidence, map_confidence)
    return codes(*base, ((speed < RUN_SPEED) | (seconds < RUN_SECONDS), "speed_too_low"), (~homeward, "run_not_toward_own_goal"), (~nearing, "no_transition_threat"))

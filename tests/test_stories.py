"""Checks of stories on worked scenes."""

from pyspark.sql import functions as F

from pitchflow.operators import stories

POINT = "match_id string, frame_idx long, track_id long, team_id long, x double, y double"
CARRIER = "match_id string, frame_idx long, carrier long, team_id long, d double, x double, y double"


def scene(spark, scenes):
    """scenes: (carrier's place, ball's distance, opponents, their places a frame earlier): a frame each, every fortieth."""
    points, carriers = [], []
    for k, ((x, y), ball, opponents, before) in enumerate(scenes):
        f = 40 * k + 40
        carriers.append(("m", f, 1, 0, ball, x, y))
        points += [("m", f, 1, 0, x, y), ("m", f, 2, 0, x + 0.5, y)]
        points += [("m", f, 100 * k + 10 + i, 1, *p) for i, p in enumerate(opponents)] + [("m", f - 1, 100 * k + 10 + i, 1, *p) for i, p in enumerate(before)]
    points += [("m", 40 * k + 15, 1, 0, scenes[k][0][0] - 6.0, scenes[k][0][1]) for k in range(len(scenes)) if k % 2]
    return spark.createDataFrame(points, POINT), spark.createDataFrame(carriers, CARRIER)


def test_worked_scenes(spark):
    points, carriers = scene(spark, [
        ((50.0, 34.0), 1.0, [(52.0, 34.0), (50.0, 39.0)], []),  # a triangle
        ((50.0, 34.0), 2.0, [(52.0, 34.0), (53.0, 34.2)], [(53.0, 34.0)]),  # in one line, the ball too far, an opponent that comes nearer
        ((50.0, 5.0), 1.0, [(53.0, 5.0), (47.0, 5.0), (50.0, 10.0), (50.0, 1.0)], []),  # a trap: a way out of 90 degrees
        ((80.0, 10.0), 1.0, [(82.0, 10.0)], [(81.0, 10.0)]),  # before goal, one opponent that goes away
        ((50.0, 34.0), 1.0, [], []),
        ((50.0, 34.0), 1.0, [(50.0, 34.0), (59.0, 34.0)], []),  # an opponent on the carrier, another far off
    ])
    rows = stories.checks(stories.scenes(points, carriers)).orderBy("frame_idx").collect()
    assert [r.triangle for r in rows] == ["", "ball_too_far_from_carrier+defenders_collinear", "", "no_real_cover_defender", "presser_too_far+no_real_cover_defender", "no_real_cover_defender+defenders_collinear"]
    few, way = "insufficient_defenders_for_trap", "escape_angle_too_large+no_directional_force"
    assert [r.trap for r in rows] == [f"{few}+{way}", f"ball_too_far_from_carrier+{few}+{way}", "", f"{few}+{way}", f"{few}+{way}", f"{few}+{way}"]
    assert [r.duel for r in rows] == ["second_defender_present", "ball_too_far_from_carrier+second_defender_present", "second_defender_present", "defender_not_engaging", "presser_too_far", ""]
    assert [r.goalmouth for r in rows][3:5] == ["", "not_in_attacking_third+no_presser+far_from_touchline"] and rows[0].goalmouth == "not_in_attacking_third+far_from_touchline"
    assert [r.carry for r in rows] == ["short_carry+pressed", "pressed", "short_carry+pressed", "", "short_carry", ""]
    assert (rows[2].escape_deg, rows[4].escape_deg, rows[0].escape_deg, rows[0].pressers, rows[1].carried_m) == (90.0, 360.0, 270.0, 2, 6.0)


def test_confidence_and_recovery(spark):
    points, carriers = scene(spark, [((50.0, 34.0), 1.0, [(52.0, 34.0), (50.0, 39.0)], [])])
    got = stories.checks(stories.scenes(points, carriers), F.lit(0.6), F.lit(0.8)).first()
    assert got.triangle == "low_homography_confidence+low_carrier_confidence"
    one = spark.range(1)
    run = lambda *v: one.select(stories.recovery_codes(*map(F.lit, v))).first()[0]
    assert run(6.0, 0.8, True, True, 1.0, 1.0) == "" and run(5.0, 0.8, False, True, 0.5, 1.0) == "low_carrier_confidence+speed_too_low+run_not_toward_own_goal"
    assert run(6.0, 0.6, True, False, 1.0, 0.1) == "low_homography_confidence+speed_too_low+no_transition_threat"
    assert stories.checks(stories.scenes(points.limit(0), carriers.limit(0))).count() == 0

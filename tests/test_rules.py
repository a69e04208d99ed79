"""Hand-made cases, one for each rule that is easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from pitchflow.functions import geometry as g
from pitchflow.operators import joins, physical, possession, prep, runs, tactics
from pitchflow.sources import readers


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


POINTS = "match_id string, track_id long, team_id long, frame_idx long, x double, y double"
BALL = "match_id string, frame_idx long, x double, y double, source string"


@pytest.mark.parametrize(("missing", "filled"), [(5, 5), (6, 0)])
def test_gap_of_five_is_filled_and_of_six_is_not(spark, missing, filled):
    p = df(spark, POINTS, ("m", 1, 0, 0, 0.0, 0.0), ("m", 1, 0, missing + 1, float(missing + 1), 0.0))
    out = prep.fill_gaps(p, ["match_id", "track_id"], 5)
    assert out.where("filled").count() == filled
    assert all(r.x == r.frame_idx for r in out.collect())


def test_equal_distance_goes_to_the_lower_track(spark):
    p = df(spark, POINTS, ("m", 9, 0, 0, 11.0, 10.0), ("m", 4, 1, 0, 9.0, 10.0))
    b = df(spark, BALL, ("m", 0, 10.0, 10.0, "yolo"))
    assert joins.carriers(p, b).first().carrier == 4


def test_limit_is_strict_and_depends_on_source(spark):
    p = df(spark, POINTS, ("m", 1, 0, 0, 3.0, 0.0), ("m", 1, 0, 1, 3.0, 0.0))
    b = df(spark, BALL, ("m", 0, 0.0, 0.0, "yolo"), ("m", 1, 0.0, 0.0, "hough_candidate"))
    assert [r.frame_idx for r in joins.carriers(p, b).collect()] == [1]


def test_streak_confirms_from_the_third_frame_without_back_fill(spark):
    p = df(spark, POINTS, *[("m", 1, 0, f, 0.0, 0.0) for f in range(5)])
    b = df(spark, BALL, *[("m", f, 0.0, 0.0, "yolo") for f in range(5)])
    assert sorted(r.frame_idx for r in possession.confirmed(p, b).collect()) == [2, 3, 4]


@pytest.mark.parametrize(("metres", "n"), [(2.0, 1), (1.99, 0)])
def test_pass_of_two_metres(spark, metres, n):
    s = "match_id string, run long, carrier long, team_id long, start_frame long, end_frame long, start_x double, start_y double, end_x double, end_y double"
    seq = df(spark, s, ("m", 1, 1, 0, 0, 5, 0.0, 0.0, 10.0, 0.0), ("m", 2, 2, 0, 20, 25, 10.0 + metres, 0.0, 20.0, 0.0))
    assert possession.passes(seq).count() == n


def test_speed_of_exactly_seven_is_no_sprint_and_three_slow_rows_end_a_burst(spark):
    s = "match_id string, track_id long, frame_idx long, speed_ms double"
    speeds = [8.0, 7.0, 7.0, 8.0, 7.0, None, 6.0, 8.0]
    out = physical.sprint_bursts(df(spark, s, *[("m", 1, f, v) for f, v in enumerate(speeds)]))
    assert sorted((r.start_frame, r.end_frame) for r in out.collect()) == [(0, 3), (7, 7)]


def test_cooldown_counts_from_the_last_kept(spark):
    rows = df(spark, "k string, f long", *[("a", f) for f in (0, 9, 10, 18, 20)])
    assert sorted(r.f for r in runs.cooldown(rows, ["k"], "f", 10).collect()) == [0, 10, 20]


@pytest.mark.parametrize(("players", "n"), [(6, 0), (7, 1)])
def test_formation_needs_seven_players(spark, players, n):
    p = df(spark, POINTS, *[("m", k, 0, 0, 10.0 * k, 5.0 * k) for k in range(players)])
    assert tactics.formations(p).count() == n


def test_voronoi_tie_goes_to_the_lower_track(spark):
    p = df(spark, POINTS, ("m", 1, 0, 0, 0.0, 34.0), ("m", 2, 1, 0, 0.0, 34.0), ("m", 3, 1, 0, 300.0, 300.0), ("m", 4, 1, 0, 300.0, 300.0))
    assert tactics.control_share(p).first().share == 1.0


def test_cut_resets_the_camera(spark):
    m = df(spark, "match_id string, frame_idx long, dx double, dy double, motion_class string", ("m", 0, 1.0, 0.0, "pan"), ("m", 5, 2.0, 0.0, "pan"), ("m", 10, 9.0, 0.0, "cut"), ("m", 15, 3.0, 0.0, "pan"))
    assert [r.off_x for r in prep.camera_offsets(m).orderBy("frame_idx").collect()] == [1.0, 3.0, 0.0, 3.0]


def test_matches_do_not_mix(spark):
    rows = [(m, 1, 0, f, float(f), 0.0) for m in ("a", "b") for f in range(6)]
    both = physical.steps(df(spark, POINTS, *rows)).orderBy("match_id", "frame_idx").collect()
    one = physical.steps(df(spark, POINTS, *rows[:6])).orderBy("frame_idx").collect()
    assert [r.speed_ms for r in both[:6]] == [r.speed_ms for r in one] == [r.speed_ms for r in both[6:]]


def test_xg_is_bounded_and_mirrored(spark):
    r = spark.range(1).select(g.expected_goals(F.lit(105.0), F.lit(34.0)).alias("a"), g.expected_goals(F.lit(100.0), F.lit(30.0)).alias("b"), g.expected_goals(F.lit(5.0), F.lit(38.0)).alias("c"), g.expected_goals(F.lit(52.0), F.lit(0.0)).alias("d")).first()
    assert 0.01 <= r.d < r.b <= 0.99 and r.b == pytest.approx(r.c) and 0.01 <= r.a <= 0.99


def test_vector_distances(spark):
    r = spark.range(1).select(*(f(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))).alias(n) for n, f, a, b in (("same", g.cosine, (1.0, 0.0), (1.0, 0.0)), ("ortho", g.cosine, (1.0, 0.0), (0.0, 1.0)), ("opposite", g.cosine, (1.0, 0.0), (-1.0, 0.0)), ("chi", g.chi_square, (1.0, 0.0), (1.0, 0.0)), ("bha", g.bhattacharyya, (0.5, 0.5), (0.5, 0.5))))).first()
    assert (r.same, r.ortho, r.opposite, r.chi) == (1.0, 0.0, -1.0, 0.0) and r.bha == pytest.approx(0.0, abs=1e-7)


def test_readers(spark, tmp_path):
    (tmp_path / "j1_final.json").write_text('{"tracks":[{"trackId":1,"teamId":0,"hits":2,"trajectory":[{"frameIndex":0,"bbox":[1,2,3,4],"confidence":0.5},{"frameIndex":1,"bbox":[1,2,3]}]}]}')
    points, heads = readers.read_tracks(spark, str(tmp_path / "j1_final.json"))
    assert [(r.match_id, r.track_id, r.frame_idx, r.x2) for r in points.collect()] == [("j1", 1, 0, 3.0)] and heads.first().team_id == 0
    (tmp_path / "j2.json").write_text('{"frames":[{"frameIndex":3,"players":[{"rawTrackId":7,"bbox":[0,0,2,4],"is_official":"False"},{"trackId":8,"bbox":{"x":1,"y":1,"w":2,"h":3}},{"trackId":9,"bbox":[1,2]},{"trackId":5,"bbox":[0,0,1,1],"is_official":"True"}]}]}')
    got = readers.read_frames(spark, str(tmp_path / "j2.json")).orderBy("raw_track_id").collect()
    assert [(r.raw_track_id, r.x2, r.y2) for r in got] == [(7, 2.0, 4.0), (8, 3.0, 4.0)]
    (tmp_path / "t1.json").write_text('[{"trackId":1,"teamId":1}]')
    (tmp_path / "t2.json").write_text('{"tracks":[{"track_id":2,"team_id":0}]}')
    assert sorted((r.match_id, r.track_id, r.team_id) for r in readers.read_teams(spark, str(tmp_path / "t[12].json")).collect()) == [("t1", 1, 1), ("t2", 2, 0)]
    (tmp_path / "e1.json").write_text('{"passes":[{"frame":4}],"shots":[{"type":"shot","frame":9}]}')
    assert sorted((r.type, r.frame) for r in readers.read_events(spark, str(tmp_path / "e1.json")).collect()) == [("passes", 4), ("shot", 9)]
    (tmp_path / "m1.json").write_text('{"5":{"dx":1.5,"dy":0,"motion_class":"pan"}}')
    assert readers.read_motion(spark, str(tmp_path / "m1.json")).first().frame_idx == 5
    (tmp_path / "p1.json").write_text('{"players":[{"trackId":-1,"trajectory2d":[{"frameIndex":0,"x":1,"y":2}]},{"trackId":3,"teamId":1,"trajectory2d":[{"frameIndex":0,"x":5,"y":6}]}],"homographies":{"0":[[1,0,0],[0,1,0],[0,0,1]]}}')
    pts, ball, hom = readers.read_pitch(spark, str(tmp_path / "p1.json"))
    assert (pts.first().x, ball.first().x, hom.first().h8) == (5.0, 1.0, 1.0)
    (tmp_path / "a.csv").write_text("event_id,action,thread_id,target_thread_id,segment_id,frame,reason,status,label,notes\n1,merge,a,b,,3,,needs_review,,\n2, ,a,b,,3,,needs_review,,\n")
    assert readers.read_actions(spark, str(tmp_path / "a.csv")).count() == 1
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "f1.txt").write_text("0 0.5 0.5 0.1 0.2\nbad\n")
    assert [(r.file, r.split, r.cls, r.h) for r in readers.read_labels(spark, str(tmp_path / "train")).collect()] == [("f1", "train", 0, 0.2)]

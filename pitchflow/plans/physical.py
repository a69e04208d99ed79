"""Queries of preparation, joins and physical load."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import joins, physical, prep
from ..sources.adapter import tables
from .registry import BURSTS, PHYSICAL, STEPS, W, carriers_sql, op


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def stepped(spark, d):
    return physical.steps(tables(spark, d, "points")[0])


def player_table(spark, d):
    s = stepped(spark, d)
    return physical.player_table(s, physical.sprint_bursts(s))


@op("p1_boxes", "SELECT match_id, frame_idx, raw_track_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, y2 AS foot_y, (x2 - x1) * (y2 - y1) AS area FROM players")
def p1(spark, d):
    cx, cy = g.box_centre()
    return tables(spark, d, "players")[0].select("match_id", "frame_idx", "raw_track_id", cx.alias("cx"), cy.alias("cy"), g.box_foot()[1].alias("foot_y"), g.box_area().alias("area"))


_NEAREST = """nh AS (SELECT p.*, h.frame_idx AS hf, h0, h1, h2, h3, h4, h5, h6, h7, h8 FROM points p JOIN homographies h ON h.match_id = p.match_id
AND h.frame_idx BETWEEN p.frame_idx - 200 AND p.frame_idx + 200 QUALIFY row_number() OVER (PARTITION BY p.match_id, p.track_id, p.frame_idx ORDER BY abs(h.frame_idx - p.frame_idx), h.frame_idx) = 1)"""


@op("p2_to_pitch", f"WITH {_NEAREST} SELECT match_id, track_id, frame_idx, greatest(least((h0 * (16 * x) + h1 * (12 * y) + h2) / (h6 * (16 * x) + h7 * (12 * y) + h8), 105e0), 0e0) AS pitch_x, "
    "round(greatest(least((h3 * (16 * x) + h4 * (12 * y) + h5) / (h6 * (16 * x) + h7 * (12 * y) + h8), 68e0), 0e0), 6) AS pitch_y FROM nh")  # fmt: skip
def p2(spark, d):
    points, hom = tables(spark, d, "points", "homographies")
    out = prep.to_pitch(points.withColumn("px", 16 * F.col("x")).withColumn("py", 12 * F.col("y")), hom)
    return r6(out.select("match_id", "track_id", "frame_idx", "pitch_x", "pitch_y"), "pitch_y")


@op("p30_to_pixel", f"WITH {_NEAREST} SELECT match_id, track_id, frame_idx, round((x - h2) / h0, 4) AS px, round((y - h5) / h4, 4) AS py FROM nh")
def p30(spark, d):
    points, hom = tables(spark, d, "points", "homographies")
    return prep.to_pixel(points, hom).select("match_id", "track_id", "frame_idx", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


@op("p5_central_points", "SELECT * FROM points WHERE x BETWEEN -5 AND 110 AND y BETWEEN -5 AND 73 AND y / 68e0 BETWEEN 0.15 AND 0.85")
def p5(spark, d):
    return tables(spark, d, "points")[0].where("x BETWEEN -5 AND 110 AND y BETWEEN -5 AND 73 AND y / 68e0 BETWEEN 0.15 AND 0.85")


@op("p6_on_pitch", "SELECT * FROM points WHERE x BETWEEN -3 AND 108 AND y BETWEEN -3 AND 71")
def p6(spark, d):
    return tables(spark, d, "points")[0].where(F.col("x").between(-3, 108) & F.col("y").between(-3, 71))


@op("p7_drop_staff", "WITH pt AS (SELECT match_id, track_id, avg(CASE WHEN x BETWEEN 0 AND 105 AND y BETWEEN 0 AND 68 THEN 1e0 ELSE 0e0 END) AS share, list_sort(list(x))[count(*) // 2 + 1] AS mx, list_sort(list(y))[count(*) // 2 + 1] AS my FROM points GROUP BY 1, 2) "
    "SELECT p.* FROM points p JOIN pt USING (match_id, track_id) WHERE share >= 0.3 AND ((mx BETWEEN -15 AND 120 AND my BETWEEN -15 AND 83) OR sqrt((mx - 52.5) * (mx - 52.5) + (my - 34) * (my - 34)) <= 20)")  # fmt: skip
def p7(spark, d):
    return prep.drop_staff(*tables(spark, d, "points", "tracks"))


@op("p8_enough_detections", "SELECT match_id, track_id, hits FROM (SELECT *, count(*) FILTER (hits >= 520) OVER (PARTITION BY match_id) AS n FROM tracks) t WHERE hits >= CASE WHEN n < 5 THEN 1 ELSE 520 END")
def p8(spark, d):
    return prep.enough_detections(tables(spark, d, "tracks")[0], least=520).select("match_id", "track_id", "hits")


_FILL = """fg AS (SELECT *, lead(frame_idx) OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM points WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame_idx)),
fe AS (SELECT *, unnest(CASE WHEN nf - frame_idx > 1 AND nf - frame_idx - 1 <= 45 THEN range(frame_idx, nf) ELSE [frame_idx] END) AS f FROM fg)"""


@op("p9_fill_gaps", f"WITH {_FILL} SELECT match_id, track_id, f AS frame_idx, round(CASE WHEN f = frame_idx THEN x ELSE x + (f - frame_idx) / (nf - frame_idx) * (nx - x) END, 6) AS x, "
    "round(CASE WHEN f = frame_idx THEN y ELSE y + (f - frame_idx) / (nf - frame_idx) * (ny - y) END, 6) AS y, f <> frame_idx AS filled FROM fe")  # fmt: skip
def p9(spark, d):
    return r6(prep.fill_gaps(tables(spark, d, "points")[0], physical.TRACK, 45), "x", "y")


@op("p10_densify", """WITH grid AS (SELECT t.match_id, t.track_id, unnest(range(0, m.frames_processed)) AS frame_idx FROM tracks t JOIN matches m USING (match_id)),
g1 AS (SELECT g.*, x, y, CASE WHEN x IS NOT NULL THEN g.frame_idx END AS own FROM grid g LEFT JOIN points p USING (match_id, track_id, frame_idx)),
g2 AS (SELECT *, last_value(own IGNORE NULLS) OVER a AS fa, last_value(x IGNORE NULLS) OVER a AS xa, last_value(y IGNORE NULLS) OVER a AS ya, first_value(own IGNORE NULLS) OVER b AS fb, first_value(x IGNORE NULLS) OVER b AS xb, first_value(y IGNORE NULLS) OVER b AS yb
FROM g1 WINDOW a AS (PARTITION BY match_id, track_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY match_id, track_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT match_id, track_id, frame_idx, round(CASE WHEN fa IS NULL THEN xb WHEN fb IS NULL OR fb = fa OR fb - fa > 10 THEN xa ELSE xa + (frame_idx - fa) / (fb - fa) * (xb - xa) END, 6) AS x,
round(CASE WHEN fa IS NULL THEN yb WHEN fb IS NULL OR fb = fa OR fb - fa > 10 THEN ya ELSE ya + (frame_idx - fa) / (fb - fa) * (yb - ya) END, 6) AS y FROM g2""")
def p10(spark, d):
    return r6(prep.densify(*tables(spark, d, "points", "matches")), "x", "y")


@op("p11_dedupe", "SELECT match_id, frame_idx, player_id, raw_track_id, identity_confidence FROM players QUALIFY row_number() OVER (PARTITION BY match_id, frame_idx, player_id ORDER BY identity_confidence DESC, raw_track_id) = 1")
def p11(spark, d):
    rows = prep.dedupe(tables(spark, d, "players")[0], ["match_id", "frame_idx", "player_id"], F.desc("identity_confidence"), F.col("raw_track_id"))
    return rows.select("match_id", "frame_idx", "player_id", "raw_track_id", "identity_confidence")


@op("p12_smoothers", f"""SELECT match_id, track_id, frame_idx, round(CASE WHEN row_number() OVER {W}) = 1 OR lead(x) OVER {W}) IS NULL THEN x ELSE avg(x) OVER {W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END, 6) AS mean3,
round(avg(x) OVER {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean5, quantile_cont(x, 0.5) OVER {W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS median3,
quantile_cont(x, 0.5) OVER {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS median5, round(CASE WHEN row_number() OVER {W}) < 15 THEN x ELSE avg(x) OVER {W} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) END, 6) AS trail15 FROM points""")
def p12(spark, d):
    p = tables(spark, d, "points")[0]
    out = p.select("match_id", "track_id", "frame_idx", *(prep.smoothed(p, "x", k).alias(k) for k in ("mean3", "mean5", "median3", "median5", "trail15")))
    return r6(out, "mean3", "mean5", "trail15")


@op("p13_reliability", f"""WITH q AS (SELECT *, (lead(frame_idx, 2) OVER {W}) - lag(frame_idx, 2) OVER {W})) / 25e0 AS dt, lead(x, 2) OVER {W}) - lag(x, 2) OVER {W}) AS dx, lead(y, 2) OVER {W}) - lag(y, 2) OVER {W}) AS dy FROM points)
SELECT match_id, track_id, frame_idx, coalesce(sqrt(dx * dx + dy * dy) / dt <= 35, true) AS reliable FROM q""")
def p13(spark, d):
    return prep.flag_unreliable(tables(spark, d, "points")[0]).select("match_id", "track_id", "frame_idx", "reliable")


@op("p14_heading", f"""WITH q AS (SELECT *, degrees(atan2(lead(y) OVER {W}) - y, lead(x) OVER {W}) - x)) AS h FROM points) SELECT match_id, track_id, frame_idx, round(coalesce(h, lag(h) OVER {W}), 0), 5) AS heading FROM q""")
def p14(spark, d):
    return prep.add_heading(tables(spark, d, "points")[0]).select("match_id", "track_id", "frame_idx", F.round("heading", 5).alias("heading"))


@op("p17_collisions", """WITH g AS MATERIALIZED (SELECT match_id, frame_idx, list({'t': track_id, 'x': x, 'y': y}) AS l FROM points WHERE frame_idx % 5 = 0 GROUP BY 1, 2)
SELECT p.match_id, p.track_id, p.frame_idx, p.x + 0.75 * n AS x, p.y, n AS conflicts FROM (SELECT p.*, coalesce(len(list_filter(l, lambda o: o.t < p.track_id AND sqrt((o.x - p.x) * (o.x - p.x) + (o.y - p.y) * (o.y - p.y)) < 1.5)), 0) AS n
FROM points p LEFT JOIN g ON g.match_id = p.match_id AND g.frame_idx = p.frame_idx) p""")
def p17(spark, d):
    return prep.separate_collisions(tables(spark, d, "points")[0]).select("match_id", "track_id", "frame_idx", "x", "y", "conflicts")


@op("p19_outliers", """WITH q AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM points WHERE frame_idx % 10 = 0 WINDOW w AS (PARTITION BY match_id, frame_idx, team_id))
SELECT match_id, track_id, frame_idx, round(sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), 6) AS off, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) > 40 AS outlier FROM q""")
def p19(spark, d):
    return r6(prep.flag_outliers(tables(spark, d, "points")[0]).select("match_id", "track_id", "frame_idx", "off", "outlier"), "off")


@op("p20_calibration", """WITH q AS (SELECT match_id, frame_idx, max(y) - min(y) AS spread, count(*) AS n FROM points GROUP BY 1, 2)
SELECT match_id, greatest(least(list_sort(list(50e0 / spread))[count(*) // 2 + 1], 1.2e0), 0.8e0) AS factor FROM q WHERE n >= 4 AND spread > 0 GROUP BY 1""")
def p20(spark, d):
    return prep.calibration_factor(tables(spark, d, "points")[0])


@op("p21_quality_marks", """WITH w AS (SELECT match_id, frame_idx // 25 AS win, count(*) >= 18 * 25 AS reliable FROM points GROUP BY 1, 2)
SELECT match_id, track_id, frame_idx, CASE WHEN reliable THEN 'metric' ELSE 'approximate' END AS quality FROM points p JOIN w ON w.match_id = p.match_id AND w.win = p.frame_idx // 25""".replace("SELECT match_id, track_id", "SELECT p.match_id, track_id"))
def p21(spark, d):
    points = tables(spark, d, "points")[0]
    windows = points.groupBy("match_id", F.floor(F.col("frame_idx") / 25).alias("win")).agg((F.count("*") >= 18 * 25).alias("reliable"))
    return prep.mark_quality(points, windows).select("match_id", "track_id", "frame_idx", "quality")


@op("p23_camera_offsets", """WITH s AS (SELECT *, sum(CASE WHEN motion_class = 'cut' THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY frame_idx) AS scene FROM motion)
SELECT match_id, frame_idx, CAST(scene AS BIGINT) AS scene, sum(CASE WHEN motion_class = 'cut' THEN 0 ELSE dx END) OVER (PARTITION BY match_id, scene ORDER BY frame_idx) AS off_x, sum(CASE WHEN motion_class = 'cut' THEN 0 ELSE dy END) OVER (PARTITION BY match_id, scene ORDER BY frame_idx) AS off_y FROM s""")
def p23(spark, d):
    return prep.camera_offsets(tables(spark, d, "motion")[0]).select("match_id", "frame_idx", "scene", "off_x", "off_y")


@op("p24_filter_ball", """WITH q AS (SELECT *, row_number() OVER w AS rn, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) / (frame_idx - lag(frame_idx) OVER w) AS step FROM ball WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)),
n AS (SELECT a.match_id, a.frame_idx, count(*) AS n, count(*) FILTER (sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.5) AS near FROM q a JOIN q b ON a.match_id = b.match_id AND b.rn BETWEEN a.rn - 50 AND a.rn - 1 GROUP BY 1, 2)
SELECT q.match_id, q.frame_idx, x, y FROM q LEFT JOIN n USING (match_id, frame_idx) WHERE x BETWEEN 0 AND 105 AND y BETWEEN 0 AND 68 AND coalesce(step <= 4, true) AND NOT (coalesce(n, 0) >= 30 AND near >= 0.8 * n)""")
def p24(spark, d):
    return prep.filter_ball(tables(spark, d, "ball")[0]).select("match_id", "frame_idx", "x", "y")


@op("p26_harden", f"""WITH hd AS (SELECT *, sqrt((x - lag(x) OVER {W})) * (x - lag(x) OVER {W})) + (y - lag(y) OVER {W})) * (y - lag(y) OVER {W}))) AS step, (frame_idx - lag(frame_idx) OVER {W})) / 25e0 AS dt FROM points),
{carriers_sql('2', 'c2')} SELECT h.match_id, track_id, h.frame_idx, h.x, h.y, round(coalesce(step / dt * 3.6, 0), 6) AS speed_kmh, coalesce(step > 0.5, false) AS is_active, coalesce(carrier = track_id, false) AS is_possession FROM hd h LEFT JOIN c2 c ON c.match_id = h.match_id AND c.frame_idx = h.frame_idx""")
def p26(spark, d):
    return r6(prep.harden(*tables(spark, d, "points", "ball")), "speed_kmh")


@op("p29_ball_arcs", """WITH q AS (SELECT match_id, frame_idx AS start_frame, lead(frame_idx) OVER w AS end_frame, sqrt((lead(x) OVER w - x) * (lead(x) OVER w - x) + (lead(y) OVER w - y) * (lead(y) OVER w - y)) AS metres FROM ball WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx))
SELECT match_id, start_frame, end_frame, round(metres, 6) AS metres, round(least(4e0, 0.08 * metres + 0.2), 6) AS apex_m FROM q WHERE metres >= 15 AND (end_frame - start_frame) / 25e0 >= 0.5 AND metres / ((end_frame - start_frame) / 25e0) >= 15""")
def p29(spark, d):
    return r6(prep.ball_arcs(tables(spark, d, "ball")[0]), "metres", "apex_m")


@op("p31_select_player", "SELECT * FROM points WHERE track_id = 7 AND frame_idx / 25e0 BETWEEN 2 AND 12")
def p31(spark, d):
    return tables(spark, d, "points")[0].where("track_id = 7 AND frame_idx / 25e0 BETWEEN 2 AND 12")


@op("j1_points_with_team", "SELECT p.match_id, p.track_id, frame_idx, coalesce(t.team_id, -1) AS team FROM points p LEFT JOIN (SELECT * FROM tracks WHERE track_id % 5 <> 0) t ON t.match_id = p.match_id AND t.track_id = p.track_id")
def j1(spark, d):
    points, tracks = tables(spark, d, "points", "tracks")
    known = tracks.where("track_id % 5 <> 0").select("match_id", "track_id", F.col("team_id").alias("t"))
    return points.join(known, physical.TRACK, "left").select("match_id", "track_id", "frame_idx", F.coalesce("t", F.lit(-1)).alias("team"))


@op("j3_nearest_within", """WITH fr AS (SELECT match_id, unnest(range(0, frames_processed, 25)) AS frame_idx FROM matches) SELECT f.match_id, f.frame_idx, p.track_id, p.frame_idx AS source_frame, p.x, p.y FROM fr f JOIN points p ON p.match_id = f.match_id AND p.frame_idx BETWEEN f.frame_idx - 4 AND f.frame_idx + 4
QUALIFY row_number() OVER (PARTITION BY f.match_id, f.frame_idx, p.track_id ORDER BY abs(p.frame_idx - f.frame_idx), p.frame_idx) = 1""")
def j3(spark, d):
    points, matches = tables(spark, d, "points", "matches")
    frames = matches.select("match_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames_processed") - 1, F.lit(25).cast("long"))).alias("frame_idx"))
    return joins.nearest_within(frames, points, ["track_id"], 4).select("match_id", "frame_idx", "track_id", "source_frame", "x", "y")


@op("j4_carriers", f"WITH {carriers_sql('''CASE source WHEN 'yolo' THEN 3 WHEN 'hough_candidate' THEN 5 ELSE 7 END''')} SELECT match_id, frame_idx, carrier, team_id, d FROM carriers")
def j4(spark, d):
    return joins.carriers(*tables(spark, d, "points", "ball")).select("match_id", "frame_idx", "carrier", "team_id", "d")


@op("j5_congestion", """WITH pr AS (SELECT a.match_id, a.frame_idx, a.raw_track_id AS ra, b.raw_track_id AS rb, sqrt(((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) * ((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) + ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) * ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2)) AS d,
greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i FROM players a JOIN players b ON a.match_id = b.match_id AND a.frame_idx = b.frame_idx AND a.raw_track_id < b.raw_track_id),
ends AS (SELECT match_id, frame_idx, unnest([ra, rb]) AS raw_track_id FROM pr WHERE d < 80 OR i / (2 * 1440e0 - i) >= 0.10) SELECT match_id, frame_idx, raw_track_id, count(*) AS neighbours, count(*) >= 3 AS congested FROM ends GROUP BY 1, 2, 3""")
def j5(spark, d):
    return joins.congestion(tables(spark, d, "players")[0])


@op("j6_passing_lanes", f"""WITH {carriers_sql('3', 'c3')}, mates AS (SELECT p.match_id, p.frame_idx, carrier AS passer, p.track_id AS receiver, sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) AS metres, c.x AS ax, c.y AS ay, p.x AS bx, p.y AS by_, c.team_id AS team
FROM points p JOIN c3 c ON c.match_id = p.match_id AND c.frame_idx = p.frame_idx WHERE p.team_id = c.team_id AND p.track_id <> carrier),
seg AS (SELECT m.*, o.x AS ox, o.y AS oy, CASE WHEN (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) > 0 THEN greatest(least(((o.x - ax) * (bx - ax) + (o.y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 1e0), 0e0) ELSE 0 END AS t
FROM mates m JOIN points o ON o.match_id = m.match_id AND o.frame_idx = m.frame_idx AND o.team_id <> m.team WHERE metres <= 30),
hit AS (SELECT DISTINCT match_id, frame_idx, receiver FROM seg WHERE sqrt((ox - (ax + t * (bx - ax))) * (ox - (ax + t * (bx - ax))) + (oy - (ay + t * (by_ - ay))) * (oy - (ay + t * (by_ - ay)))) < 2)
SELECT m.match_id, m.frame_idx, passer, m.receiver, metres, h.receiver IS NOT NULL AS blocked FROM mates m LEFT JOIN hit h USING (match_id, frame_idx, receiver) WHERE metres <= 30""")
def j6(spark, d):
    points, ball = tables(spark, d, "points", "ball")
    return joins.passing_lanes(points, joins.carriers(points, ball, 3.0))


@op("j11_merge_pairs", """WITH fr AS (SELECT match_id, raw_track_id AS track_id, min(frame_idx) AS first_seen, max(frame_idx) AS last_seen FROM players GROUP BY 1, 2)
SELECT a.match_id, a.track_id AS a, b.track_id AS b, b.first_seen - a.last_seen AS gap FROM fr a JOIN fr b ON a.match_id = b.match_id AND a.track_id <> b.track_id WHERE b.first_seen - a.last_seen BETWEEN 0 AND 120""")
def j11(spark, d):
    t = tables(spark, d, "players")[0].groupBy("match_id", F.col("raw_track_id").alias("track_id")).agg(F.min("frame_idx").alias("first_seen"), F.max("frame_idx").alias("last_seen"))
    return joins.fragments_to_merge(t).select("match_id", "a", "b", "gap")


@op("j13_timeline", """WITH fr AS (SELECT match_id, unnest(range(0, frames_processed)) AS frame_idx FROM matches), n AS (SELECT match_id, frame_idx, count(*) AS n, string_agg(track_id, ',' ORDER BY track_id) AS ids FROM points GROUP BY 1, 2)
SELECT match_id, frame_idx, coalesce(n, 0) AS players, coalesce(ids, '') AS ids, b.x AS ball_x FROM fr LEFT JOIN n USING (match_id, frame_idx) LEFT JOIN ball b USING (match_id, frame_idx)""")
def j13(spark, d):
    out = joins.timeline(*tables(spark, d, "points", "ball", "matches"))
    return out.select("match_id", "frame_idx", F.size("players").cast("long").alias("players"), F.array_join(F.transform("players", lambda p: p["track_id"].cast("string")), ",").alias("ids"), F.col("ball.x").alias("ball_x"))


@op("j14_without_officials", "SELECT match_id, frame_idx, raw_track_id FROM (SELECT *, max(CASE WHEN is_official THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, frame_idx, raw_track_id) AS o FROM players) q WHERE o = 0")
def j14(spark, d):
    p = tables(spark, d, "players")[0]
    keys = ["match_id", "frame_idx", "raw_track_id"]
    return p.join(p.where("is_official").select(*keys), keys, "left_anti").select(*keys)


@op("w1_steps", f"WITH {STEPS} SELECT match_id, track_id, frame_idx, dt_s, step_m, speed_ms FROM steps")
def w1(spark, d):
    return stepped(spark, d).select("match_id", "track_id", "frame_idx", "dt_s", "step_m", "speed_ms")


@op("w8_sprint_bursts", f"WITH {STEPS}, {BURSTS} SELECT * FROM bursts")
def w8(spark, d):
    return physical.sprint_bursts(stepped(spark, d))


@op("w10_high_intensity", f"""WITH {STEPS}, q AS (SELECT *, coalesce(speed_ms >= 5.5, false) AS hi, max(speed_ms) OVER {W} RANGE BETWEEN 25 PRECEDING AND CURRENT ROW) AS roll FROM steps), e AS (SELECT *, hi AND NOT coalesce(lag(hi) OVER {W}), false) AS edge FROM q)
SELECT match_id, track_id, count(*) FILTER (edge) AS runs, max(roll) AS top_ms FROM e GROUP BY 1, 2""")
def w10(spark, d):
    return physical.high_intensity_runs(stepped(spark, d))


@op("w11_block_speed", """WITH b AS (SELECT match_id, track_id, frame_idx // 5 AS block, min(frame_idx) AS f0, max(frame_idx) AS f1, min_by(x, frame_idx) AS ax, min_by(y, frame_idx) AS ay, max_by(x, frame_idx) AS zx, max_by(y, frame_idx) AS zy FROM points GROUP BY 1, 2, 3),
s AS (SELECT *, sqrt((ax - zx) * (ax - zx) + (ay - zy) * (ay - zy)) AS metres FROM b WHERE f1 > f0) SELECT match_id, track_id, block, round(metres / ((f1 - f0) / 25e0) * 3.6, 6) AS speed_kmh, round(sum(metres) OVER (PARTITION BY match_id, track_id ORDER BY block), 6) AS total_m FROM s""")
def w11(spark, d):
    return r6(physical.block_speed(tables(spark, d, "points")[0]), "speed_kmh", "total_m")


@op("a1_heatmap", """WITH c AS (SELECT match_id, track_id, CAST(least(greatest(floor(x / 105 * 21), 0), 20) AS BIGINT) AS col, CAST(least(greatest(floor(y / 68 * 14), 0), 13) AS BIGINT) AS row_, count(*) AS n FROM points GROUP BY 1, 2, 3, 4)
SELECT match_id, track_id, col, row_ AS "row", n, n / max(n) OVER (PARTITION BY match_id, track_id) AS heat FROM c""")
def a1(spark, d):
    return physical.heatmap(tables(spark, d, "points")[0], physical.TRACK)


@op("a1_team_heatmap", """WITH c AS (SELECT match_id, team_id, CAST(least(greatest(floor(x / 105 * 10), 0), 9) AS BIGINT) AS col, CAST(least(greatest(floor(y / 68 * 10), 0), 9) AS BIGINT) AS row_, count(*) AS n FROM points GROUP BY 1, 2, 3, 4)
SELECT match_id, team_id, col, row_ AS "row", n, n / max(n) OVER (PARTITION BY match_id, team_id) AS heat FROM c""")
def a1_team(spark, d):
    return physical.heatmap(tables(spark, d, "points")[0], ["match_id", "team_id"], 10, 10)


_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("distance_m", "sprint_m", "high_intensity_m", "mean_ms"))


@op("a2_player_physical", f"WITH {STEPS}, {BURSTS}, {PHYSICAL} SELECT match_id, track_id, team_id, {_ROUNDED}, top_ms, sprints FROM physical")
def a2(spark, d):
    return r6(player_table(spark, d), "distance_m", "sprint_m", "high_intensity_m", "mean_ms")


@op("a3_totals", f"""WITH {STEPS}, {BURSTS}, {PHYSICAL} SELECT match_id, team_id, track_id, round(sum(distance_m), 5) AS distance_m, max(top_ms) AS top_ms, CAST(sum(sprints) AS BIGINT) AS sprints, count(*) AS players, CAST(grouping(match_id, team_id, track_id) AS BIGINT) AS level
FROM physical GROUP BY GROUPING SETS ((match_id), (match_id, team_id), (match_id, team_id, track_id))""")
def a3(spark, d):
    return physical.totals(player_table(spark, d)).withColumn("distance_m", F.round("distance_m", 5))


@op("a5_team_summary", f"""WITH {STEPS}, {BURSTS}, {PHYSICAL} SELECT match_id, team_id, round(sum(distance_m), 5) AS distance_m, round(avg(distance_m), 5) AS mean_distance_m, max(top_ms) AS top_ms,
arg_max(track_id, (sprints, -track_id)) AS top_sprinter, arg_max(track_id, (round(distance_m, 3), -track_id)) AS top_runner FROM physical GROUP BY 1, 2""")
def a5(spark, d):
    return physical.team_summary(player_table(spark, d)).withColumns({c: F.round(c, 5) for c in ("distance_m", "mean_distance_m")})


@op("a18_positions", """WITH q AS (SELECT match_id, track_id, team_id, avg(CASE WHEN team_id = 0 THEN x ELSE 105 - x END) AS mean_x FROM points GROUP BY 1, 2, 3) SELECT *, CASE WHEN mean_x < 35 THEN 'Defender' WHEN mean_x < 70 THEN 'Midfielder' ELSE 'Forward' END AS position FROM q""")
def a18(spark, d):
    return physical.position_label(tables(spark, d, "points")[0])


@op("io11_base_match", "SELECT base, max_by(suffix, (suffix = '', suffix)) AS chosen, count(*) AS n FROM (SELECT regexp_replace(match_id || s.suffix, '(_final_tactics|_final_pitch|_final|_tactics|_pitch)$', '') AS base, s.suffix FROM matches, (VALUES (''), ('_final'), ('_pitch')) s(suffix)) q GROUP BY 1")
def io11(spark, d):
    from ..sources.readers import base_match_id

    m = tables(spark, d, "matches")[0].select("match_id", F.explode(F.array(F.lit(""), F.lit("_final"), F.lit("_pitch"))).alias("suffix"))
    m = m.withColumn("base", base_match_id(F.concat("match_id", "suffix")))
    return m.groupBy("base").agg(F.max_by("suffix", F.struct(F.col("suffix") == "", "suffix")).alias("chosen"), F.count("*").alias("n"))


@op("io12_merge_chunks", """WITH c AS (SELECT *, frame_idx // 200 AS chunk, frame_idx % 200 AS f FROM points), mx AS (SELECT match_id, chunk, max(track_id) + 1 AS ids FROM c GROUP BY 1, 2),
o AS (SELECT *, coalesce(sum(ids) OVER (PARTITION BY match_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM mx) SELECT c.match_id, CAST(c.track_id + off AS BIGINT) AS track_id, f + 200 * c.chunk AS frame_idx, x, y FROM c JOIN o USING (match_id, chunk)""")
def io12(spark, d):
    from ..sources.readers import merge_chunks

    p = tables(spark, d, "points")[0]
    chunks = p.withColumn("chunk", F.floor(F.col("frame_idx") / 200)).withColumn("frame_idx", F.col("frame_idx") % 200)
    return merge_chunks(chunks, 200).select("match_id", "track_id", "frame_idx", "x", "y")

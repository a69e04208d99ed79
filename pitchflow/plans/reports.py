"""Queries of composites and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import joins, possession, quality, reports
from ..sources.adapter import tables
from ..sources.shared import shared_dir
from ..streaming import jobs
from .events import _CHG, _EVS, _KEYED, _SEG, _SHOTS, _SIT, _SWITCH, _XGD, arriving, conflicts, events, held, segments, seq, speeds
from .physical import player_table, r6
from .registry import BURSTS, HELD, M, NEXT, PASSES, PHYSICAL, SEQ, SPEED, STEPS, TURNOVERS, W, carriers_sql, fold_sql, held_sql, op



@op("p3_world_fraction", """WITH q AS (SELECT match_id, frame_idx, raw_track_id, (x1 + x2) / 2 / 1920e0 * (105e0 * 0.8e0) AS wx, (y1 + y2) / 2 / 1080e0 * (68e0 * 0.8e0) AS wy FROM players)
SELECT match_id, frame_idx, raw_track_id, round(greatest(least(wx, 110e0), -5e0), 6) AS world_x, round(greatest(least(wy, 73e0), -5e0), 6) AS world_y, wx NOT BETWEEN -5 AND 110 OR wy NOT BETWEEN -5 AND 73 AS corrected FROM q""")
def p3(spark, d):
    out = reports.to_world_fraction(tables(spark, d, "players")[0], 0.8)
    return r6(out.select("match_id", "frame_idx", "raw_track_id", "world_x", "world_y", "corrected"), "world_x", "world_y")


@op("p4_ball_to_pitch", "SELECT match_id, frame_idx, round(x * 30 / 3840e0 * 105, 6) AS x, round(y * 28 / 2160e0 * 68, 6) AS y FROM ball")
def p4(spark, d):
    b = tables(spark, d, "ball")[0].withColumn("px", F.col("x") * 30).withColumn("py", F.col("y") * 28)
    return r6(reports.ball_to_pitch(b).select("match_id", "frame_idx", "x", "y"), "x", "y")


@op("p28_ball_heights", f"""WITH v0 AS (SELECT match_id, frame_idx, x, y, (lead(frame_idx) OVER {M}) - frame_idx) / 25e0 AS dt, lead(x) OVER {M}) - x AS dx, lead(y) OVER {M}) - y AS dy FROM ball), v1 AS (SELECT *, dx / dt AS vx, dy / dt AS vy, sqrt(dx / dt * (dx / dt) + dy / dt * (dy / dt)) AS v FROM v0),
v2 AS (SELECT *, avg(v) OVER {M} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM v1), v3 AS (SELECT *, lag(vx) OVER {M}) AS px, lag(vy) OVER {M}) AS py, lag(s) OVER {M}) AS ps FROM v2),
v4 AS (SELECT *, coalesce(px IS NOT NULL AND v IS NOT NULL AND ps >= 1e-3 AND s >= 1e-3 AND (greatest(least((px * vx + py * vy) / (ps * s), 1e0), -1e0) < cos(radians(45)) OR abs(s - ps) / ps > 0.6), false) AS cut, row_number() OVER {M}) AS rn FROM v3),
cuts AS (SELECT match_id, rn FROM v4 WHERE cut UNION SELECT match_id, min(rn) FROM v4 GROUP BY 1 UNION SELECT match_id, max(rn) FROM v4 GROUP BY 1), arcs AS (SELECT match_id, rn AS a, lead(rn) OVER (PARTITION BY match_id ORDER BY rn) AS b FROM cuts),
len AS (SELECT r.match_id, r.a, r.b, min(v.frame_idx) AS f0, max(v.frame_idx) AS f1, sum(CASE WHEN v.rn < r.b THEN sqrt(v.dx * v.dx + v.dy * v.dy) ELSE 0 END) AS metres FROM arcs r JOIN v4 v ON v.match_id = r.match_id AND v.rn BETWEEN r.a AND r.b WHERE r.b - r.a >= 2 GROUP BY 1, 2, 3),
fly AS (SELECT * FROM len WHERE (f1 - f0) / 25e0 BETWEEN 0.3 AND 4 AND metres / ((f1 - f0) / 25e0) >= 8)
SELECT v.match_id, v.frame_idx, round(coalesce(max(greatest(0e0, 9.81e0 / 2 * (v.frame_idx / 25e0 - f0 / 25e0) * (f1 / 25e0 - v.frame_idx / 25e0))), 0e0), 3) AS z FROM v4 v LEFT JOIN fly f ON f.match_id = v.match_id AND v.rn BETWEEN f.a AND f.b GROUP BY 1, 2""")
def p28(spark, d):
    return reports.ball_heights(tables(spark, d, "ball")[0])


_PATH = f"pt0 AS (SELECT *, coalesce(sqrt((x - lag(x) OVER {W})) * (x - lag(x) OVER {W})) + (y - lag(y) OVER {W})) * (y - lag(y) OVER {W}))), 0) AS step FROM points), pt AS (SELECT *, sum(step) OVER {W} ROWS UNBOUNDED PRECEDING) AS path FROM pt0)"


@op("e11_long_runs", f"""WITH {_PATH}, e AS (SELECT a.match_id, a.track_id, a.frame_idx, a.path, coalesce(min(b.frame_idx) FILTER (b.frame_idx >= a.frame_idx + 75), max(b.frame_idx)) AS ef FROM pt a JOIN pt b ON a.match_id = b.match_id AND a.track_id = b.track_id AND b.frame_idx BETWEEN a.frame_idx AND a.frame_idx + 175 GROUP BY 1, 2, 3, 4),
m AS (SELECT e.*, p.path - e.path AS metres FROM e JOIN pt p ON p.match_id = e.match_id AND p.track_id = e.track_id AND p.frame_idx = ef)
SELECT match_id, track_id, frame_idx AS start_frame, ef AS end_frame, round(metres, 5) AS metres, round(least(1e0, metres / 30), 3) AS score FROM m WHERE metres >= 15 QUALIFY row_number() OVER (PARTITION BY match_id, track_id ORDER BY frame_idx) = 1""")
def e11_runs(spark, d):
    return reports.long_runs(tables(spark, d, "points")[0])


@op("e11_penetrating_runs", """WITH q AS (SELECT a.match_id, a.track_id, a.frame_idx, min(b.frame_idx) AS ef, arg_min(b.x, b.frame_idx) AS ex FROM points a JOIN points b ON a.match_id = b.match_id AND a.track_id = b.track_id AND b.frame_idx BETWEEN a.frame_idx + 1 AND a.frame_idx + 100 AND b.x > 85 WHERE a.x < 70 GROUP BY 1, 2, 3)
SELECT match_id, track_id, frame_idx AS start_frame, ef AS end_frame, round(0.7e0 + least(0.3e0, (ex - 85) / 20), 3) AS score FROM q QUALIFY row_number() OVER (PARTITION BY match_id, track_id ORDER BY frame_idx) = 1""")
def e11_penetrating(spark, d):
    return reports.penetrating_runs(tables(spark, d, "points")[0])


@op("e11_bursts", f"""WITH q AS (SELECT match_id, track_id, frame_idx, sqrt((lead(x) OVER {W}) - x) * (lead(x) OVER {W}) - x) + (lead(y) OVER {W}) - y) * (lead(y) OVER {W}) - y)) / ((lead(frame_idx) OVER {W}) - frame_idx) / 25e0) AS v FROM points),
m AS (SELECT *, round(avg(v) OVER {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS m, count(v) OVER {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM q WHERE v IS NOT NULL)
SELECT match_id, track_id, arg_max(frame_idx, (m, -frame_idx)) AS peak_frame, max(m) AS peak_ms, round(least(1e0, max(m) / 15), 3) AS score FROM m WHERE n = 5 GROUP BY 1, 2 HAVING max(m) >= 8""")
def e11_bursts(spark, d):
    return reports.bursts(tables(spark, d, "points")[0])


@op("j7_event_windows", f"""WITH {_EVS}, n AS (SELECT e.match_id, e.frame_idx AS event_frame, e.kind, p.track_id, count(*) AS rows FROM evs e JOIN points p ON p.match_id = e.match_id AND p.frame_idx BETWEEN e.frame_idx AND e.frame_idx + 37 GROUP BY 1, 2, 3, 4)
SELECT *, row_number() OVER (PARTITION BY match_id, event_frame, kind ORDER BY rows DESC, track_id) AS place FROM n QUALIFY row_number() OVER (PARTITION BY match_id, event_frame, kind ORDER BY rows DESC, track_id) <= 3""")
def j7(spark, d):
    return reports.event_windows(events(spark, d), tables(spark, d, "points")[0])


@op("j8_nearest_mates", f"WITH {carriers_sql('3', 'c3')} SELECT c.match_id, c.frame_idx, carrier, p.track_id AS mate, sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) AS d FROM c3 c JOIN points p ON p.match_id = c.match_id AND p.frame_idx = c.frame_idx AND p.team_id = c.team_id AND p.track_id <> carrier WHERE sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) <= 12 QUALIFY row_number() OVER (PARTITION BY c.match_id, c.frame_idx ORDER BY sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)), p.track_id) = 1")
def j8(spark, d):
    points, ball = tables(spark, d, "points", "ball")
    return reports.nearest_mates(points, joins.carriers(points, ball, 3.0))


@op("j9_around_ball", """WITH q AS (SELECT p.match_id, p.frame_idx, p.track_id, p.team_id, sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)) AS d FROM points p JOIN ball b USING (match_id, frame_idx)), n AS (SELECT * FROM q WHERE d <= 12 * 1.3e0),
c AS (SELECT *, d <= 12 AND row_number() OVER (PARTITION BY match_id, frame_idx, team_id ORDER BY d, track_id) <= 4 AS core FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY match_id, frame_idx ORDER BY core DESC, d, track_id) AS place FROM c) SELECT * FROM p WHERE place <= 8 OR core""")
def j9(spark, d):
    return reports.around_ball(*tables(spark, d, "points", "ball"))


_FULL = f"{STEPS}, {BURSTS}, {PHYSICAL}, {_EVS}, {_SHOTS}, {fold_sql('shotf', 'match_id', 'frame_idx', 30, 'kept')}"
_SHOT = f"""sq AS (SELECT *, {_XGD} AS d FROM kept), nb AS (SELECT k.match_id, k.frame_idx, p.team_id FROM kept k JOIN ball b ON b.match_id = k.match_id AND b.frame_idx BETWEEN k.frame_idx - 10 AND k.frame_idx JOIN points p ON p.match_id = b.match_id AND p.frame_idx = b.frame_idx
WHERE sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)) < 5 QUALIFY row_number() OVER (PARTITION BY k.match_id, k.frame_idx ORDER BY k.frame_idx - b.frame_idx, sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)), p.track_id) = 1),
shots AS (SELECT s.match_id, n.team_id, greatest(least(1 / (1 + exp(-(-1.5 - 0.08 * d + 1.2 * CASE WHEN d < 0.01 THEN pi() / 2 ELSE atan(7.32 * d / (d * d + 3.66 * 3.66)) END))), 0.99e0), 0.01e0) AS xg FROM sq s JOIN nb n USING (match_id, frame_idx))"""


def shots(spark, d):
    return possession.shots(speeds(spark, d), tables(spark, d, "points")[0])


@op("a8_xg_totals", f"WITH {SPEED}, {_SHOTS}, {fold_sql('shotf', 'match_id', 'frame_idx', 30, 'kept')}, {_SHOT} SELECT match_id, team_id, round(sum(xg), 5) AS xg, count(*) AS shots, count(*) FILTER (xg >= 0.15) AS big_chances FROM shots GROUP BY 1, 2")
def a8(spark, d):
    s = shots(spark, d).where("team_id IS NOT NULL")
    return s.groupBy("match_id", "team_id").agg(F.round(F.sum("xg"), 5).alias("xg"), F.count("*").alias("shots"), F.count_if(F.col("xg") >= 0.15).alias("big_chances"))


@op("a24_match_summary", f"""WITH {_FULL}, {_SHOT}, ld AS (SELECT match_id, team_id, sum(distance_m) AS distance_m, max(top_ms) AS top_ms, CAST(sum(sprints) AS BIGINT) AS sprints FROM physical GROUP BY 1, 2), pp AS (SELECT match_id, team_id, count(*) AS passes FROM passes GROUP BY 1, 2), tt AS (SELECT match_id, team_id, count(*) AS won FROM turnovers GROUP BY 1, 2),
xx AS (SELECT match_id, team_id, sum(xg) AS xg, count(*) AS shots, count(*) FILTER (xg >= 0.15) AS big_chances FROM shots GROUP BY 1, 2), fr AS (SELECT match_id, unnest(range(0, frames_processed)) AS frame_idx FROM matches),
ct AS (SELECT f.match_id, last_value(team_id IGNORE NULLS) OVER (PARTITION BY f.match_id ORDER BY f.frame_idx) AS team_id FROM fr f LEFT JOIN held h ON h.match_id = f.match_id AND h.frame_idx = f.frame_idx), cc AS (SELECT match_id, team_id, count(*) / sum(count(*)) OVER (PARTITION BY match_id) AS control FROM ct WHERE team_id IS NOT NULL GROUP BY 1, 2),
ok AS (SELECT match_id, valid_frames / frames_processed >= 0.9 AS usable FROM matches)
SELECT match_id, team_id, CASE WHEN usable THEN round(distance_m, 4) END AS distance_m, CASE WHEN usable THEN round(top_ms, 4) END AS top_ms, CASE WHEN usable THEN sprints END AS sprints, coalesce(passes, 0) AS passes, coalesce(won, 0) AS won, round(coalesce(xg, 0), 4) AS xg, coalesce(shots, 0) AS shots, coalesce(big_chances, 0) AS big_chances, round(coalesce(control, 0), 6) AS control
FROM ld LEFT JOIN pp USING (match_id, team_id) LEFT JOIN tt USING (match_id, team_id) LEFT JOIN xx USING (match_id, team_id) LEFT JOIN cc USING (match_id, team_id) LEFT JOIN ok USING (match_id)""")
def a24(spark, d):
    matches = tables(spark, d, "matches")[0]
    s = seq(spark, d)
    ok = matches.select("match_id", (F.col("valid_frames") / F.col("frames_processed") >= 0.9).alias("usable"))
    return reports.match_summary(player_table(spark, d), possession.passes(s), possession.turnovers(s, speeds(spark, d)), shots(spark, d), possession.control(held(spark, d), matches), ok)


@op("a27_report_cards", f"""WITH {STEPS}, {BURSTS}, {PHYSICAL}, {_EVS}, crs AS (SELECT match_id, carrier AS track_id, count(*) AS carries FROM seq WHERE duration >= 5 AND sqrt((start_x - end_x) * (start_x - end_x) + (start_y - end_y) * (start_y - end_y)) > 5 GROUP BY 1, 2)
SELECT p.match_id, p.track_id, p.team_id, round(distance_m, 3) AS distance_m, sprints, coalesce(made, 0) AS made, coalesce(received, 0) AS received, coalesce(carries, 0) AS carries, coalesce(won, 0) AS won FROM physical p LEFT JOIN (SELECT match_id, passer AS track_id, count(*) AS made FROM passes GROUP BY 1, 2) a USING (match_id, track_id)
LEFT JOIN (SELECT match_id, receiver AS track_id, count(*) AS received FROM passes GROUP BY 1, 2) b USING (match_id, track_id) LEFT JOIN crs USING (match_id, track_id) LEFT JOIN (SELECT match_id, player AS track_id, count(*) AS won FROM turnovers GROUP BY 1, 2) w USING (match_id, track_id)""")
def a27(spark, d):
    s = seq(spark, d)
    return reports.report_card(player_table(spark, d), possession.passes(s), possession.carries(s), possession.turnovers(s, speeds(spark, d)))


_NEEDS = ", ".join(f"('{k}', {v}, {str(k in reports.WORLD_SERVICES).lower()})" for k, v in reports.MINIMUM_FRAMES.items())


@op("a21_service_confidence", f"""WITH need AS (SELECT * FROM (VALUES {_NEEDS}) v(service, frames_required, world)), {_SWITCH}, tq AS (SELECT match_id, avg(hits) AS ml, count(*) FILTER (hits >= 5) AS stable, count(*) FILTER (team_id = 0) AS t0, count(*) FILTER (team_id = 1) AS t1 FROM tracks GROUP BY 1),
bc AS (SELECT match_id, count(*) AS nb FROM ball GROUP BY 1), hc AS (SELECT match_id, count(*) AS nh FROM homographies GROUP BY 1),
a AS (SELECT m.match_id, service, frames_required AS fr, world, frames_processed AS f, valid_frames / frames_processed < 0.5 AS inv, coalesce(nh, 0) > 0 AS cal, coalesce(nb, 0) / frames_processed >= 0.05 AS ok, coalesce(nb, 0) > 0 AS seen, coalesce(id_switches, 0) AS sw, ml, stable, greatest(t0, t1) / nullif(t0 + t1, 0) > 0.7 AS imb
FROM matches m JOIN tq USING (match_id) LEFT JOIN sw USING (match_id) LEFT JOIN bc USING (match_id) LEFT JOIN hc USING (match_id), need),
r AS (SELECT *, concat_ws('+', CASE WHEN inv THEN 'invalid_frames' END, CASE WHEN sw > 50 THEN 'id_churn' END, CASE WHEN ml < 10 THEN 'short_tracks' END, CASE WHEN stable < 10 THEN 'few_stable_tracks' END, CASE WHEN f < fr THEN 'few_frames' END, CASE WHEN NOT cal THEN 'no_calibration' END,
CASE WHEN seen AND NOT ok THEN 'ball_coverage' END, CASE WHEN NOT ok AND cal THEN 'no_ball' END, CASE WHEN imb THEN 'team_imbalance' END) AS reasons FROM a),
c AS (SELECT *, CASE WHEN inv THEN 'low' WHEN world AND NOT (cal AND ok) OR f < fr * 0.5 THEN 'unavailable' WHEN f < fr THEN 'low' WHEN reasons <> '' THEN 'medium' ELSE 'high' END AS confidence FROM r)
SELECT match_id, service, fr AS frames_required, confidence, CASE WHEN inv THEN f >= fr * 0.5 ELSE confidence <> 'unavailable' END AS usable, reasons FROM c""")
def a21(spark, d):
    points, tracks, matches, players, ball, maps = tables(spark, d, "points", "tracks", "matches", "players", "ball", "homographies")
    return reports.service_confidence(quality.tracking_quality(points, tracks, matches, players), matches, tracks, ball, maps)


@op("a29_agreement", """WITH r AS (SELECT match_id, track_id, frame_idx % 3 AS run, max(x) - min(x) AS value FROM points GROUP BY 1, 2, 3) SELECT match_id, track_id, median(value) AS median, CASE WHEN max(value) = 0 THEN true ELSE (max(value) - min(value)) / max(value) <= 0.1 END AS confirmed FROM r GROUP BY 1, 2""")
def a29(spark, d):
    runs = tables(spark, d, "points")[0].groupBy("match_id", "track_id", (F.col("frame_idx") % 3).alias("run")).agg((F.max("x") - F.min("x")).alias("value"))
    return quality.agreement(runs)


@op("a30_fingerprint", f"""WITH {STEPS}, {BURSTS}, {PHYSICAL}, {SPEED}, {_SIT}, {_SEG}, w AS (SELECT match_id, frame_idx, team_id, max(y) - min(y) AS width FROM points GROUP BY 1, 2, 3), wd AS (SELECT match_id, team_id, avg(width) AS width FROM w GROUP BY 1, 2),
ts AS (SELECT match_id, team_id, sum(sprints) AS sprints, max(top_ms) AS top_ms FROM physical GROUP BY 1, 2), ph AS (SELECT s.match_id, label, sum(end_frame - start_frame + 1) AS frames FROM segs s GROUP BY 1, 2), mp AS (SELECT match_id, label FROM ph QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY frames DESC, label DESC) = 1),
pm AS (SELECT label FROM mp GROUP BY 1 ORDER BY count(*) DESC, label DESC LIMIT 1) SELECT a.team_id, round(avg(width), 4) AS width, CASE WHEN count(*) >= 2 THEN round(avg(sprints), 4) END AS sprints, list_sort(list(top_ms))[count(*) // 2 + 1] AS top_ms, (SELECT label FROM pm) AS phase FROM wd a JOIN ts USING (match_id, team_id) GROUP BY 1""")
def a30(spark, d):
    points = tables(spark, d, "points")[0]
    per = points.groupBy("match_id", "frame_idx", "team_id").agg((F.max("y") - F.min("y")).alias("width"))
    widths = per.groupBy("match_id", "team_id").agg(F.avg("width").alias("width"))
    team = player_table(spark, d).groupBy("match_id", "team_id").agg(F.sum("sprints").alias("sprints"), F.max("top_ms").alias("top_ms"))
    phases = segments(spark, d).groupBy("match_id", "label").agg(F.sum(F.col("end_frame") - F.col("start_frame") + 1).alias("frames"))
    return reports.fingerprint(widths, team, phases, team)


@op("i14_case_files", f"""WITH {_CHG}, att AS (SELECT DISTINCT match_id, frame_idx AS cf, o AS offs FROM (SELECT DISTINCT match_id, frame_idx FROM conf WHERE conflict = 'duplicate_id') c, (VALUES (-10), (-5), (0), (5), (10)) v(o)),
n AS (SELECT a.match_id, a.cf, a.offs, p.track_id, p.x, p.y FROM att a JOIN points p ON p.match_id = a.match_id AND p.frame_idx BETWEEN a.cf + a.offs - 2 AND a.cf + a.offs + 2 QUALIFY row_number() OVER (PARTITION BY a.match_id, a.cf, a.offs, p.track_id ORDER BY abs(p.frame_idx - a.cf - a.offs), p.frame_idx) = 1)
SELECT match_id, cf AS conflict_frame, offs AS "offset", count(*) AS players, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y FROM n GROUP BY 1, 2, 3""")
def i14(spark, d):
    found = conflicts(spark, d).where("conflict = 'duplicate_id'")
    return reports.case_files(found, tables(spark, d, "points")[0])


@op("e10_possession_changes", f"""WITH {HELD}, q AS (SELECT *, lag(carrier) OVER {M}) AS pc, lag(team_id) OVER {M}) AS pt FROM held) SELECT match_id, frame_idx, pc AS from_player, carrier AS to_player, CASE WHEN pt = team_id THEN 'pass' ELSE 'change' END AS kind FROM q WHERE pc <> carrier""")
def e10(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("match_id").orderBy("frame_idx")
    h = held(spark, d).withColumns({"pc": F.lag("carrier").over(w), "pt": F.lag("team_id").over(w)}).where("pc <> carrier")
    return h.select("match_id", "frame_idx", F.col("pc").alias("from_player"), F.col("carrier").alias("to_player"), F.when(F.col("pt") == F.col("team_id"), "pass").otherwise("change").alias("kind"))


@op("a7_pass_types", f"WITH {HELD}, {SEQ}, {NEXT}, {PASSES} SELECT match_id, team_id, sub_type, count(*) AS n, round(avg(distance_m), 5) AS mean_m FROM passes GROUP BY 1, 2, 3")
def a7_types(spark, d):
    return possession.passes(seq(spark, d)).groupBy("match_id", "team_id", "sub_type").agg(F.count("*").alias("n"), F.round(F.avg("distance_m"), 5).alias("mean_m"))


@op("e13_captions", f"""WITH {HELD}, {SEQ}, {NEXT}, {PASSES}, {SPEED}, {TURNOVERS}, e AS (SELECT match_id, frame_idx // 100 AS win, 3 AS p, 'turnover' AS k FROM turnovers UNION ALL SELECT match_id, frame_idx // 100, CASE WHEN sub_type IN ('cross', 'progressive') THEN 2 ELSE 1 END, sub_type FROM passes)
SELECT match_id, win, arg_max(k, (p, k)) AS caption FROM e GROUP BY 1, 2""")
def e13(spark, d):
    s = seq(spark, d)
    t = possession.turnovers(s, speeds(spark, d)).select("match_id", "frame_idx", F.lit(3).alias("p"), F.lit("turnover").alias("k"))
    p = possession.passes(s).select("match_id", "frame_idx", F.when(F.col("sub_type").isin("cross", "progressive"), 2).otherwise(1).alias("p"), F.col("sub_type").alias("k"))
    e = t.unionByName(p).withColumn("win", F.floor(F.col("frame_idx") / 100))
    return e.groupBy("match_id", "win").agg(F.max(F.struct("p", "k")).alias("m")).select("match_id", "win", F.col("m.k").alias("caption"))


@op("st2_live_load", f"WITH {_KEYED}, s AS (SELECT match_id, track_id, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(h AS INT)) AS start, value FROM ev, range(6) r(h)) SELECT match_id, track_id, start, count(*) AS rows, max(value) AS top FROM s WHERE start + INTERVAL 8 HOUR <= (SELECT max(ts) FROM ev) GROUP BY 1, 2, 3", adapted=False)
def st2(spark, d):
    return jobs.drained(spark, jobs.live_load(arriving(spark, d)), "st2")


@op("st3_possession_sessions", f"""WITH {_KEYED}, q AS (SELECT *, lag(ts) OVER (PARTITION BY match_id, track_id ORDER BY ts) AS p FROM ev), g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, track_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM q),
s AS (SELECT match_id, track_id, n, min(ts) AS start, count(*) AS rows, max(ts) AS last FROM g GROUP BY 1, 2, 3) SELECT match_id, track_id, start, rows FROM s WHERE last + INTERVAL 6 HOUR <= (SELECT max(ts) FROM ev)""", adapted=False)
def st3(spark, d):
    return jobs.drained(spark, jobs.possession_sessions(arriving(spark, d)), "st3")


@op("st4_live_possession", f"WITH {_KEYED}, {held_sql('ev', 'match_id', 'ts, track_id', 'track_id')} SELECT match_id, ts, track_id, holder FROM held3", adapted=False)
def st4(spark, d):
    return jobs.drained(spark, jobs.live_possession(arriving(spark, d)), "st4")


def vectors_of_events(spark, d, rows):
    """Arriving rows with an embedding each."""
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("vec_id", F.pmod("event_id", F.lit(vectors.count())))
    return rows.join(vectors, "vec_id").select("match_id", F.concat(F.lit("P"), F.col("track_id").cast("string")).alias("player_id"), "ts", "embedding")


@op("st5_drift_alerts")
def st5(spark, d):
    out = jobs.drained(spark, jobs.live_drift(vectors_of_events(spark, d, arriving(spark, d))), "st5", settings=jobs.KEPT_STATE)
    return out.groupBy("match_id", "player_id").agg(F.count("*").alias("n"), F.count_if("alert").alias("alerts"), F.count_if("reset").alias("resets"), F.round(F.min("similarity"), 5).alias("least"))


@op("st8_resumed_ingest", f"WITH {_KEYED} SELECT match_id, count(*) AS rows, count(DISTINCT event_id) AS events, max(ts) AS last FROM ev GROUP BY 1", adapted=False)
def st8(spark, d):
    """The same ingest run twice over one store: the second run finds nothing new."""
    path = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    for _ in range(2):
        stored = jobs.ingested(spark, arriving(spark, d), path)
    return stored.groupBy("match_id").agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("events"), F.max("ts").alias("last"))

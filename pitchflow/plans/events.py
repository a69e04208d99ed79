"""Queries of possession, tactics, identity, quality and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import identity, physical, possession, quality, tactics
from ..sources.adapter import base_once, tables
from ..streaming import jobs
from .physical import player_table, r6
from .registry import BURSTS, HELD, M, NEXT, PASSES, PHYSICAL, SEQ, SPEED, STEPS, TURNOVERS, carriers_sql, fold_sql, op


def held(spark, d):
    return possession.confirmed(*tables(spark, d, "points", "ball"))


def speeds(spark, d):
    return physical.ball_speed(tables(spark, d, "ball")[0])


def seq(spark, d):
    return possession.sequences(held(spark, d))


@op("u2_common_frames", "SELECT match_id, frame_idx FROM ball INTERSECT SELECT match_id, frame_idx FROM points")
def u2(spark, d):
    return possession.common_frames(*tables(spark, d, "points", "ball"))


@op("w2_ball_speed", f"WITH {SPEED} SELECT match_id, frame_idx, round(speed_ms, 6) AS speed_ms FROM speeds")
def w2(spark, d):
    return r6(speeds(spark, d).select("match_id", "frame_idx", "speed_ms"), "speed_ms")


@op("w3_confirmed_carriers", f'WITH {HELD} SELECT match_id, frame_idx, carrier, team_id, bx, "by" FROM held')
def w3(spark, d):
    return held(spark, d).select("match_id", "frame_idx", "carrier", "team_id", "bx", "by")


@op("w4_possession_runs", f"WITH {HELD}, {SEQ} SELECT match_id, carrier, team_id, start_frame, end_frame, rows, start_x, start_y, end_x, end_y, duration FROM seq")
def w4(spark, d):
    return seq(spark, d).drop("run")


@op("w6_carrier_votes", f"""WITH {carriers_sql('3', 'c3')}, v AS (SELECT a.match_id, a.frame_idx, b.carrier, count(*) AS votes FROM c3 a JOIN c3 b ON a.match_id = b.match_id AND b.frame_idx BETWEEN a.frame_idx - 6 AND a.frame_idx + 6 GROUP BY 1, 2, 3)
SELECT match_id, frame_idx, carrier, votes FROM v QUALIFY row_number() OVER (PARTITION BY match_id, frame_idx ORDER BY votes DESC, carrier) = 1""")
def w6(spark, d):
    from ..operators.joins import carriers

    return possession.votes(carriers(*tables(spark, d, "points", "ball"), 3.0))


@op("w7_control", f"WITH {HELD}, fr AS (SELECT match_id, unnest(range(0, frames_processed)) AS frame_idx FROM matches) SELECT f.match_id, f.frame_idx, last_value(team_id IGNORE NULLS) OVER (PARTITION BY f.match_id ORDER BY f.frame_idx) AS team_id FROM fr f LEFT JOIN held h ON h.match_id = f.match_id AND h.frame_idx = f.frame_idx")
def w7(spark, d):
    return possession.control(held(spark, d), tables(spark, d, "matches")[0])


@op("w12_passes", f"WITH {HELD}, {SEQ}, {NEXT}, {PASSES} SELECT * FROM passes")
def w12(spark, d):
    return possession.passes(seq(spark, d))


@op("w13_turnovers", f"WITH {HELD}, {SEQ}, {NEXT}, {SPEED}, {TURNOVERS} SELECT * FROM turnovers")
def w13(spark, d):
    return possession.turnovers(seq(spark, d), speeds(spark, d))


_STILL = f"""sl0 AS (SELECT *, speed_ms < 0.3 AS slow, lead(frame_idx) OVER {M}) AS nf FROM speeds), sl1 AS (SELECT *, CASE WHEN slow IS NOT DISTINCT FROM lag(slow) OVER {M}) THEN 0 ELSE 1 END AS new FROM sl0),
sl2 AS (SELECT *, sum(new) OVER {M}) AS run FROM sl1), still AS (SELECT match_id, min(frame_idx) AS start_frame, max(frame_idx) AS last_frame, coalesce(max_by(coalesce(nf, frame_idx + 1), frame_idx), 0) - min(frame_idx) AS frames, avg(x) AS x, avg(y) AS y FROM sl2 WHERE slow GROUP BY match_id, run HAVING coalesce(max_by(coalesce(nf, frame_idx + 1), frame_idx), 0) - min(frame_idx) >= 20)"""


@op("w14_stationary_ball", f"WITH {SPEED}, {_STILL} SELECT match_id, start_frame, last_frame, frames, round(x, 6) AS x, round(y, 6) AS y FROM still")
def w14(spark, d):
    return r6(possession.stationary(speeds(spark, d)), "x", "y")


@op("e8_set_pieces", f"""WITH {SPEED}, {_STILL} SELECT match_id, start_frame, frames, CASE WHEN least(x, 105 - x) <= 3 AND least(y, 68 - y) <= 3 THEN 'corner' WHEN abs(least(x, 105 - x) - 11) <= 2 AND abs(y - 34) <= 2 THEN 'penalty'
WHEN abs(x - 52.5) <= 3 AND abs(y - 34) <= 3 THEN 'kick_off' WHEN (x BETWEEN 0 AND 18 OR x BETWEEN 87 AND 105) AND y BETWEEN 25 AND 45 THEN 'goal_kick' WHEN least(y, 68 - y) <= 2 THEN 'throw_in' ELSE 'free_kick' END AS kind FROM still""")
def e8(spark, d):
    return possession.set_pieces(possession.stationary(speeds(spark, d))).select("match_id", "start_frame", "frames", "kind")


@op("e1_carries", f"""WITH {HELD}, {SEQ}, q AS (SELECT *, sqrt((start_x - end_x) * (start_x - end_x) + (start_y - end_y) * (start_y - end_y)) AS distance_m, CASE WHEN team_id = 0 THEN end_x - start_x ELSE start_x - end_x END AS dx FROM seq)
SELECT match_id, start_frame AS frame_idx, team_id, carrier AS player, distance_m, CASE WHEN dx < -2 THEN 'backward' WHEN abs(dx) <= 2 THEN 'lateral' ELSE 'forward' END AS sub_type FROM q WHERE duration >= 5 AND distance_m > 5""")
def e1(spark, d):
    return possession.carries(seq(spark, d))


@op("e2_dribbles", f"""WITH {HELD}, {SEQ}, r AS (SELECT *, unnest(range(start_frame, end_frame + 1)) AS f FROM seq WHERE duration >= 8 AND sqrt((start_x - end_x) * (start_x - end_x) + (start_y - end_y) * (start_y - end_y)) >= 3),
o AS (SELECT r.match_id, r.run, r.carrier, r.team_id, r.f, p.x, p.y FROM r JOIN points p ON p.match_id = r.match_id AND p.frame_idx = r.f AND p.team_id <> r.team_id AND p.track_id <> r.carrier),
m AS (SELECT o.match_id, o.run, o.carrier, o.team_id, min(o.f) AS f FROM o JOIN points c ON c.match_id = o.match_id AND c.frame_idx = o.f AND c.track_id = o.carrier WHERE sqrt((o.x - c.x) * (o.x - c.x) + (o.y - c.y) * (o.y - c.y)) < 3.5 GROUP BY 1, 2, 3, 4),
k AS (SELECT o.match_id, o.run, o.f FROM o JOIN ball b ON b.match_id = o.match_id AND b.frame_idx = o.f WHERE sqrt((o.x - b.x) * (o.x - b.x) + (o.y - b.y) * (o.y - b.y)) < 3)
SELECT match_id, f AS frame_idx, team_id, carrier AS player, NOT EXISTS (SELECT 1 FROM k WHERE k.match_id = m.match_id AND k.run = m.run AND k.f BETWEEN m.f AND m.f + 9) AS success FROM m""")
def e2(spark, d):
    points, ball = tables(spark, d, "points", "ball")
    return possession.dribbles(seq(spark, d), points, ball)


_SHOTS = f"sh0 AS (SELECT *, min(speed_ms) OVER {M} RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING) AS slow FROM speeds), shotf AS (SELECT match_id, frame_idx, x, y FROM sh0 WHERE speed_ms > 8 AND (x > 68 OR x < 37) AND slow < 4)"


@op("e3_shot_frames", f"WITH {SPEED}, {_SHOTS} SELECT * FROM shotf")
def e3(spark, d):
    return possession.shot_frames(speeds(spark, d)).select("match_id", "frame_idx", "x", "y")


_XG = "(CASE WHEN x > 52.5 THEN 105 ELSE 0 END - x)"
_XGD = f"sqrt({_XG} * {_XG} + (34 - y) * (34 - y))"


@op("f1_expected_goals", f"WITH q AS (SELECT match_id, frame_idx, {_XGD} AS d FROM ball) SELECT match_id, frame_idx, round(greatest(least(1 / (1 + exp(-(-1.5 - 0.08 * d + 1.2 * CASE WHEN d < 0.01 THEN pi() / 2 ELSE atan(7.32 * d / (d * d + 3.66 * 3.66)) END))), 0.99e0), 0.01e0), 6) AS xg FROM q")
def f1(spark, d):
    return tables(spark, d, "ball")[0].select("match_id", "frame_idx", F.round(g.expected_goals("x", "y"), 6).alias("xg"))


@op("e4_shots_xg", f"""WITH {SPEED}, {_SHOTS}, {fold_sql('shotf', 'match_id', 'frame_idx', 30, 'kept')}, q AS (SELECT *, {_XGD} AS d FROM kept),
nb AS (SELECT k.match_id, k.frame_idx, p.track_id, p.team_id FROM kept k JOIN ball b ON b.match_id = k.match_id AND b.frame_idx BETWEEN k.frame_idx - 10 AND k.frame_idx JOIN points p ON p.match_id = b.match_id AND p.frame_idx = b.frame_idx
WHERE sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)) < 5 QUALIFY row_number() OVER (PARTITION BY k.match_id, k.frame_idx ORDER BY k.frame_idx - b.frame_idx, sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)), p.track_id) = 1)
SELECT q.match_id, q.frame_idx, track_id AS player, team_id, x, y, round(greatest(least(1 / (1 + exp(-(-1.5 - 0.08 * d + 1.2 * CASE WHEN d < 0.01 THEN pi() / 2 ELSE atan(7.32 * d / (d * d + 3.66 * 3.66)) END))), 0.99e0), 0.01e0), 6) AS xg FROM q LEFT JOIN nb USING (match_id, frame_idx)""")
def e4(spark, d):
    return r6(possession.shots(speeds(spark, d), tables(spark, d, "points")[0]), "xg")


_PRESS = f"pr0 AS (SELECT p.match_id, p.frame_idx, p.track_id, p.team_id, p.x, h.x AS cx FROM points p JOIN held h ON h.match_id = p.match_id AND h.frame_idx = p.frame_idx AND h.team_id <> p.team_id WHERE sqrt((p.x - h.x) * (p.x - h.x) + (p.y - h.y) * (p.y - h.y)) < 4), {fold_sql('pr0', 'match_id, track_id', 'frame_idx', 10, 'press')}"


@op("e6_press_actions", f"WITH {HELD}, {_PRESS} SELECT match_id, frame_idx, track_id, team_id, x, cx FROM press")
@base_once
def e6(spark, d):
    return possession.press_actions(tables(spark, d, "points")[0], held(spark, d)).select("match_id", "frame_idx", "track_id", "team_id", "x", "cx")


@op("e6_ppda", f"""WITH {HELD}, {_PRESS}, hp AS (SELECT *, lag(carrier) OVER {M}) AS pc, lag(team_id) OVER {M}) AS pt FROM held), p AS (SELECT match_id, count(*) FILTER (team_id = 1 AND bx < 35) AS p0, count(*) FILTER (team_id = 0 AND bx > 70) AS p1 FROM hp WHERE pc <> carrier AND pt = team_id GROUP BY 1),
a AS (SELECT match_id, count(*) FILTER (team_id = 0 AND cx > 70) AS a0, count(*) FILTER (team_id = 1 AND cx < 35) AS a1, count(*) FILTER (team_id = 0) AS n0, count(*) FILTER (team_id = 1) AS n1 FROM press GROUP BY 1)
SELECT match_id, CASE WHEN n0 >= 5 AND a0 > 0 THEN p0 / a0 END AS ppda_0, CASE WHEN n1 >= 5 AND a1 > 0 THEN p1 / a1 END AS ppda_1 FROM p FULL JOIN a USING (match_id)""")
@base_once
def e6_ppda(spark, d):
    h = held(spark, d)
    return possession.ppda(possession.press_actions(tables(spark, d, "points")[0], h), h)


@op("e7_counter_press", f"""WITH {HELD}, {SEQ}, {NEXT}, {SPEED}, {TURNOVERS}, ev AS (SELECT match_id, frame_idx AS event_frame, team_id AS won FROM turnovers),
rw AS (SELECT p.match_id, p.frame_idx, p.track_id, p.team_id, h.team_id AS holder FROM points p JOIN ball b ON b.match_id = p.match_id AND b.frame_idx = p.frame_idx JOIN held h ON h.match_id = p.match_id AND h.frame_idx = p.frame_idx WHERE h.team_id <> p.team_id AND sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)) < 5),
pf AS (SELECT e.match_id, e.event_frame, e.won, r.frame_idx, count(DISTINCT track_id) AS n FROM ev e JOIN rw r ON r.match_id = e.match_id AND r.frame_idx BETWEEN e.event_frame AND e.event_frame + 125 AND r.team_id <> e.won AND r.holder = e.won GROUP BY 1, 2, 3, 4),
pk AS (SELECT match_id, event_frame, won, max(n) AS peak, min(frame_idx) AS first FROM pf GROUP BY 1, 2, 3)
SELECT match_id, event_frame, 1 - won AS pressing_team, coalesce(peak, 0) AS peak, CASE WHEN peak >= 3 THEN 'high' WHEN peak = 2 THEN 'medium' WHEN peak = 1 THEN 'low' ELSE 'none' END AS intensity, (first - event_frame) / 25e0 AS first_press_s FROM ev LEFT JOIN pk USING (match_id, event_frame, won)""")
@base_once
def e7(spark, d):
    points, ball = tables(spark, d, "points", "ball")
    h = held(spark, d)
    return possession.counter_press(possession.turnovers(seq(spark, d), speeds(spark, d)), points, ball, h)


@op("e9_simple_events", f"""WITH {carriers_sql('1e9', 'cx')}, q AS (SELECT b.match_id, b.frame_idx, b.x, carrier, lag(carrier) OVER w AS pw, sqrt((b.x - lag(b.x) OVER w) * (b.x - lag(b.x) OVER w) + (b.y - lag(b.y) OVER w) * (b.y - lag(b.y) OVER w)) AS step FROM ball b LEFT JOIN cx c ON c.match_id = b.match_id AND c.frame_idx = b.frame_idx
WINDOW w AS (PARTITION BY b.match_id ORDER BY b.frame_idx)), k AS (SELECT *, CASE WHEN step > 5 AND (x > 95 OR x < 10) THEN 'shot' WHEN step > 8 AND carrier <> pw THEN 'pass' END AS kind FROM q) SELECT match_id, frame_idx, kind, step, pw AS from_player, carrier AS to_player FROM k WHERE kind IS NOT NULL""")
def e9(spark, d):
    return possession.simple_passes(*tables(spark, d, "points", "ball"))


@op("a6_pass_edges", f"WITH {HELD}, {SEQ}, {NEXT}, {PASSES}, e AS (SELECT match_id, team_id, passer, receiver, count(*) AS passes, avg(distance_m) AS mean_m FROM passes GROUP BY 1, 2, 3, 4) SELECT match_id, team_id, passer, receiver, passes, round(mean_m, 6) AS mean_m, passes >= p AS frequent FROM e JOIN (SELECT match_id, quantile_cont(passes, 0.75) AS p FROM e GROUP BY 1) q USING (match_id)")
def a6(spark, d):
    return r6(possession.pass_edges(possession.passes(seq(spark, d))), "mean_m")


@op("a6_pass_nodes", f"""WITH {HELD}, {SEQ}, {NEXT}, {PASSES}, e AS (SELECT match_id, team_id, passer AS track_id, 1 AS made, 0 AS got, advance_m AS adv FROM passes UNION ALL SELECT match_id, team_id, receiver, 0, 1, NULL FROM passes),
n AS (SELECT match_id, team_id, track_id, CAST(sum(made) AS BIGINT) AS made, CAST(sum(got) AS BIGINT) AS received, avg(adv) AS adv FROM e GROUP BY 1, 2, 3), p AS (SELECT match_id, quantile_cont(made, 0.75) AS p FROM n GROUP BY 1), m AS (SELECT match_id, track_id, avg(x) AS mean_x, avg(y) AS mean_y FROM points GROUP BY 1, 2)
SELECT n.match_id, team_id, n.track_id, made, received, mean_x, mean_y, made >= p AND p > 0 AS key_passer, coalesce(adv > 10, false) AS progressive FROM n JOIN p USING (match_id) LEFT JOIN m USING (match_id, track_id)""")
def a6_nodes(spark, d):
    return possession.pass_nodes(possession.passes(seq(spark, d)), tables(spark, d, "points")[0])


_LINES = """ln0 AS (SELECT *, count(*) OVER (PARTITION BY match_id, frame_idx, team_id) AS n, row_number() OVER (PARTITION BY match_id, frame_idx, team_id ORDER BY CASE WHEN team_id = 0 THEN x ELSE -x END, track_id) AS rn FROM points),
ln1 AS (SELECT * FROM ln0 WHERE n >= 4 AND rn > 1), lnp AS (SELECT match_id, frame_idx, team_id, quantile_cont(x, 0.33) AS p33, quantile_cont(x, 0.66) AS p66 FROM ln1 GROUP BY 1, 2, 3),
ln2 AS (SELECT *, CASE WHEN team_id = 0 THEN x <= p33 ELSE x >= p66 END AS def FROM ln1 JOIN lnp USING (match_id, frame_idx, team_id)),
lines AS (SELECT match_id, frame_idx, team_id, avg(CASE WHEN def THEN CASE WHEN team_id = 0 THEN x ELSE 105 - x END END) AS depth, max(y) - min(y) AS width, max(x) - min(x) AS length, count(*) AS outfield FROM ln2 GROUP BY 1, 2, 3)"""


def lines(spark, d):
    return tactics.defensive_lines(tables(spark, d, "points")[0])


@op("a9_defensive_lines", f"WITH {_LINES} SELECT match_id, frame_idx, team_id, round(depth, 6) AS depth, width, length, outfield FROM lines")
def a9(spark, d):
    return r6(lines(spark, d), "depth")


@op("a9_line_summary", f"""WITH {_LINES}, s AS (SELECT *, CASE WHEN row_number() OVER w < 15 THEN depth ELSE avg(depth) OVER (PARTITION BY match_id, team_id ORDER BY frame_idx ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) END AS s FROM lines WINDOW w AS (PARTITION BY match_id, team_id ORDER BY frame_idx))
SELECT match_id, team_id, round(avg(s), 5) AS mean_depth, round(avg(width), 5) AS mean_width, round(avg(length), 5) AS mean_length, count(*) FILTER (s > 40) / count(*) AS high_line, count(*) FILTER (s < 25) / count(*) AS low_block FROM s GROUP BY 1, 2""")
def a9_summary(spark, d):
    return tactics.line_summary(lines(spark, d)).withColumns({c: F.round(c, 5) for c in ("mean_depth", "mean_width", "mean_length")})


@op("w16_out_of_shape", f"""WITH {_LINES}, b AS (SELECT *, CASE WHEN length > 40 THEN 'too_long' WHEN width > 55 THEN 'too_wide' WHEN depth < 18 THEN 'too_deep' END AS reason FROM lines),
c AS (SELECT *, CASE WHEN (reason IS NOT NULL) IS NOT DISTINCT FROM lag(reason IS NOT NULL) OVER (PARTITION BY match_id, team_id ORDER BY frame_idx) THEN 0 ELSE 1 END AS new FROM b), e AS (SELECT *, sum(new) OVER (PARTITION BY match_id, team_id ORDER BY frame_idx) AS run FROM c)
SELECT match_id, team_id, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, count(*) AS rows, min_by(reason, frame_idx) AS reason FROM e WHERE reason IS NOT NULL GROUP BY match_id, team_id, run""")
def w16(spark, d):
    return tactics.out_of_shape(lines(spark, d))


_FORMS = f"""fm0 AS (SELECT p.*, (frame_idx - f0) // 75 AS win FROM points p JOIN (SELECT match_id, min(frame_idx) AS f0 FROM points GROUP BY 1) z USING (match_id)), fm1 AS (SELECT match_id, win, team_id, track_id, avg(x) AS x FROM fm0 GROUP BY 1, 2, 3, 4),
fm2 AS (SELECT *, count(*) OVER (PARTITION BY match_id, win, team_id) AS n, row_number() OVER (PARTITION BY match_id, win, team_id ORDER BY CASE WHEN team_id = 0 THEN x ELSE -x END, track_id) AS rn FROM fm1), fm3 AS (SELECT * FROM fm2 WHERE n >= 7 AND rn > 1),
fmp AS (SELECT match_id, win, team_id, quantile_cont(x, 0.33) AS p33, quantile_cont(x, 0.66) AS p66 FROM fm3 GROUP BY 1, 2, 3),
fm4 AS (SELECT match_id, win, team_id, CASE WHEN team_id = 0 THEN CASE WHEN x <= p33 THEN 1 WHEN x <= p66 THEN 2 ELSE 3 END ELSE CASE WHEN x >= p66 THEN 1 WHEN x >= p33 THEN 2 ELSE 3 END END AS l FROM fm3 JOIN fmp USING (match_id, win, team_id)),
fm5 AS (SELECT match_id, win, team_id, count(*) FILTER (l = 1) AS def, count(*) FILTER (l = 2) AS mid, count(*) FILTER (l = 3) AS att FROM fm4 GROUP BY 1, 2, 3),
known AS (SELECT * FROM (VALUES {', '.join(f"({i}, {a}, {b}, {c}, '{a}-{b}-{c}')" for i, (a, b, c) in enumerate(tactics.FORMATIONS))}) k(i, a, b, c, name)),
forms AS (SELECT match_id, win, team_id, def, mid, att, name AS formation FROM fm5, known QUALIFY row_number() OVER (PARTITION BY match_id, win, team_id ORDER BY abs(def - a) + abs(mid - b) + abs(att - c), i) = 1)"""


def forms(spark, d):
    return tactics.formations(tables(spark, d, "points")[0])


@op("a10_formations", f"WITH {_FORMS} SELECT * FROM forms")
def a10(spark, d):
    return forms(spark, d)


@op("a10_dominant", f"WITH {_FORMS}, n AS (SELECT match_id, team_id, formation, count(*) AS n FROM forms GROUP BY 1, 2, 3) SELECT match_id, team_id, formation, n / sum(n) OVER (PARTITION BY match_id, team_id) AS share FROM n QUALIFY row_number() OVER (PARTITION BY match_id, team_id ORDER BY n DESC, formation DESC) = 1")
def a10_dominant(spark, d):
    return tactics.dominant_formation(forms(spark, d))


@op("w15_formation_shifts", f"WITH {_FORMS}, mv0 AS (SELECT *, lag(formation) OVER (PARTITION BY match_id, team_id ORDER BY win) AS before FROM forms), mv AS (SELECT * FROM mv0 WHERE before <> formation), {fold_sql('mv', 'match_id, team_id', 'win', 2, 'sft')} SELECT match_id, team_id, win, before, formation FROM sft")
def w15(spark, d):
    return tactics.formation_shifts(forms(spark, d))


@op("a11_team_shape", """WITH m AS (SELECT match_id, team_id, track_id, avg(x) AS x, avg(y) AS y FROM points GROUP BY 1, 2, 3), a AS (SELECT *, CASE WHEN team_id = 0 THEN x ELSE 105 - x END AS ahead FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY match_id, team_id ORDER BY ahead, track_id) AS lo, row_number() OVER (PARTITION BY match_id, team_id ORDER BY ahead DESC, track_id) AS hi FROM a),
b AS (SELECT match_id, team_id, max(x) - min(x) AS length, max(y) - min(y) AS width, avg(ahead) FILTER (lo BETWEEN 2 AND 5) AS back_four, avg(ahead) FILTER (hi <= 3) AS front_three FROM r GROUP BY 1, 2),
p AS (SELECT a.match_id, a.team_id, avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS compactness FROM m a JOIN m b ON a.match_id = b.match_id AND a.team_id = b.team_id AND a.track_id < b.track_id GROUP BY 1, 2)
SELECT match_id, team_id, round(length, 6) AS length, round(width, 6) AS width, round(back_four, 6) AS back_four, round(front_three, 6) AS front_three, round(compactness, 6) AS compactness FROM b JOIN p USING (match_id, team_id)""")
def a11(spark, d):
    return r6(tactics.team_shape(tables(spark, d, "points")[0]), "length", "width", "back_four", "front_three", "compactness")


@op("a12_shape", """WITH q AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM points WINDOW w AS (PARTITION BY match_id, frame_idx, team_id)),
s AS (SELECT match_id, frame_idx, team_id, max(x) - min(x) AS width, max(y) - min(y) AS depth, avg(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))) AS c FROM q GROUP BY 1, 2, 3)
SELECT match_id, frame_idx, team_id, width, depth, round(CASE WHEN c <= 80 THEN c END, 6) AS compactness FROM s WHERE width <= 68 AND depth <= 105""")
def a12(spark, d):
    return r6(tactics.shape(tables(spark, d, "points")[0]), "compactness")


_ENT = """en0 AS (SELECT match_id, frame_idx, team_id, least(greatest(floor(x / 105 * 6), 0), 5) * 4 + least(greatest(floor(y / 68 * 4), 0), 3) AS z, count(*) AS n FROM points WHERE frame_idx % 5 = 0 GROUP BY 1, 2, 3, 4),
en1 AS (SELECT *, sum(n) OVER (PARTITION BY match_id, frame_idx, team_id) AS al FROM en0), ent AS (SELECT match_id, frame_idx, team_id, round(-sum(n / al * log2(n / al)) / log2(24), 3) AS entropy FROM en1 WHERE al >= 3 GROUP BY 1, 2, 3)"""


@op("a16_entropy", f"WITH {_ENT} SELECT * FROM ent")
def a16(spark, d):
    return tactics.entropy(tables(spark, d, "points")[0])


@op("a16_entropy_trend", f"""WITH {_ENT}, q AS (SELECT *, row_number() OVER (PARTITION BY match_id, team_id ORDER BY frame_idx) AS rn, count(*) OVER (PARTITION BY match_id, team_id) AS n FROM ent),
s AS (SELECT match_id, team_id, avg(entropy) AS m, max(n) AS n, avg(entropy) FILTER (rn > n - n // 3) - avg(entropy) FILTER (rn <= n // 3) AS d FROM q GROUP BY 1, 2)
SELECT match_id, team_id, round(m, 6) AS mean_entropy, CASE WHEN n < 6 THEN 'insufficient' WHEN d > 0.05 THEN 'increasing' WHEN d < -0.05 THEN 'decreasing' ELSE 'stable' END AS trend FROM s""")
def a16_trend(spark, d):
    return tactics.entropy_trend(tactics.entropy(tables(spark, d, "points")[0]))


@op("a15_control_share", """WITH g AS (SELECT i * 2e0 AS gx, j * 2e0 AS gy, i, j FROM range(53) a(i), range(35) b(j)), f AS (SELECT match_id, frame_idx FROM points WHERE frame_idx % 10 = 0 GROUP BY 1, 2 HAVING count(*) >= 4),
o AS (SELECT p.match_id, p.frame_idx, i, j, arg_min(team_id, ((p.x - gx) * (p.x - gx) + (p.y - gy) * (p.y - gy), track_id)) AS team FROM points p JOIN f USING (match_id, frame_idx), g GROUP BY 1, 2, 3, 4) SELECT match_id, frame_idx, count(*) FILTER (team = 0) / 1855 AS share FROM o GROUP BY 1, 2""")
def a15(spark, d):
    return tactics.control_share(tables(spark, d, "points")[0])


@op("a13_pressure_map", """WITH g AS (SELECT i * 10 + j AS cell, i * 10.5e0 + 5.25 AS gx, j * 6.8e0 + 3.4 AS gy FROM range(10) a(i), range(10) b(j)), mp AS (SELECT match_id, team_id, track_id, avg(x) AS x, avg(y) AS y FROM points GROUP BY 1, 2, 3),
q AS (SELECT match_id, 1 - team_id AS team_id, cell, sqrt((x - gx) * (x - gx) + (y - gy) * (y - gy)) AS d FROM mp, g),
s AS (SELECT match_id, team_id, cell, sum(1 / greatest(d, 0.1e0)) AS p FROM q WHERE d < 10 GROUP BY 1, 2, 3) SELECT match_id, team_id, cell, round(p / max(p) OVER (PARTITION BY match_id, team_id), 4) AS pressure FROM s""")
def a13(spark, d):
    return tactics.pressure_map(tables(spark, d, "points")[0]).withColumn("pressure", F.round("pressure", 4)).withColumn("cell", F.col("cell").cast("long"))


_SIT = """hp AS (SELECT match_id, frame_idx, count(*) FILTER (y2 < lo / 0.88e0 * 0.35e0) AS high FROM (SELECT match_id, frame_idx, y2, max(y2) OVER (PARTITION BY match_id, frame_idx) AS lo FROM players) p GROUP BY 1, 2),
si AS (SELECT n.match_id, n.frame_idx, CASE WHEN n < 4 THEN 'dead_ball' WHEN speed_ms < 0.5 THEN 'set_piece' WHEN speed_ms > 3 THEN 'transition' WHEN high >= 3 THEN 'high_press' ELSE 'open_play' END AS label FROM (SELECT match_id, frame_idx, count(*) AS n FROM points GROUP BY 1, 2) n
LEFT JOIN speeds s ON s.match_id = n.match_id AND s.frame_idx = n.frame_idx LEFT JOIN hp ON hp.match_id = n.match_id AND hp.frame_idx = n.frame_idx)"""
_SEG = f"""sg0 AS (SELECT *, CASE WHEN label = lag(label) OVER {M}) THEN 0 ELSE 1 END AS new FROM si), sg1 AS (SELECT *, sum(new) OVER {M}) AS run FROM sg0), sg2 AS (SELECT match_id, run, label, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame FROM sg1 GROUP BY 1, 2, 3),
segs AS (SELECT match_id, label, start_frame, end_frame, (end_frame - start_frame + 1) / 25e0 AS seconds FROM sg2 WHERE (end_frame - start_frame + 1) / 25e0 >= CASE WHEN label = 'dead_ball' THEN 0.2 ELSE 0.5 END)"""


def labelled(spark, d):
    points, players = tables(spark, d, "points", "players")
    return tactics.situations(points, speeds(spark, d), players)


def segments(spark, d):
    return tactics.situation_segments(labelled(spark, d))


@op("e16_situations", f"WITH {SPEED}, {_SIT} SELECT *, CASE label WHEN 'dead_ball' THEN 0.95e0 WHEN 'set_piece' THEN 0.8e0 WHEN 'transition' THEN 0.75e0 ELSE 0.7e0 END AS confidence FROM si")
def e16(spark, d):
    return labelled(spark, d).select("match_id", "frame_idx", "label", "confidence")


@op("w17_situation_segments", f"WITH {SPEED}, {_SIT}, {_SEG} SELECT * FROM segs")
def w17(spark, d):
    return segments(spark, d)


@op("a19_phase_widths", f"WITH {SPEED}, {_SIT}, {_SEG}, w AS (SELECT match_id, frame_idx, team_id, max(y) - min(y) AS width FROM points GROUP BY 1, 2, 3) SELECT w.match_id, team_id, label, round(avg(width), 6) AS width, count(*) AS frames FROM w JOIN segs s ON s.match_id = w.match_id AND w.frame_idx BETWEEN s.start_frame AND s.end_frame GROUP BY 1, 2, 3")
def a19(spark, d):
    return r6(tactics.phase_widths(tables(spark, d, "points")[0], segments(spark, d)), "width")


_EVENTS = """carr AS (SELECT match_id, start_frame AS frame_idx, team_id FROM seq WHERE duration >= 5 AND sqrt((start_x - end_x) * (start_x - end_x) + (start_y - end_y) * (start_y - end_y)) > 5),
evs AS (SELECT match_id, frame_idx, team_id, 'pass' AS kind FROM passes UNION ALL SELECT match_id, frame_idx, team_id, 'turnover' FROM turnovers UNION ALL SELECT match_id, frame_idx, team_id, 'carry' FROM carr)"""
_EVS = f"{HELD}, {SEQ}, {NEXT}, {PASSES}, {SPEED}, {TURNOVERS}, {_EVENTS}"


def events(spark, d):
    s = seq(spark, d)
    rows = [(possession.passes(s), "pass"), (possession.turnovers(s, speeds(spark, d)), "turnover"), (possession.carries(s), "carry")]
    out = [r.select("match_id", "frame_idx", "team_id", F.lit(k).alias("kind")) for r, k in rows]
    return out[0].unionByName(out[1]).unionByName(out[2])


@op("u1_events", f"WITH {_EVS} SELECT * FROM evs")
def u1(spark, d):
    return events(spark, d)


@op("a7_event_counts", f"WITH {_EVS} SELECT match_id, team_id, count(*) FILTER (kind = 'pass') AS pass, count(*) FILTER (kind = 'turnover') AS turnover, count(*) FILTER (kind = 'carry') AS carry, count(*) FILTER (kind = 'shot') AS shot FROM evs GROUP BY 1, 2")
def a7(spark, d):
    return quality.event_counts(events(spark, d))


@op("a28_feed", f"WITH {_EVS} SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY frame_idx, kind, team_id) AS line, printf('%02d:%02d', CAST(floor(frame_idx / 25e0 / 60) AS INT), CAST(floor(frame_idx / 25e0) AS INT) % 60) AS clock, kind, team_id FROM evs")
def a28(spark, d):
    return quality.feed(events(spark, d))


@op("e12_densest_window", f"WITH {_EVS}, q AS (SELECT match_id, frame_idx, count(*) OVER {M} RANGE BETWEEN CURRENT ROW AND 200 FOLLOWING) AS n FROM evs) SELECT DISTINCT match_id, frame_idx AS start_frame, n AS events FROM q QUALIFY dense_rank() OVER (PARTITION BY match_id ORDER BY n DESC, frame_idx) = 1")
def e12(spark, d):
    return tactics.densest_window(events(spark, d))


@op("e14_merged_ranges", f"""WITH {_EVS}, r AS (SELECT match_id, greatest(frame_idx - 25, 0) AS a, frame_idx + 25 AS b FROM evs), q AS (SELECT *, max(b) OVER (PARTITION BY match_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM r),
g AS (SELECT *, sum(CASE WHEN t IS NULL OR a > t THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM q) SELECT match_id, min(a) AS start_frame, max(b) AS end_frame, count(*) AS merged FROM g GROUP BY match_id, run""")
def e14(spark, d):
    ranges = events(spark, d).select("match_id", F.greatest(F.col("frame_idx") - 25, F.lit(0)).alias("start_frame"), (F.col("frame_idx") + 25).alias("end_frame"))
    return tactics.merged_ranges(ranges)


_CHG = """kn AS (SELECT p.*, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, coalesce(m.dx, 0) AS mdx, coalesce(m.dy, 0) AS mdy FROM players p LEFT JOIN motion m ON m.match_id = p.match_id AND m.frame_idx = p.frame_idx WHERE player_id IS NOT NULL AND NOT is_official),
ch0 AS (SELECT *, lag(frame_idx) OVER w AS pf, lag(raw_track_id) OVER w AS praw, lag(team_id) OVER w AS pteam, lag(role) OVER w AS prole, lag(assignment_source) OVER w AS psrc, lag(cx) OVER w AS px, lag(cy) OVER w AS py, count(*) OVER (PARTITION BY match_id, player_id, frame_idx) AS boxes FROM kn WINDOW w AS (PARTITION BY match_id, player_id ORDER BY frame_idx, raw_track_id)),
ch AS (SELECT *, frame_idx - pf AS dt, sqrt((cx - (px + mdx)) * (cx - (px + mdx)) + (cy - (py + mdy)) * (cy - (py + mdy))) AS moved FROM ch0 WHERE pf < frame_idx),
conf AS (SELECT match_id, frame_idx, player_id, 'duplicate_id' AS conflict FROM kn GROUP BY 1, 2, 3 HAVING count(*) > 1
UNION ALL SELECT a.match_id, a.frame_idx, a.player_id, 'overlap' FROM kn a JOIN kn b ON a.match_id = b.match_id AND a.frame_idx = b.frame_idx AND a.raw_track_id < b.raw_track_id WHERE greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) / (2880e0 - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)) > 0.30
UNION ALL SELECT match_id, frame_idx, player_id, 'team_flip' FROM ch WHERE team_id <> pteam UNION ALL SELECT match_id, frame_idx, player_id, 'keeper_to_outfield' FROM ch WHERE prole = 'goalkeeper' AND role <> 'goalkeeper'
UNION ALL SELECT match_id, frame_idx, player_id, 'jump' FROM ch WHERE moved > 150 UNION ALL SELECT match_id, frame_idx, player_id, 'speed' FROM ch WHERE moved / dt > 60
UNION ALL SELECT match_id, frame_idx, player_id, 'source_downgrade' FROM ch WHERE psrc = 'locked' AND assignment_source = 'unassigned' UNION ALL SELECT match_id, frame_idx, player_id, 'teleport' FROM ch WHERE raw_track_id <> praw AND moved > 75
UNION ALL SELECT match_id, frame_idx, player_id, 'relock' FROM ch WHERE psrc = 'revived' AND assignment_source = 'locked' AND dt <= 10)"""
_SEV = "CASE conflict " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in identity.SEVERITY.items()) + " END"


def conflicts(spark, d):
    return identity.conflicts(*tables(spark, d, "players", "motion"))


@op("i1_conflicts", f"WITH {_CHG} SELECT *, {_SEV} AS severity FROM conf")
def i1(spark, d):
    return conflicts(spark, d)


@op("a34_conflict_counts", f"WITH {_CHG} SELECT match_id, conflict, {_SEV} AS severity, count(*) AS n, count(DISTINCT player_id) AS players FROM conf GROUP BY 1, 2, 3")
def a34(spark, d):
    return identity.conflict_counts(conflicts(spark, d))


_FIX = "SELECT match_id, win, '{0}' AS action, p[1] AS pid_a, {1} AS pid_b, {2} AS apply_from, {3} AS apply_to, {4}e0 AS confidence, '{5}' AS reason FROM q WHERE list_contains(k, '{5}')"


@op("i2_proposals", f"""WITH {_CHG}, q AS (SELECT match_id, frame_idx // 25 AS win, list(DISTINCT conflict) AS k, list_sort(list(DISTINCT player_id)) AS p, min(frame_idx) AS a, max(frame_idx) AS b FROM conf GROUP BY 1, 2)
{_FIX.format('swap', 'p[2]', 'a', 'CAST(NULL AS BIGINT)', 0.8, 'team_flip')} AND len(p) >= 2 UNION ALL {_FIX.format('mark_unknown', 'NULL', 'b', 'NULL', 0.95, 'keeper_to_outfield')}
UNION ALL {_FIX.format('suppress', 'NULL', 'a', 'b', 0.9, 'duplicate_id')} UNION ALL {_FIX.format('reject_revival', 'NULL', 'b', 'NULL', 0.85, 'teleport')}""")
def i2(spark, d):
    return identity.proposals(conflicts(spark, d))


_FRAG = """fr0 AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER w <= 5 THEN 0 ELSE 1 END AS new FROM players WHERE NOT is_official WINDOW w AS (PARTITION BY match_id, raw_track_id ORDER BY frame_idx)),
fr1 AS (SELECT *, CAST(sum(new) OVER (PARTITION BY match_id, raw_track_id ORDER BY frame_idx) AS BIGINT) AS run FROM fr0),
frm AS (SELECT match_id, raw_track_id, run, team_id FROM fr1 GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY match_id, raw_track_id, run ORDER BY count(*) DESC, team_id) = 1),
frag AS (SELECT f.match_id, f.raw_track_id, min(frame_idx) AS first_seen, max(frame_idx) AS last_seen, count(*) AS rows, min(identity_confidence) AS least, max(identity_confidence) AS most, avg(identity_confidence) AS mean, min_by(x, frame_idx) AS x0, min_by(y, frame_idx) AS y0, max_by(x, frame_idx) AS x1, max_by(y, frame_idx) AS y1, any_value(m.team_id) AS team_id, f.raw_track_id * 10000 + f.run AS track_id
FROM fr1 f JOIN frm m ON m.match_id = f.match_id AND m.raw_track_id = f.raw_track_id AND m.run = f.run GROUP BY f.match_id, f.raw_track_id, f.run)"""


@op("a33_tracklets", f"WITH {_FRAG} SELECT * FROM frag")
def a33(spark, d):
    return identity.fragments(tables(spark, d, "players")[0])


@op("i4_merge_candidates", f"WITH {_FRAG} SELECT a.match_id, a.track_id AS a, b.track_id AS b, b.first_seen - a.last_seen AS gap, sqrt((a.x1 - b.x0) * (a.x1 - b.x0) + (a.y1 - b.y0) * (a.y1 - b.y0)) AS metres FROM frag a JOIN frag b ON a.match_id = b.match_id AND a.track_id <> b.track_id AND a.team_id = b.team_id WHERE b.first_seen - a.last_seen BETWEEN 0 AND 120 AND sqrt((a.x1 - b.x0) * (a.x1 - b.x0) + (a.y1 - b.y0) * (a.y1 - b.y0)) <= 0.5 * greatest(b.first_seen - a.last_seen, 1)")
def i4(spark, d):
    return identity.merge_candidates(identity.fragments(tables(spark, d, "players")[0]))


@op("i10_physical_gate", f"WITH {_CHG} SELECT match_id, frame_idx, player_id, raw_track_id, CASE WHEN is_official THEN 'official' WHEN team_id <> pteam THEN 'team_flip' WHEN moved / (dt / 25e0) > 650 THEN 'speed' WHEN moved > 300 + 15 * least(dt - 1, 10) THEN 'jump' WHEN boxes > 1 THEN 'double_occupancy' END AS gate FROM ch")
def i10(spark, d):
    return identity.physical_gate(identity.player_changes(*tables(spark, d, "players", "motion"))).select("match_id", "frame_idx", "player_id", "raw_track_id", "gate")


@op("a37_referee_votes", """WITH q AS (SELECT *, count(*) OVER w AS n, sum(CASE WHEN CASE WHEN is_official THEN 0.4e0 ELSE 0e0 END + CASE WHEN is_official AND (y < 5 OR y > 63) THEN 0.1e0 ELSE 0e0 END >= 0.35 THEN 1 ELSE 0 END) OVER w AS yes FROM players WINDOW w AS (PARTITION BY match_id, raw_track_id ORDER BY frame_idx)),
s AS (SELECT *, CASE WHEN n < 4 THEN NULL WHEN yes / n >= 0.75 THEN 'official' WHEN yes / n < 0.30 THEN 'player' END AS said FROM q) SELECT match_id, raw_track_id, coalesce(min_by(said, frame_idx) FILTER (said IS NOT NULL), CASE WHEN max(yes) > 0 THEN 'suspected' ELSE 'player' END) AS decision, max(n) AS votes FROM s GROUP BY 1, 2""")
def a37(spark, d):
    score = identity.referee_score(F.col("is_official"), touchline=(F.col("y") < 5) | (F.col("y") > 63))
    return identity.referee_votes(tables(spark, d, "players")[0].withColumn("score", score))


@op("w18_segments", """WITH q AS (SELECT *, frame_idx - lag(frame_idx) OVER w AS df, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step FROM points WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame_idx)),
c AS (SELECT *, CASE WHEN df IS NULL THEN 'start' WHEN df > 8 THEN 'gap' WHEN step > 5 THEN 'jump' END AS why FROM q), s AS (SELECT *, CAST(sum(CASE WHEN why IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY match_id, track_id ORDER BY frame_idx) AS BIGINT) AS segment FROM c)
SELECT match_id, track_id, segment, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, count(*) AS rows, arg_min(why, frame_idx) AS reason FROM s GROUP BY 1, 2, 3""")
def w18(spark, d):
    return identity.jump_split(tables(spark, d, "points")[0])


@op("a35_display_coverage", """WITH grid AS (SELECT t.match_id, t.track_id, unnest(range(0, m.frames_processed)) AS frame_idx FROM tracks t JOIN matches m USING (match_id)), g1 AS (SELECT g.*, CASE WHEN p.x IS NOT NULL THEN g.frame_idx END AS own FROM grid g LEFT JOIN points p USING (match_id, track_id, frame_idx)),
g2 AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY match_id, track_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS a, first_value(own IGNORE NULLS) OVER (PARTITION BY match_id, track_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM g1),
s AS (SELECT match_id, CASE WHEN own IS NOT NULL THEN 'visible' WHEN b - a <= 8 THEN 'interpolated' WHEN frame_idx - a <= 15 THEN 'held' ELSE 'hidden' END AS st FROM g2) SELECT match_id, count(*) FILTER (st = 'visible') AS visible, count(*) FILTER (st = 'interpolated') AS interpolated, count(*) FILTER (st = 'held') AS held, count(*) FILTER (st = 'hidden') AS hidden FROM s GROUP BY 1""")
def a35(spark, d):
    return identity.display_coverage(*tables(spark, d, "points", "matches"))


_SWITCH = "sw AS (SELECT match_id, count(*) FILTER (p <> raw_track_id) AS id_switches FROM (SELECT *, lag(raw_track_id) OVER (PARTITION BY match_id, player_id ORDER BY frame_idx, raw_track_id) AS p FROM players WHERE player_id IS NOT NULL AND NOT is_official) x GROUP BY 1)"


@op("a22_tracking_quality", f"""WITH n AS (SELECT match_id, frame_idx, count(*) AS n FROM points GROUP BY 1, 2), q AS (SELECT *, lag(n) OVER {M}) - n > 5 AS dr FROM n), dd AS (SELECT match_id, count(*) FILTER (dr) AS drops, avg(n) AS mean_players FROM q GROUP BY 1), {_SWITCH},
t AS (SELECT match_id, count(DISTINCT track_id) AS ids, avg(hits) AS mean_length, count(*) FILTER (hits < 5) AS short, count(*) FILTER (hits >= 5) AS stable, least(count(*) FILTER (team_id = 0), count(*) FILTER (team_id = 1)) / greatest(count(*) FILTER (team_id = 0), count(*) FILTER (team_id = 1)) AS balance FROM tracks GROUP BY 1)
SELECT t.*, drops, mean_players, valid_frames / frames_processed AS valid_share, coalesce(id_switches, 0) AS id_switches FROM t JOIN dd USING (match_id) JOIN matches USING (match_id) LEFT JOIN sw USING (match_id)""")
def a22(spark, d):
    return quality.tracking_quality(*tables(spark, d, "points", "tracks", "matches", "players"))


_HEALTH = f"""hn AS (SELECT match_id, frame_idx, count(*) AS n FROM points GROUP BY 1, 2), hb AS (SELECT *, abs(n - lag(n) OVER {M})) AS ch FROM hn),
hl AS (SELECT match_id, frame_idx, round(least((CASE WHEN n >= 10 THEN 1e0 WHEN n >= 5 THEN 0.6e0 + (n - 5) / 12.5e0 ELSE 0.3e0 + (n - 1) / 13.3e0 END) * (CASE WHEN ch > 8 THEN 0.4e0 WHEN ch > 4 THEN 0.7e0 ELSE 1e0 END), 1e0), 3) AS health,
CASE WHEN n < 3 THEN 'close_up' WHEN n < 8 THEN 'medium_broadcast' ELSE 'wide_broadcast' END AS camera FROM hb)"""


@op("a23_frame_health", f"WITH {_HEALTH} SELECT * FROM hl")
def a23(spark, d):
    return quality.frame_health(tables(spark, d, "points")[0])


@op("w20_best_worst", f"""WITH {_HEALTH}, q AS (SELECT *, round(avg(health) OVER {M} ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), 6) AS h, count(*) OVER {M} ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS n FROM hl)
SELECT match_id, max(h) AS best, arg_max(frame_idx, (h, -frame_idx)) AS best_start, min(h) AS worst, arg_min(frame_idx, (h, frame_idx)) AS worst_start FROM q WHERE n = 10 GROUP BY 1""")
def w20(spark, d):
    return quality.best_worst_runs(quality.frame_health(tables(spark, d, "points")[0]))


_TCONF = """tc0 AS (SELECT match_id, track_id, hits, reid_merges AS mg, least(hits / greatest(last_seen - first_seen, 1), 1e0) AS c FROM tracks),
tc AS (SELECT *, round(greatest(0e0, least(1e0, 0.5e0 + CASE WHEN hits >= 20 THEN 0.25e0 WHEN hits >= 10 THEN 0.1e0 ELSE -0.2e0 END + CASE WHEN mg <= 1 THEN 0.15e0 WHEN mg <= 3 THEN 0.05e0 ELSE -0.15e0 END + CASE WHEN c >= 0.7 THEN 0.1e0 WHEN c >= 0.4 THEN 0e0 ELSE -0.1e0 END)), 2) AS score FROM tc0),
tl AS (SELECT *, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM tc)"""


@op("a20_track_confidence", f"""WITH {_TCONF} SELECT match_id, track_id, score, level, round(c, 2) AS continuity, concat_ws('; ', CASE WHEN hits < 10 THEN 'only ' || hits || ' detections' END, CASE WHEN mg > 3 THEN mg || ' merges (high fragmentation)' WHEN mg > 1 THEN mg || ' merges' END,
CASE WHEN c < 0.4 THEN 'visible in only ' || CAST(round(c * 100) AS INT) || '% of expected frames' END) AS reasons FROM tl""")
def a20(spark, d):
    return quality.track_confidence(tables(spark, d, "tracks")[0])


@op("a20_metric_display", f"""WITH {STEPS}, {BURSTS}, {PHYSICAL}, {_TCONF}, v AS (SELECT p.match_id, p.track_id, 'speed' AS metric, round(top_ms * 3.6, 1) AS value, level FROM physical p JOIN tl USING (match_id, track_id) UNION ALL SELECT p.match_id, p.track_id, 'distance', round(distance_m, 1), level FROM physical p JOIN tl USING (match_id, track_id)
UNION ALL SELECT p.match_id, p.track_id, 'sprint_count', CAST(sprints AS DOUBLE), level FROM physical p JOIN tl USING (match_id, track_id)), w AS (SELECT *, CASE metric WHEN 'speed' THEN CASE level WHEN 'high' THEN 10 WHEN 'medium' THEN 20 ELSE 35 END ELSE CASE level WHEN 'high' THEN 12 WHEN 'medium' THEN 25 ELSE 40 END END AS pct, value IS NULL OR value = 0 AS no FROM v)
SELECT match_id, track_id, metric, CASE WHEN no THEN 'low' ELSE level END AS confidence, CASE WHEN no THEN 'N/A' WHEN metric = 'sprint_count' THEN CASE level WHEN 'low' THEN '±3 (range)' WHEN 'high' THEN '±1' ELSE '±3' END ELSE '±' || pct || '%' END AS margin_of_error,
CASE WHEN no THEN 'data insufficient' WHEN metric = 'sprint_count' THEN CASE level WHEN 'low' THEN greatest(CAST(value AS INT) - 3, 0) || '-' || (CAST(value AS INT) + 3) || ' sprints' ELSE CAST(value AS INT) || ' ±' || CASE level WHEN 'high' THEN 1 ELSE 3 END || ' sprints' END
ELSE printf('%.1f', value) || CASE metric WHEN 'speed' THEN ' km/h' ELSE ' m' END || ' ±' || pct || '%' END AS display FROM w""")
def a20_display(spark, d):
    p = player_table(spark, d).join(quality.track_confidence(tables(spark, d, "tracks")[0]).select("match_id", "track_id", "level"), ["match_id", "track_id"])
    kinds = [("speed", F.round(F.col("top_ms") * 3.6, 1)), ("distance", F.round("distance_m", 1)), ("sprint_count", F.col("sprints").cast("double"))]
    rows = p.select("match_id", "track_id", "level", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in kinds])).alias("m"))
    return quality.metric_display(rows.select("match_id", "track_id", "level", "m.*"))


@op("a25_sanity", f"""WITH {STEPS}, {BURSTS}, {PHYSICAL}, z AS (SELECT p.*, frames_processed / fps AS s FROM physical p JOIN matches USING (match_id)) SELECT match_id, track_id, CASE WHEN distance_m <= 9 * s THEN round(distance_m, 5) END AS distance_m, CASE WHEN top_ms <= 12 THEN top_ms END AS top_ms, sprints,
concat_ws('+', CASE WHEN distance_m > 9 * s THEN 'distance_m' END, CASE WHEN top_ms > 12 THEN 'top_ms' END) AS failures, NOT (distance_m > 9 * s OR top_ms > 12) AS ready FROM z""")
def a25(spark, d):
    return quality.sane(player_table(spark, d), tables(spark, d, "matches")[0]).select("match_id", "track_id", F.round("distance_m", 5).alias("distance_m"), "top_ms", "sprints", "failures", "ready")


_APP = "SELECT o_custkey AS player_id, o_orderkey AS match_id, o_orderdate AS date, CAST(floor(CAST(o_totalprice AS DOUBLE) / 100) AS BIGINT) % 400 / 10e0 AS value, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'high' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'medium' ELSE 'low' END AS confidence FROM orders"


def appearances(spark, d):
    return spark.sql(_APP.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{d}/orders.parquet"))


@op("a31_development", f"""WITH ap AS ({_APP}), q AS (SELECT *, CAST(row_number() OVER (PARTITION BY player_id ORDER BY date, match_id) AS DOUBLE) AS i FROM ap WHERE confidence IN ('high', 'medium')),
s AS (SELECT player_id, count(*) AS n, regr_slope(value, i) AS slope, regr_r2(value, i) AS r2, avg(value) AS mean, stddev_pop(value) AS sd, max_by(value, i) AS last FROM q WHERE value > 0 GROUP BY 1 HAVING count(*) >= 2)
SELECT player_id, n, round(slope, 4) AS slope, round(r2, 4) AS r2, CASE WHEN slope / mean > 0.05 THEN 'improving' WHEN slope / mean < -0.05 THEN 'declining' ELSE 'stable' END AS direction, round(greatest(0e0, last + slope), 3) AS "next", round(1 - sd / mean, 4) AS consistency FROM s""", adapted=False)
def a31(spark, d):
    return quality.development(appearances(spark, d))


@op("a32_first_last", f"WITH ap AS ({_APP}), s AS (SELECT player_id, arg_min(value, (date, match_id)) AS \"first\", arg_max(value, (date, match_id)) AS \"last\", count(*) AS n FROM ap GROUP BY 1) SELECT *, \"last\" - \"first\" AS change FROM s", adapted=False)
def a32(spark, d):
    return quality.first_last(appearances(spark, d))


def arriving(spark, d):
    return jobs.arriving(spark, f"{d}/events.parquet")


_KEYED = "ev AS (SELECT *, concat('m', user_id % 4) AS match_id, user_id % 22 AS track_id FROM events)"


@op("st7_without_repeats", f"WITH {_KEYED} SELECT match_id, track_id, event_id, ts FROM ev", adapted=False)
def st7(spark, d):
    return jobs.drained(spark, jobs.without_repeats(arriving(spark, d)).select("match_id", "track_id", "event_id", "ts"), "st7")


@op("st1_live_quality", f"WITH {_KEYED} SELECT match_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS rows, count(DISTINCT track_id) AS ids FROM ev WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 3 HOUR <= (SELECT max(ts) FROM ev) GROUP BY 1, 2", adapted=False)
def st1(spark, d):
    return jobs.drained(spark, jobs.live_quality(arriving(spark, d)), "st1", "append").select("match_id", "start", "rows", "ids")

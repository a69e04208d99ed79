"""Queries of identity repair, resampling, space and match reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import identity, joins, physical, possession, prep, quality, repair, reports, tactics
from ..sources.adapter import tables
from .events import _EVS, _FRAG, conflicts, events
from .physical import player_table, r6, stepped
from .registry import BURSTS, PHYSICAL, STEPS, W, fold_sql, op

_MEAN = "mp AS (SELECT match_id, team_id, track_id, avg(x) AS x, avg(y) AS y FROM points GROUP BY 1, 2, 3)"
_GRID = f"""g AS (SELECT i * 10 + j AS cell, i * 10.5e0 + 5.25 AS gx, j * 6.8e0 + 3.4 AS gy FROM range(10) a(i), range(10) b(j)), {_MEAN}, dd AS (SELECT match_id, cell, gx, gy, team_id, min(sqrt((x - gx) * (x - gx) + (y - gy) * (y - gy))) AS d FROM mp, g GROUP BY 1, 2, 3, 4, 5),
sg AS (SELECT match_id, cell, gx, gy, CASE WHEN a < b THEN 0 WHEN b < a THEN 1 ELSE -1 END AS owner FROM (SELECT match_id, cell, gx, gy, coalesce(min(d) FILTER (team_id = 0), 999) AS a, coalesce(min(d) FILTER (team_id = 1), 999) AS b FROM dd GROUP BY 1, 2, 3, 4) q)"""


@op("a14_space_grid", f"WITH {_GRID} SELECT match_id, cell, round(gx, 6) AS gx, round(gy, 6) AS gy, owner FROM sg")
def a14_grid(spark, d):
    return r6(tactics.space_grid(tables(spark, d, "points")[0]), "gx", "gy")


@op("a14_territory", f"""WITH {_GRID} SELECT match_id, round(count(*) FILTER (owner = 0) / count(*) * 100, 1) AS team0, round(count(*) FILTER (owner = 1) / count(*) * 100, 1) AS team1, round(count(*) FILTER (owner = -1) / count(*) * 100, 1) AS contested,
count(*) FILTER (gx < 20 AND owner = 1) AS threats_to_0, count(*) FILTER (gx > 85 AND owner = 0) AS threats_to_1 FROM sg GROUP BY 1""")
def a14(spark, d):
    return tactics.territory(tactics.space_grid(tables(spark, d, "points")[0]))


def segments(spark, d):
    return identity.fragments(tables(spark, d, "players")[0]).select("match_id", "raw_track_id", F.col("first_seen").alias("start_frame"), F.col("last_seen").alias("end_frame"), F.col("track_id").alias("thread"), "team_id")


@op("j10_span_lookup", f"WITH {_FRAG} SELECT p.match_id, p.frame_idx, p.raw_track_id, f.track_id AS thread FROM players p LEFT JOIN frag f ON f.match_id = p.match_id AND f.raw_track_id = p.raw_track_id AND p.frame_idx BETWEEN f.first_seen AND f.last_seen QUALIFY row_number() OVER (PARTITION BY p.match_id, p.frame_idx, p.raw_track_id ORDER BY f.first_seen, f.last_seen) = 1")
def j10(spark, d):
    return repair.spans(tables(spark, d, "players")[0].select("match_id", "frame_idx", "raw_track_id"), segments(spark, d), ["thread"])


@op("i11_pitch_gate", """WITH q AS (SELECT match_id, player_id, frame_idx, raw_track_id, frame_idx - lag(frame_idx) OVER w AS dt, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS m FROM players WHERE NOT is_official WINDOW w AS (PARTITION BY match_id, player_id ORDER BY frame_idx, raw_track_id))
SELECT match_id, player_id, frame_idx, raw_track_id, dt IS NULL OR dt <= 0 OR m <= 1.2 * dt AS possible, round(CASE WHEN dt IS NULL THEN 0.5e0 ELSE least(m / 31.5e0, 1e0) END, 6) AS cost FROM q""")
def i11(spark, d):
    return r6(repair.pitch_gate(tables(spark, d, "players")[0].where("NOT is_official")).select("match_id", "player_id", "frame_idx", "raw_track_id", "possible", "cost"), "cost")


def tracked_boxes(spark, d):
    """Boxes of the players' table with the score, age and time since the last update that a tracker gives."""
    w = Window.partitionBy("match_id", "raw_track_id").orderBy("frame_idx")
    rows = tables(spark, d, "players")[0].withColumn("_first", F.min("frame_idx").over(Window.partitionBy("match_id", "raw_track_id")))
    return rows.select("match_id", "frame_idx", "raw_track_id", "x1", "y1", "x2", "y2", F.col("identity_confidence").alias("score"), (F.col("frame_idx") - F.col("_first")).alias("age"), (F.coalesce(F.col("frame_idx") - F.lag("frame_idx").over(w), F.lit(1)) - 1).alias("since_update"))


@op("p25_suppressed")
def p25(spark, d):
    return repair.suppressed(tracked_boxes(spark, d)).select("match_id", "frame_idx", "raw_track_id", "removed_by")


_CR = "CASE WHEN k > 8 THEN NULL WHEN dt > 15 THEN {0} ELSE (2 * (u * u * u) - 3 * (u * u) + 1) * {0} + ((u * u * u) - 2 * (u * u) + u) * dt * (CASE WHEN {0}p IS NULL THEN ({0}n - {0}) / dt ELSE ({0}n - {0}p) / (nf - pf) END) + (-2 * (u * u * u) + 3 * (u * u)) * {0}n + ((u * u * u) - (u * u)) * dt * (CASE WHEN {0}m IS NULL THEN ({0}n - {0}) / dt ELSE ({0}m - {0}) / (mf - frame_idx) END) END"
_LI = "CASE WHEN k = 0 AND dt = 1 THEN {0} * 0.5 + {0}n * 0.5 WHEN k = 0 THEN {0} WHEN k = dt - 1 THEN {0}n WHEN k <= 8 THEN {0} END"


@op("p27_resampled", f"""WITH q AS (SELECT *, lag(frame_idx) OVER w AS pf, lead(frame_idx) OVER w AS nf, lead(frame_idx, 2) OVER w AS mf, lag(x) OVER w AS xp, lead(x) OVER w AS xn, lead(x, 2) OVER w AS xm, lag(y) OVER w AS yp, lead(y) OVER w AS yn, lead(y, 2) OVER w AS ym FROM points WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame_idx)),
e AS (SELECT *, nf - frame_idx AS dt, unnest(range(0, nf - frame_idx)) AS k FROM q WHERE nf IS NOT NULL), z AS (SELECT *, (k + 0.5e0) / dt AS u FROM e)
SELECT match_id, track_id, frame_idx + k + 0.5e0 AS at, {_LI.format('x')} AS x, {_LI.format('y')} AS y, round({_CR.format('x')}, 6) AS spline_x, round({_CR.format('y')}, 6) AS spline_y, CASE WHEN sqrt((xn - x) * (xn - x) + (yn - y) * (yn - y)) / dt * 25 * 3.6e0 > 20 THEN 'sprint' WHEN sqrt((xn - x) * (xn - x) + (yn - y) * (yn - y)) / dt * 25 * 3.6e0 > 8 THEN 'run' ELSE 'idle' END AS state FROM z""")
def p27(spark, d):
    return r6(prep.resampled(tables(spark, d, "points")[0]), "spline_x", "spline_y")


_MOTION = f"""mo0 AS (SELECT *, frame_idx - lag(frame_idx) OVER {W}) AS g, sqrt((x - lag(x) OVER {W})) * (x - lag(x) OVER {W})) + (y - lag(y) OVER {W})) * (y - lag(y) OVER {W}))) / (frame_idx - lag(frame_idx) OVER {W})) AS s FROM points),
mo1 AS (SELECT *, s * 25 AS v FROM mo0 WHERE g > 0 AND g <= 10 AND s <= 3), mo AS (SELECT *, coalesce(avg(v) OVER {W} RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS b, avg(v) OVER {W} RANGE BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a FROM mo1),
pw AS (SELECT d.match_id, d.team_id, d.track_id AS passer, r.frame_idx, min((sqrt((r.x - d.x) * (r.x - d.x) + (r.y - d.y) * (r.y - d.y)), r.track_id)) AS m FROM mo d JOIN mo r ON r.match_id = d.match_id AND r.team_id = d.team_id AND r.track_id <> d.track_id AND r.frame_idx BETWEEN d.frame_idx AND d.frame_idx + 10
WHERE d.b > 1 AND d.a < d.b * (1 - 0.6e0) AND r.a > 1 AND r.b < r.a * (1 - 0.6e0) AND sqrt((r.x - d.x) * (r.x - d.x) + (r.y - d.y) * (r.y - d.y)) <= 30 GROUP BY 1, 2, 3, 4)"""


@op("e5_passes_without_ball", f"WITH {_MOTION}, {fold_sql('pw', 'match_id, passer', 'frame_idx', 10, 'kept')} SELECT match_id, team_id, passer, frame_idx, m[2] AS receiver, round(m[1], 2) AS distance_m FROM kept")
def e5(spark, d):
    return possession.passes_without_ball(tables(spark, d, "points")[0])


def pieces(spark, d):
    """Fragments of raw tracks with their first and last boxes, and a histogram of 16 levels of identity confidence in place of colours."""
    players = tables(spark, d, "players")[0].where("NOT is_official")
    cut = identity.fragments(players)
    own = repair.spans(players, segments(spark, d).drop("team_id"), ["thread"])
    own = own.withColumn("cx", (F.col("x1") + F.col("x2")) / 2).withColumn("cy", (F.col("y1") + F.col("y2")) / 2).withColumn("h", F.col("y2") - F.col("y1"))
    ends = own.groupBy("match_id", F.col("thread").alias("track_id")).agg(
        *(F.min_by(c, "frame_idx").alias(f"f{c[-1]}") for c in ("cx", "cy", "h")), *(F.max_by(c, "frame_idx").alias(f"l{c[-1]}") for c in ("cx", "cy", "h")),
        F.array(*[F.count_if(F.floor(F.col("identity_confidence") * 8) == k).cast("double") for k in range(8)]).alias("hist"),
    )
    return cut.join(ends, ["match_id", "track_id"]).withColumn("hits", F.col("rows"))


_PIECES = """own AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, y2 - y1 AS h, raw_track_id * 10000 + run AS tid, CAST(floor(identity_confidence * 8) AS INT) AS bin FROM fr1),
pc AS (SELECT match_id, tid, min(frame_idx) AS fs, max(frame_idx) AS ls, count(*) AS hits, min_by(cx, frame_idx) AS fx, min_by(cy, frame_idx) AS fy, min_by(h, frame_idx) AS fh, max_by(cx, frame_idx) AS lx, max_by(cy, frame_idx) AS ly, max_by(h, frame_idx) AS lh,
""" + ", ".join(f"count(*) FILTER (bin = {k}) AS n{k}" for k in range(8)) + " FROM own GROUP BY 1, 2)"
_ROOTS = " + ".join(f"sqrt(CAST(a.n{k} AS DOUBLE) * b.n{k})" for k in range(8))
_NEAR = "b.fs - a.ls BETWEEN -5 AND 5 AND sqrt((a.lx - b.fx) * (a.lx - b.fx) + (a.ly - b.fy) * (a.ly - b.fy)) <= 40 AND b.fh / a.lh BETWEEN 0.4 AND 2.5"


@op("i5_reid_merged", f"""WITH {_FRAG}, {_PIECES}, lk AS (SELECT DISTINCT a.match_id, least(a.tid, b.tid) AS a, greatest(a.tid, b.tid) AS b FROM pc a JOIN pc b ON a.match_id = b.match_id AND a.tid <> b.tid AND {_NEAR} WHERE sqrt(greatest(0, 1 - ({_ROOTS}) / sqrt(CAST(a.hits AS DOUBLE) * b.hits))) < 0.5),
bo AS (SELECT match_id, a, b FROM lk UNION SELECT match_id, b, a FROM lk), rc AS (SELECT match_id, a AS node, a AS r FROM bo UNION SELECT rc.match_id, rc.node, bo.b FROM rc JOIN bo ON bo.match_id = rc.match_id AND bo.a = rc.r), ro AS (SELECT match_id, node, min(r) AS root FROM rc GROUP BY 1, 2)
SELECT p.match_id, coalesce(root, tid) AS merged_id, count(*) AS pieces, CAST(sum(hits) AS BIGINT) AS hits, min(fs) AS first_seen, max(ls) AS last_seen FROM pc p LEFT JOIN ro ON ro.match_id = p.match_id AND ro.node = tid GROUP BY 1, 2""")
def i5(spark, d):
    return repair.reid_merged(spark, pieces(spark, d), gap=(-5, 5), pixels=40.0)


@op("i7_stitched")
def i7(spark, d):
    return repair.stitched(pieces(spark, d).select("match_id", "team_id", "track_id", "first_seen", "last_seen", "x0", "y0", "x1", "y1", "hist"))


@op("i3_patch_log")
def i3(spark, d):
    """The proposals of I2, as patches in order of their windows."""
    w = Window.partitionBy("match_id").orderBy("win", "action")
    patches = identity.proposals(conflicts(spark, d)).withColumn("patch", F.row_number().over(w).cast("long"))
    return repair.patch_log(tables(spark, d, "players")[0], patches)


@op("a26_report_quality", """WITH r AS (SELECT *, lag(assignment_source) OVER w AS p, lag(raw_track_id) OVER w AS pr FROM players WHERE NOT is_official WINDOW w AS (PARTITION BY match_id, player_id ORDER BY frame_idx, raw_track_id)),
m AS (SELECT match_id, round(avg(CASE WHEN assignment_source = 'locked' THEN 1e0 ELSE 0e0 END), 3) AS si, count(*) FILTER (assignment_source = 'revived' AND p <> 'revived') AS rv, count(*) FILTER (p = 'locked' AND assignment_source = 'unassigned') AS ex, count(*) FILTER (pr <> raw_track_id) AS sw,
avg(CASE WHEN assignment_source <> 'unassigned' THEN 1e0 ELSE 0e0 END) AS vc, count(*) FILTER (assignment_source = 'unassigned') AS ub, count(DISTINCT player_id) AS ui FROM r GROUP BY 1),
th AS (SELECT match_id, count(*) FILTER (n < 8) AS thin FROM (SELECT match_id, frame_idx, count(*) AS n FROM r GROUP BY 1, 2) q GROUP BY 1), tm AS (SELECT match_id, avg(CASE WHEN team_id IN (0, 1, 2) THEN 1e0 ELSE 0e0 END) AS ta FROM tracks GROUP BY 1), hm AS (SELECT match_id, count(DISTINCT frame_idx) AS nh FROM homographies GROUP BY 1),
z AS (SELECT *, round(least(1e0, coalesce(nh, 0) / greatest(1, frames_processed // 5)), 3) AS pc, round(thin / frames_processed, 3) AS sc FROM matches JOIN m USING (match_id) JOIN th USING (match_id) JOIN tm USING (match_id) LEFT JOIN hm USING (match_id))
SELECT match_id, si AS stable_ids, round(CASE WHEN rv + ex > 0 THEN rv / (rv + ex) ELSE 0e0 END, 3) AS resurrection, round(sw * 60e0 / (frames_processed / fps), 3) AS switches_a_minute, round(ta, 3) AS team_assignment, pc AS pitch_coverage, round(0.35e0 * si + 0.25e0 * vc + 0.2e0 * pc + 0.2e0 * (1 - least(1e0, sc)), 3) AS confidence,
round(vc, 6) AS valid_id_coverage, sc AS soft_collapse, ui AS unique_ids, ub AS unknown_boxes FROM z""")
def a26(spark, d):
    return reports.report_quality(*tables(spark, d, "players", "tracks", "matches", "homographies"))


@op("a26_report_teams", """WITH n AS (SELECT match_id, count(*) FILTER (role <> 'goalkeeper' AND team_id = 0) AS h, count(*) FILTER (role <> 'goalkeeper' AND team_id = 1) AS a, count(*) FILTER (role = 'goalkeeper') AS g FROM tracks GROUP BY 1), o AS (SELECT *, CASE WHEN g > 0 AND h <= a THEN 1 ELSE 0 END AS h1 FROM n)
SELECT match_id, h + h1 + (g - h1 - least(g - h1, 1)) AS home_players, a + least(g - h1, 1) AS away_players FROM o""")
def a26_teams(spark, d):
    return reports.report_teams(tables(spark, d, "tracks")[0])


@op("a26_report_players", f"WITH {STEPS}, {BURSTS}, {PHYSICAL} SELECT match_id, track_id, 'P' || track_id AS player_id, CASE team_id WHEN 0 THEN 'home' WHEN 1 THEN 'away' END AS team, round(distance_m, 1) AS distance_m, sprints, round(top_ms * 3.6e0, 2) AS top_speed_kmh FROM physical")
def a26_players(spark, d):
    return reports.report_players(player_table(spark, d))


@op("a26_report_events", f"WITH {_EVS} SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY frame_idx, kind, team_id) AS place, frame_idx AS frame, round(frame_idx / 25e0, 2) AS timestamp_s, kind AS type, team_id FROM evs")
def a26_events(spark, d):
    return reports.report_events(events(spark, d))


#: What each service's result counts, by kind of event.
_KINDS = {"pass": "pass_network", "turnover": "counter_press", "carry": "events"}


@op("r1_run_report")
def r1(spark, d):
    points, tracks, matches, players, ball, maps = tables(spark, d, "points", "tracks", "matches", "players", "ball", "homographies")
    services = reports.service_confidence(quality.tracking_quality(points, tracks, matches, players), matches, tracks, ball, maps)
    name = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    counts = events(spark, d).groupBy("match_id", name[F.col("kind")].alias("service")).agg(F.count("*").alias("found"))
    heat = points.groupBy("match_id").agg(F.count_distinct("track_id").alias("found")).select("match_id", F.lit("heatmaps").alias("service"), "found")
    return reports.run_report(services, counts.unionByName(heat))


@op("e15_pressing_stories")
def e15(spark, d):
    points, ball = tables(spark, d, "points", "ball")
    return tactics.pressing_stories(points, joins.carriers(points, ball, 3.0))


@op("a32_sound_matches", f"""WITH {STEPS}, {BURSTS}, {PHYSICAL}, tw AS (SELECT match_id, avg(w) AS width FROM (SELECT match_id, max(y) - min(y) AS w FROM points GROUP BY match_id, frame_idx, team_id) q GROUP BY 1), m AS (SELECT match_id, CAST(sum(sprints) AS BIGINT) AS sprints, round(max(top_ms) * 3.6e0, 4) AS max_kmh FROM physical GROUP BY 1)
SELECT match_id, sprints, max_kmh, round(width, 6) AS width, sprints > 50 OR max_kmh > 36 OR width > 70 AS corrupted FROM m JOIN tw USING (match_id)""")
def a32_sound(spark, d):
    wide = tables(spark, d, "points")[0].groupBy("match_id", "frame_idx", "team_id").agg((F.max("y") - F.min("y")).alias("w")).groupBy("match_id").agg(F.round(F.avg("w"), 6).alias("width"))
    load = player_table(spark, d).groupBy("match_id").agg(F.sum("sprints").alias("sprints"), F.round(F.max("top_ms") * 3.6, 4).alias("max_kmh"))
    return quality.sound_matches(load.join(wide, "match_id"))


_CELLS = "CAST(least(greatest(floor(x / 105 * 21), 0), 20) AS BIGINT) AS col, CAST(least(greatest(floor(y / 68 * 14), 0), 13) AS BIGINT) AS row_"


def _grid(where: str) -> str:
    return f"WITH {STEPS}, c AS (SELECT match_id, track_id, {_CELLS}, count(*) AS n FROM steps WHERE {where} GROUP BY 1, 2, 3, 4) SELECT match_id, track_id, col, row_ AS \"row\", n, n / max(n) OVER (PARTITION BY match_id, track_id) AS heat FROM c"


@op("a1_sprint_heatmap", _grid("speed_ms > 7"))
def a1_sprints(spark, d):
    return physical.heatmap(stepped(spark, d).where("speed_ms > 7"), physical.TRACK)


@op("a1_intensity_heatmap", _grid("speed_ms > 5.5"))
def a1_intensity(spark, d):
    return physical.heatmap(stepped(spark, d).where("speed_ms > 5.5"), physical.TRACK)

"""Queries of identity threads, of their review, of what is shown of each player, of velocities and of smoothed carriers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import display, identity, joins, possession, quality, services, stories, threads, velocity
from ..sources.adapter import base_once, tables
from ..sources.shared import stored
from .events import _FRAG
from .physical import stepped
from .registry import ORACLES, STEPS, carriers_sql, op


def found(spark, d):
    return threads.threads(threads.segments(*tables(spark, d, "players", "motion")))


@op("i8_threads")
def i8(spark, d):
    return found(spark, d).select("match_id", threads.segment_id(F.col("number")).alias("segment_id"), "raw_track_id", "start_frame", "end_frame", "rows", "reason", threads.thread_id(F.col("thread")).alias("thread_id"), "gap", "away", "join_confidence", "join_status")


@op("i8_thread_summary")
def i8_summary(spark, d):
    rows = found(spark, d)
    return threads.thread_summary(rows, threads.thread_events(rows)).withColumn("raw_track_ids", F.array_join(F.col("raw_track_ids").cast("array<string>"), ","))


@op("i8_review")
def i8_review(spark, d):
    return threads.review_sheet(threads.thread_events(found(spark, d)))


def edits(rows):
    """A log of edits for every fourth thread: merged into the next, split in its middle, marked unknown, or labelled."""
    own = rows.groupBy("match_id", "thread").agg(F.min("start_frame").alias("a"), F.max("end_frame").alias("b"), F.min_by("number", "start_frame").alias("number"))
    kind = F.col("thread") % 4
    action = F.when(kind == 0, "merge_threads").when(kind == 1, "split_thread_after_frame").when(kind == 2, "mark_unknown").otherwise("assign_label")
    text = lambda c: c.cast("string")
    return own.select(
        "match_id", F.col("thread").alias("edit"), action.alias("action"), threads.thread_id(F.col("thread")).alias("thread_id"), threads.thread_id(F.col("thread") + 1).alias("target_thread_id"),
        F.lit("").alias("event_id"), F.when(kind == 3, threads.segment_id(F.col("number"))).alias("segment_id"), text(F.expr("(a + b) div 2")).alias("frame"), F.concat(F.lit("R"), text(F.col("thread"))).alias("label"),
        F.when(F.col("thread") % 8 == 3, "from_frame").alias("scope"), F.when(F.col("thread") % 8 == 4, "yes").alias("force"))


@op("i9_review_edits")
def i9_edits(spark, d):
    rows = found(spark, d)
    return threads.review_edits(rows, threads.thread_events(rows), edits(rows))[1]


@op("i9_annotated")
@base_once
def i9(spark, d):
    players, motion = tables(spark, d, "players", "motion")
    rows = stored(spark, threads.threads(stored(spark, threads.segments(players, motion), "segments")), "threads")
    after, _ = threads.review_edits(rows, threads.thread_events(rows), edits(rows))
    return threads.annotated(players, after, edits(rows)).groupBy("match_id", "thread_id", "player_id", "assignment_source", "thread_status").agg(F.count("*").alias("boxes"))


_SHOWN = """kn AS (SELECT match_id, frame_idx, player_id, raw_track_id AS raw, identity_confidence AS conf, least(greatest(x2, 0), 1920) - least(greatest(x1, 0), 1920) AS w, least(greatest(y2, 0), 1080) - least(greatest(y1, 0), 1080) AS h FROM players
WHERE NOT is_official AND player_id LIKE 'P%' AND assignment_source IN ('locked', 'revived')), fr AS (SELECT match_id, unnest(range(0, frames_processed)) AS frame_idx FROM matches),
fc AS (SELECT fr.*, count(c.frame_idx) OVER (PARTITION BY match_id ORDER BY frame_idx) AS cuts FROM fr LEFT JOIN (SELECT match_id, frame_idx FROM motion WHERE motion_class = 'cut') c USING (match_id, frame_idx)),
gr AS (SELECT match_id, player_id, frame_idx, cuts, raw, conf, CASE WHEN w IS NOT NULL THEN {'f': frame_idx, 'raw': raw, 'w': w, 'h': h, 'cuts': cuts} END AS own FROM (SELECT DISTINCT match_id, player_id FROM kn) q JOIN fc USING (match_id) LEFT JOIN kn USING (match_id, player_id, frame_idx)),
pn AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY match_id, player_id ORDER BY frame_idx, raw ROWS UNBOUNDED PRECEDING) AS p, last_value(own IGNORE NULLS) OVER (PARTITION BY match_id, player_id ORDER BY frame_idx DESC, raw DESC ROWS UNBOUNDED PRECEDING) AS n FROM gr),
s1 AS (SELECT *, coalesce(own, p, n).raw AS by_raw, (frame_idx - p.f) / (n.f - p.f) AS t, CASE WHEN own IS NOT NULL THEN 'visible' WHEN p IS NULL OR (n IS NOT NULL AND n.cuts <> p.cuts) THEN NULL WHEN n.f - p.f <= 8 THEN 'interpolated' WHEN frame_idx - p.f <= 15 AND cuts = p.cuts THEN 'held' END AS state,
CASE WHEN p IS NULL THEN 'no_box_before' WHEN n IS NOT NULL THEN CASE WHEN n.cuts <> p.cuts THEN 'cut' ELSE 'gap_too_large' END WHEN cuts <> p.cuts THEN 'cut' ELSE 'hold_expired' END AS why FROM pn),
s2 AS (SELECT *, CASE WHEN state = 'interpolated' THEN (p.w + (n.w - p.w) * t) * (p.h + (n.h - p.h) * t) WHEN state = 'held' THEN p.w * p.h END AS area FROM s1),
s3 AS (SELECT s2.match_id, player_id, s2.frame_idx, by_raw, conf, CASE WHEN o.raw_track_id IS NULL AND coalesce(area, 99) >= 80 THEN state END AS state, CASE WHEN o.raw_track_id IS NOT NULL THEN 'official' WHEN state IS NULL THEN why WHEN area < 80 THEN 'empty_box' END AS reason
FROM s2 LEFT JOIN (SELECT DISTINCT match_id, frame_idx, raw_track_id FROM players WHERE is_official) o ON o.match_id = s2.match_id AND o.frame_idx = s2.frame_idx AND o.raw_track_id = by_raw),
s4 AS (SELECT *, row_number() OVER (PARTITION BY match_id, player_id, frame_idx ORDER BY state IS NULL, conf DESC, by_raw) AS rn FROM s3)"""


@op("i13_candidates", f"WITH {_SHOWN} SELECT match_id, player_id, CASE WHEN rn > 1 OR state IS NULL THEN 'hidden' ELSE state END AS state, coalesce(CASE WHEN rn > 1 AND state IS NOT NULL THEN 'duplicate_id' ELSE reason END, '') AS reason, count(*) AS boxes FROM s4 GROUP BY 1, 2, 3, 4")
def i13_candidates(spark, d):
    found = display.candidates(*tables(spark, d, "players", "motion", "matches"))
    return found.groupBy("match_id", "player_id", F.coalesce("state", F.lit("hidden")).alias("state"), F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("boxes"))


@op("i13_decisions")
@base_once
def i13(spark, d):
    return display.decisions(display.candidates(*tables(spark, d, "players", "motion", "matches"))).where("state <> 'visible'")


@op("a35_manifest")
@base_once
def a35(spark, d):
    players, motion, matches = tables(spark, d, "players", "motion", "matches")
    decided = display.decisions(display.candidates(players, motion, matches)).select("match_id", "frame_idx", "player_id", "assignment_source", "state", "reason")
    return display.manifest(stored(spark, decided, "decided"), players, motion, matches)


def velocities(spark, d):
    """Boxes around places on the pitch; some places are unknown, some approximate, and a few boxes jump."""
    points, tracks = tables(spark, d, "points", "tracks")
    f = F.col("frame_idx")
    x, y = 16 * F.col("x") + F.when(f % 53 == 52, 900.0).otherwise(0.0), 10 * F.col("y") + 200
    world = [F.when(f % 11 != 10, F.col(c)).alias(f"world_{c}") for c in ("x", "y")]
    boxes = points.select("match_id", "track_id", "frame_idx", (f / 25.0).alias("at"), (x - 12).alias("x1"), (y - 30).alias("y1"), (x + 12).alias("x2"), (y + 30).alias("y2"), *world, (f % 13 == 12).alias("approximate"))
    return velocity.velocities(boxes, tracks.select("match_id", "track_id", "team_id", F.col("hits").alias("detections"), (F.col("track_id") == 21).alias("is_staff")))


@op("a4_velocities")
def a4(spark, d):
    return velocities(spark, d)


@op("a4_team_velocities")
def a4_teams(spark, d):
    return velocity.team_velocities(velocities(spark, d))


def smoothed(spark, d):
    points, ball = tables(spark, d, "points", "ball")
    near = ball.select("match_id", "frame_idx", "source").join(joins.carriers(points, ball, 3.0).select("match_id", "frame_idx", "carrier", "d"), ["match_id", "frame_idx"], "left")
    return possession.smoothed_carriers(near.select("match_id", "frame_idx", "carrier", (1 - F.col("d") / 4).alias("confidence"), (F.col("source") == "kalman_prediction").alias("missing")))


@op("w6_smoothed_carriers")
def w6_smoothed(spark, d):
    return smoothed(spark, d)


@op("w6_smoothing_report")
def w6_report(spark, d):
    return possession.smoothing_report(smoothed(spark, d))


_ALIKE = f"""{_FRAG}, ev AS (SELECT vec_id, embedding, count(*) OVER () AS n FROM embeddings), fe AS (SELECT f.*, list_transform(list_zip(a.embedding, b.embedding), lambda p: (3 * CAST(p[1] AS DOUBLE) + CAST(p[2] AS DOUBLE)) / 4) AS e
FROM frag f JOIN ev a ON a.vec_id = (f.raw_track_id % 100) % a.n JOIN ev b ON b.vec_id = f.track_id % b.n), al AS (SELECT a.match_id, a.track_id AS a, b.track_id AS b, b.first_seen - a.last_seen AS gap,
list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(a.e, lambda v: v * v))) * sqrt(list_sum(list_transform(b.e, lambda v: v * v))) + 1e-8) AS similarity
FROM fe a JOIN fe b ON a.match_id = b.match_id AND a.track_id <> b.track_id AND b.first_seen - a.last_seen BETWEEN 0 AND 120
WHERE b.first_seen = a.last_seen OR sqrt((16 * (a.x1 - b.x0)) * (16 * (a.x1 - b.x0)) + (12 * (a.y1 - b.y0)) * (12 * (a.y1 - b.y0))) / (b.first_seen - a.last_seen) <= 80)"""


def embedded(spark, d):
    """Track pieces with a vector each: mostly their player's, some of their own."""
    pieces = identity.fragments(tables(spark, d, "players")[0])
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    n = vectors.count()
    own, other = vectors.withColumnsRenamed({"vec_id": "va", "e": "ea"}), vectors.withColumnsRenamed({"vec_id": "vb", "e": "eb"})
    rows = pieces.withColumns({"va": F.col("raw_track_id") % 100 % n, "vb": F.col("track_id") % n}).join(own, "va").join(other, "vb")
    mixed = F.zip_with("ea", "eb", lambda a, b: (3 * a + b) / 4)
    return rows.select("match_id", "track_id", "first_seen", "last_seen", (16 * F.col("x0")).alias("fx"), (12 * F.col("y0")).alias("fy"), (16 * F.col("x1")).alias("lx"), (12 * F.col("y1")).alias("ly"), mixed.alias("embedding"))


@op("i4_alike_pieces", f"WITH {_ALIKE} SELECT match_id, a, b, gap, round(similarity, 6) AS similarity FROM al WHERE similarity >= 0.65")
def i4_alike(spark, d):
    return identity.alike(embedded(spark, d)).withColumn("similarity", F.round("similarity", 6))


@op("i4_global_ids", f"""WITH {_ALIKE}, bo AS (SELECT match_id, a, b FROM al WHERE similarity >= 0.65 UNION SELECT match_id, b, a FROM al WHERE similarity >= 0.65),
rc AS (SELECT match_id, a AS node, a AS r FROM bo UNION SELECT rc.match_id, rc.node, bo.b FROM rc JOIN bo ON bo.match_id = rc.match_id AND bo.a = rc.r), ro AS (SELECT match_id, node, min(r) AS root FROM rc GROUP BY 1, 2)
SELECT f.match_id, f.track_id, coalesce(root, f.track_id) AS root, dense_rank() OVER (PARTITION BY f.match_id ORDER BY coalesce(root, f.track_id)) AS global_id FROM frag f LEFT JOIN ro ON ro.match_id = f.match_id AND ro.node = f.track_id""")
def i4_global(spark, d):
    return identity.global_ids(spark, embedded(spark, d))


#: Queries that say in SQL what a service finds.
_FOUND = {"pass_network": "a6_pass_nodes", "xg": "e4_shots_xg", "heatmaps": "a1_heatmap", "pressing": "e6_ppda", "formations": "a10_formations", "defensive_lines": "a9_defensive_lines", "counter_press": "e7_counter_press", "tactics": "a12_shape", "set_pieces": "e8_set_pieces"}


@op("r1_services", " UNION ALL ".join(f"SELECT match_id, '{name}' AS service, count(*) AS rows FROM ({ORACLES[q]}) GROUP BY 1" for name, q in _FOUND.items()), adapted=False)
@base_once
def r1_services(spark, d):
    """Rows found by each service of each match; the table of the pitch is missing, and the services that would need it have no result."""
    points, ball = tables(spark, d, "points", "ball")
    needy = services.Service("calibrated", ("points", "pitch"), lambda points, pitch: points.join(pitch, "match_id"))
    results, _ = services.run_services(spark, {"points": points, "ball": ball}, (*(s for s in services.SERVICES if s.name in _FOUND), needy))
    return services.found_by_match(results)


def _codes_sql(*pairs: tuple[str, str]) -> str:
    return "concat_ws('+', " + ", ".join(f"CASE WHEN {when} THEN '{code}' END" for when, code in pairs) + ")"


_FAR = ("ball_d > 1.8", "ball_too_far_from_carrier")
_STORIES = f"""WITH {carriers_sql('3')}, mv AS (SELECT *, x - lag(x) OVER w AS vx, y - lag(y) OVER w AS vy FROM points WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame_idx)),
op AS (SELECT c.match_id, c.frame_idx, c.x AS cx, c.y AS cy, p.track_id, p.x, p.y, p.vx, p.vy, sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)) AS d FROM carriers c JOIN mv p ON p.match_id = c.match_id AND p.frame_idx = c.frame_idx AND p.team_id <> c.team_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY match_id, frame_idx ORDER BY d, track_id) AS rn FROM op),
an AS (SELECT match_id, frame_idx, degrees(atan2(y - cy, x - cx)) AS t FROM op WHERE d <= 10), gp AS (SELECT match_id, frame_idx, coalesce(lead(t) OVER v, first_value(t) OVER v + 360) - t AS g FROM an WINDOW v AS (PARTITION BY match_id, frame_idx ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
es AS (SELECT match_id, frame_idx, CASE WHEN count(*) < 2 THEN 360e0 ELSE round(max(g), 6) END AS escape FROM gp GROUP BY 1, 2),
ag AS (SELECT match_id, frame_idx, count(*) FILTER (d <= 8) AS n8, count(*) FILTER (d <= 10) AS n10, count(*) FILTER (d <= 6) AS n6, count(*) FILTER (d <= 5 AND rn > 1) AS n5, {', '.join(f"max({c}) FILTER (rn = {k}) AS {c}{k}" for k in (1, 2) for c in ('x', 'y', 'd', 'vx', 'vy'))} FROM rk GROUP BY 1, 2),
sc AS (SELECT c.match_id, c.frame_idx, c.carrier, c.team_id, c.x, c.y, c.d AS ball_d, coalesce(n8, 0) AS n8, coalesce(n10, 0) AS n10, coalesce(n6, 0) AS n6, coalesce(n5, 0) AS n5, x1, y1, d1, vx1, vy1, d2, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) AS ab, coalesce(escape, 360e0) AS escape,
CASE WHEN d1 < 1e-6 OR d2 < 1e-6 THEN 0e0 ELSE round(degrees(acos(greatest(least(((x1 - c.x) * (x2 - c.x) + (y1 - c.y) * (y2 - c.y)) / (sqrt((x1 - c.x) * (x1 - c.x) + (y1 - c.y) * (y1 - c.y)) * sqrt((x2 - c.x) * (x2 - c.x) + (y2 - c.y) * (y2 - c.y))), 1e0), -1e0))), 6) END AS apart,
coalesce(sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)), 0e0) AS carried FROM carriers c LEFT JOIN ag USING (match_id, frame_idx) LEFT JOIN es USING (match_id, frame_idx) LEFT JOIN points p ON p.match_id = c.match_id AND p.frame_idx = c.frame_idx - 25 AND p.track_id = c.carrier)
SELECT match_id, frame_idx, carrier, team_id, CAST(n8 AS INTEGER) AS pressers, escape AS escape_deg, round(carried, 6) AS carried_m,
{_codes_sql(_FAR, ("d1 IS NULL OR d1 > 4.5", "presser_too_far"), ("d2 IS NULL OR d2 > 8 OR ab > 8", "no_real_cover_defender"), ("greatest(d1, d2, ab) > 11 AND d2 IS NOT NULL", "triangle_too_large"), ("apart < 25 AND d2 IS NOT NULL", "defenders_collinear"))} AS triangle,
{_codes_sql(_FAR, ("n10 < 3 OR n6 < 2", "insufficient_defenders_for_trap"), ("escape > 120", "escape_angle_too_large"), ("escape > 90", "no_directional_force"))} AS trap,
{_codes_sql(_FAR, ("d1 IS NULL OR d1 > 3", "presser_too_far"), ("n5 > 0", "second_defender_present"), ("vx1 * (x - x1) + vy1 * (y - y1) < 0", "defender_not_engaging"))} AS duel,
{_codes_sql(("x < 105e0 * (2e0 / 3)", "not_in_attacking_third"), ("n8 < 1", "no_presser"), ("least(abs(y), abs(68 - y)) > 20", "far_from_touchline"))} AS goalmouth,
{_codes_sql(("carried < 5", "short_carry"), ("n8 > 1", "pressed"))} AS carry FROM sc"""


@op("e15_story_checks", _STORIES)
def e15_checks(spark, d):
    points, ball = tables(spark, d, "points", "ball")
    return stories.checks(stories.scenes(points, joins.carriers(points, ball, 3.0)))


#: Tracks come and go, so that there are phases: between frames 100 and 140 and between 300 and 330 of every 400, few or none are seen.
_THIN = "(CASE WHEN frame_idx % 400 BETWEEN 100 AND 139 THEN 0 WHEN frame_idx % 400 BETWEEN 300 AND 329 THEN 5 ELSE 99 END)"
_SEEN = f"""WITH pt AS (SELECT * FROM points WHERE track_id < {_THIN}), fr AS (SELECT match_id, unnest(range(0, frames_processed)) AS frame_idx FROM matches), n0 AS (SELECT match_id, frame_idx, count(*) AS n FROM pt GROUP BY 1, 2),
n1 AS (SELECT match_id, frame_idx, coalesce(n, 0) AS n, lag(coalesce(n, 0)) OVER v AS was FROM fr LEFT JOIN n0 USING (match_id, frame_idx) WINDOW v AS (PARTITION BY match_id ORDER BY frame_idx)),
n2 AS (SELECT *, round(least((CASE WHEN n >= 10 THEN 1e0 WHEN n >= 5 THEN 0.6e0 + (n - 5) / 12.5e0 ELSE 0.3e0 + (n - 1) / 13.3e0 END) * (CASE WHEN abs(n - was) > 8 THEN 0.4e0 WHEN abs(n - was) > 4 THEN 0.7e0 ELSE 1e0 END), 1e0), 3) AS h FROM n1),
n3 AS (SELECT *, CASE WHEN n = 0 THEN 0.1e0 WHEN n < 3 THEN least(h, 0.4e0) ELSE h END AS health, CASE WHEN n = 0 THEN 'cut' WHEN n < 3 THEN 'close_up' WHEN n < 8 THEN 'medium_broadcast' ELSE 'wide_broadcast' END AS camera FROM n2),
n4 AS (SELECT *, CASE WHEN n < 2 AND health < 0.3 THEN 'dead_ball' WHEN n >= 8 THEN 'open_play' END AS says FROM n3),
n5 AS (SELECT *, CASE WHEN says = lag(says) OVER v AND says = lag(says, 2) OVER v THEN says END AS sure FROM n4 WINDOW v AS (PARTITION BY match_id ORDER BY frame_idx)),
seen AS (SELECT match_id, frame_idx, n, was, health, camera, coalesce(last_value(sure IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), 'unknown') AS phase FROM n5)"""


def thinned(spark, d):
    return tables(spark, d, "points")[0].where("track_id < CASE WHEN frame_idx % 400 BETWEEN 100 AND 139 THEN 0 WHEN frame_idx % 400 BETWEEN 300 AND 329 THEN 5 ELSE 99 END")


@op("a23_phases", f"""{_SEEN}, ru AS (SELECT *, sum(CASE WHEN phase IS NOT DISTINCT FROM p AND p IS NOT NULL THEN 0 ELSE 1 END) OVER (PARTITION BY match_id ORDER BY frame_idx) AS run FROM (SELECT *, lag(phase) OVER (PARTITION BY match_id ORDER BY frame_idx) AS p FROM seen) q),
rr AS (SELECT match_id, CAST(run AS BIGINT) AS run, phase, min(frame_idx) AS a, max(frame_idx) AS b, round(avg(health), 4) AS health FROM ru GROUP BY 1, 2, 3)
SELECT match_id, run, phase, round(a / 25e0, 1) AS start_s, round(coalesce(lead(a) OVER (PARTITION BY match_id ORDER BY run), b) / 25e0, 1) AS end_s, health FROM rr""")
def a23_phases(spark, d):
    return quality.match_phases(quality.observed(thinned(spark, d), tables(spark, d, "matches")[0]))


@op("a23_anomalies", f"""{_SEEN}, {STEPS}, tw AS (SELECT match_id, frame_idx, team_id, count(*) AS k, round(max(x) - min(x), 1) AS w FROM pt GROUP BY 1, 2, 3),
te AS (SELECT s.match_id, s.frame_idx, t.team_id, last_value(CASE WHEN k >= 3 AND camera NOT IN ('cut', 'close_up') THEN w END IGNORE NULLS) OVER (PARTITION BY s.match_id, t.team_id ORDER BY s.frame_idx ROWS UNBOUNDED PRECEDING) AS w FROM seen s CROSS JOIN (VALUES (0), (1)) t(team_id) LEFT JOIN tw ON tw.match_id = s.match_id AND tw.frame_idx = s.frame_idx AND tw.team_id = t.team_id)
SELECT match_id, frame_idx, 'camera_interruption' AS anomaly, NULL AS subject FROM seen WHERE n = 0 UNION ALL SELECT match_id, frame_idx, 'track_instability', concat(was, '-', n) FROM seen WHERE abs(n - was) > 8 UNION ALL SELECT match_id, frame_idx, 'overcounting', CAST(n AS VARCHAR) FROM seen WHERE n > 25
UNION ALL SELECT match_id, frame_idx, 'speed_spike', CAST(track_id AS VARCHAR) FROM steps WHERE speed_ms > 10 UNION ALL SELECT match_id, frame_idx, 'geometry_unreliable', CAST(team_id AS VARCHAR) FROM te WHERE w > 68""")
def a23_anomalies(spark, d):
    points = thinned(spark, d)
    return quality.anomalies(quality.observed(points, tables(spark, d, "matches")[0]), points, stepped(spark, d))

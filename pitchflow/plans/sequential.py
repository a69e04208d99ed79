"""Queries whose rules are recursive along a track or match, or that follow links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import helpers, identity, joins
from ..operators.components import components
from ..sources.adapter import tables
from .events import _FRAG
from .physical import r6, stepped
from .registry import carriers_sql, held_sql, op


@op("p15_drop_jumps")
def p15(spark, d):
    points = tables(spark, d, "points")[0]
    # every 37th row is moved away, so that there are jumps
    moved = points.withColumn("x", F.when(F.col("frame_idx") % 37 == 36, F.col("x") + 60).otherwise(F.col("x")))
    return helpers.drop_jumps(moved)


@op("p16_cap_motion")
def p16(spark, d):
    return r6(helpers.cap_motion(tables(spark, d, "points")[0]), "x", "y")


@op("p18_cap_players")
def p18(spark, d):
    return helpers.cap_players(tables(spark, d, "points")[0], most=18)  # a match here has 22 tracks


@op("p22_kalman")
def p22(spark, d):
    points = tables(spark, d, "points")[0]
    gaps = points.withColumn("x", F.when(F.col("frame_idx") % 11 != 5, F.col("x")))
    return r6(helpers.kalman_tracks(gaps), "x", "y")


@op("p22_smoothed_homographies", f"""WITH hq AS (SELECT match_id, frame_idx, row_number() OVER (PARTITION BY match_id ORDER BY frame_idx) AS rn, [{', '.join(f'h{k} / h8' for k in range(9))}] AS z FROM homographies),
ka(match_id, frame_idx, rn, p, x) AS (SELECT match_id, frame_idx, rn, 1e0, z FROM hq WHERE rn = 1 UNION ALL SELECT n.match_id, n.frame_idx, n.rn, (1 - (ka.p + 1e-4) / (ka.p + 1e-4 + 1e-2)) * (ka.p + 1e-4), list_transform(list_zip(ka.x, n.z), lambda v: v[1] + (ka.p + 1e-4) / (ka.p + 1e-4 + 1e-2) * (v[2] - v[1]))
FROM ka JOIN hq n ON n.match_id = ka.match_id AND n.rn = ka.rn + 1) SELECT match_id, frame_idx, {', '.join(f"round(x[{k + 1}], 8) AS h{k}" for k in range(9))} FROM ka""")
def p22_homographies(spark, d):
    out = helpers.smooth_homographies(tables(spark, d, "homographies")[0])
    return out.select("match_id", "frame_idx", *(F.round(c, 8).alias(c) for c in helpers.MATRIX))


@op("w5_possession_hysteresis", f"WITH {carriers_sql('3')}, nr AS (SELECT b.match_id, b.frame_idx, c.carrier FROM ball b LEFT JOIN carriers c USING (match_id, frame_idx)), {held_sql('nr', 'match_id', 'frame_idx', 'carrier')} SELECT match_id, frame_idx, holder AS carrier FROM held3")
def w5(spark, d):
    points, ball = tables(spark, d, "points", "ball")
    near = ball.select("match_id", "frame_idx").join(joins.carriers(points, ball, 3.0).select("match_id", "frame_idx", "carrier"), ["match_id", "frame_idx"], "left")
    return helpers.possession_hysteresis(near)


@op("w9_sprint_intervals")
def w9(spark, d):
    return r6(helpers.sprint_intervals(stepped(spark, d)), "peak_ms")


@op("a17_fatigue")
def a17(spark, d):
    return helpers.fatigue(stepped(spark, d))


@op("a36_teams_by_colour")
def a36(spark, d):
    f = tables(spark, d, "tracks")[0].select(
        "match_id", "track_id", ((F.col("track_id") % 2) * 60 + (F.col("track_id") * 7) % 11).cast("double").alias("hue"), (((F.col("track_id") * 5) % 8) / 8).alias("sat_ratio"), ((F.col("track_id") * 3) % 16).cast("double").alias("brightness"), "hits"
    )
    return helpers.teams_by_colour(f)


@op("i12_embedding_drift")
def i12(spark, d):
    players = tables(spark, d, "players")[0].where("NOT is_official")
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = vectors.count()
    rows = players.select("match_id", "player_id", "frame_idx", (F.col("raw_track_id") % n).alias("vec_id"))
    return helpers.embedding_drift(rows.join(vectors, "vec_id").select("match_id", "player_id", "frame_idx", "embedding"))


def links(spark, d):
    return identity.merge_candidates(identity.fragments(tables(spark, d, "players")[0]), max_gap=12, metres_per_frame=0.25)


@op("i4_linked_ids", f"""WITH {_FRAG}, lk AS (SELECT a.match_id, a.track_id AS a, b.track_id AS b FROM frag a JOIN frag b ON a.match_id = b.match_id AND a.track_id <> b.track_id AND a.team_id = b.team_id WHERE b.first_seen - a.last_seen BETWEEN 0 AND 12
AND sqrt((a.x1 - b.x0) * (a.x1 - b.x0) + (a.y1 - b.y0) * (a.y1 - b.y0)) <= 0.25 * greatest(b.first_seen - a.last_seen, 1)), bo AS (SELECT match_id, a, b FROM lk UNION SELECT match_id, b, a FROM lk),
rc AS (SELECT match_id, a AS node, a AS r FROM bo UNION SELECT rc.match_id, rc.node, bo.b FROM rc JOIN bo ON bo.match_id = rc.match_id AND bo.a = rc.r) SELECT match_id, node, min(r) AS root FROM rc GROUP BY 1, 2""")
def i4_components(spark, d):
    return components(spark, links(spark, d))


@op("i6_stitch")
def i6(spark, d):
    return helpers.stitch(identity.fragments(tables(spark, d, "players")[0]))

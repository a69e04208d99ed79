"""Registry of queries: a name, a function of (spark, sf_dir), and the same in SQL over the adapter's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapter import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op(name: str, sql: str | None = None, adapted: bool = True):
    """Registers a query; ``sql`` sees the adapter's tables unless adapted is false."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_tables(sql) if adapted else sql
        return f

    return put


W = "(PARTITION BY match_id, track_id ORDER BY frame_idx"
#: CTEs that several oracles share.
STEPS = f"""st0 AS (SELECT *, lead(frame_idx) OVER {W}) AS nf, lead(x) OVER {W}) AS nx, lead(y) OVER {W}) AS ny FROM points),
st1 AS (SELECT *, (nf - frame_idx) / 25e0 AS dt_s, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS step_m FROM st0),
st2 AS (SELECT *, CASE WHEN dt_s > 0 AND dt_s <= 2 AND step_m <= 3 * (nf - frame_idx) THEN least(step_m / dt_s, 12e0) END AS raw FROM st1),
st3 AS (SELECT *, quantile_cont(raw, 0.5) OVER {W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS med FROM st2 WHERE raw IS NOT NULL),
steps AS (SELECT match_id, track_id, team_id, frame_idx, x, y, dt_s, step_m, CASE WHEN raw > 3 * med THEN med ELSE raw END AS speed_ms FROM st3
UNION ALL SELECT match_id, track_id, team_id, frame_idx, x, y, dt_s, step_m, NULL FROM st2 WHERE raw IS NULL)"""
BURSTS = f"""bu0 AS (SELECT *, row_number() OVER {W}) AS rn FROM steps), bu1 AS (SELECT *, rn - lag(rn) OVER {W}) AS gap FROM bu0 WHERE speed_ms > 7),
bu2 AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3 THEN 1 ELSE 0 END) OVER {W} ROWS UNBOUNDED PRECEDING) AS burst FROM bu1),
bursts AS (SELECT match_id, track_id, CAST(burst AS BIGINT) AS burst, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, count(*) AS fast_rows, max(speed_ms) AS peak_ms FROM bu2 GROUP BY 1, 2, 3)"""
PHYSICAL = """phys0 AS (SELECT match_id, track_id, team_id, sum(speed_ms * dt_s) AS distance_m, sum(CASE WHEN speed_ms > 7 THEN speed_ms * dt_s ELSE 0 END) AS sprint_m,
sum(CASE WHEN speed_ms > 5.5 THEN speed_ms * dt_s ELSE 0 END) AS high_intensity_m, max(speed_ms) AS top_ms, avg(speed_ms) AS mean_ms FROM steps GROUP BY 1, 2, 3),
physical AS (SELECT p.*, coalesce(n, 0) AS sprints FROM phys0 p LEFT JOIN (SELECT match_id, track_id, count(*) AS n FROM bursts GROUP BY 1, 2) b USING (match_id, track_id))"""
M = "(PARTITION BY match_id ORDER BY frame_idx"
SPEED = f"""bs0 AS (SELECT *, avg(x) OVER {M} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sx, avg(y) OVER {M} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sy FROM ball),
bs1 AS (SELECT *, (lead(frame_idx) OVER {M}) - lag(frame_idx) OVER {M})) / 25e0 AS dt, lead(sx) OVER {M}) - lag(sx) OVER {M}) AS dx, lead(sy) OVER {M}) - lag(sy) OVER {M}) AS dy FROM bs0),
speeds AS (SELECT match_id, frame_idx, x, y, source, sx, sy, CASE WHEN dt > 0 THEN least(sqrt(dx * dx + dy * dy) / dt, 40e0) ELSE 0 END AS speed_ms FROM bs1)"""


def carriers_sql(limit: str, name: str = "carriers") -> str:
    return f"""{name}_d AS (SELECT p.*, b.x AS bx, b.y AS by_, b.source, sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)) AS d FROM points p JOIN ball b USING (match_id, frame_idx)),
{name} AS (SELECT match_id, frame_idx, track_id AS carrier, team_id, d, x, y, bx, by_ AS "by" FROM {name}_d WHERE d < {limit} QUALIFY row_number() OVER (PARTITION BY match_id, frame_idx ORDER BY d, track_id) = 1)"""


HELD = (
    carriers_sql("3", "near3")
    + f""", co0 AS (SELECT b.match_id, b.frame_idx, carrier, team_id, bx, "by", n.x, n.y FROM ball b LEFT JOIN near3 n USING (match_id, frame_idx) WHERE EXISTS (SELECT 1 FROM points p WHERE p.match_id = b.match_id AND p.frame_idx = b.frame_idx)),
co1 AS (SELECT *, CASE WHEN carrier IS NOT DISTINCT FROM lag(carrier) OVER {M}) AND lag(frame_idx) OVER {M}) IS NOT NULL THEN 0 ELSE 1 END AS new FROM co0),
co2 AS (SELECT *, sum(new) OVER {M} ROWS UNBOUNDED PRECEDING) AS sid FROM co1),
co3 AS (SELECT *, row_number() OVER (PARTITION BY match_id, sid ORDER BY frame_idx) AS streak FROM co2),
held AS (SELECT match_id, frame_idx, carrier, team_id, bx, "by", x, y FROM co3 WHERE carrier IS NOT NULL AND streak >= 3)"""
)
SEQ = f"""sq0 AS (SELECT *, CASE WHEN carrier IS NOT DISTINCT FROM lag(carrier) OVER {M}) THEN 0 ELSE 1 END AS new FROM held),
sq1 AS (SELECT *, CAST(sum(new) OVER {M} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM sq0),
seq AS (SELECT match_id, run, carrier, team_id, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, count(*) AS rows, min_by(bx, frame_idx) AS start_x, min_by("by", frame_idx) AS start_y,
max_by(bx, frame_idx) AS end_x, max_by("by", frame_idx) AS end_y, max(frame_idx) - min(frame_idx) + 1 AS duration FROM sq1 GROUP BY 1, 2, 3, 4)"""
SM = "(PARTITION BY match_id ORDER BY start_frame)"
NEXT = f"nx0 AS (SELECT *, lead(carrier) OVER {SM} AS nc, lead(team_id) OVER {SM} AS nt, lead(start_frame) OVER {SM} AS ns, lead(start_x) OVER {SM} AS nsx, lead(start_y) OVER {SM} AS nsy FROM seq)"
PASSES = """pa0 AS (SELECT *, sqrt((end_x - nsx) * (end_x - nsx) + (end_y - nsy) * (end_y - nsy)) AS distance_m, CASE WHEN team_id = 0 THEN nsx - end_x ELSE end_x - nsx END AS advance_m FROM nx0 WHERE nt = team_id AND ns - end_frame <= 60),
passes AS (SELECT match_id, ns AS frame_idx, team_id, carrier AS passer, nc AS receiver, end_x AS x, end_y AS y, distance_m, advance_m,
CASE WHEN distance_m > 25 AND abs(nsy - end_y) > 15 THEN 'cross' WHEN advance_m < -5 THEN 'back_pass' WHEN advance_m > 10 THEN 'progressive' ELSE 'simple' END AS sub_type FROM pa0 WHERE distance_m >= 2)"""
TURNOVERS = """turnovers AS (SELECT n.match_id, ns AS frame_idx, nt AS team_id, nc AS player, carrier AS lost_by, nsx AS x, nsy AS y,
CASE WHEN s.speed_ms > 6 AND (CASE WHEN n.team_id = 0 THEN end_x < 52.5 ELSE end_x > 52.5 END) THEN 'clearance' ELSE 'ball_recovery' END AS sub_type
FROM nx0 n LEFT JOIN speeds s ON s.match_id = n.match_id AND s.frame_idx = n.end_frame WHERE nt <> n.team_id AND ns - end_frame <= 45)"""


def fold_sql(source: str, keys: str, order: str, gap: int, name: str) -> str:
    """Rows of ``source`` at least ``gap`` after the last kept one of their key, by a recursive walk."""
    ks = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"s.{k} = r.{k}" for k in ks)
    return f"""{name}_w AS (SELECT {keys}, min({order}) AS {order} FROM {source} GROUP BY {keys}
UNION ALL SELECT {', '.join('r.' + k for k in ks)}, (SELECT min(s.{order}) FROM {source} s WHERE {same} AND s.{order} >= r.{order} + {gap}) AS {order} FROM {name}_w r WHERE r.{order} IS NOT NULL),
{name} AS (SELECT s.* FROM {source} s JOIN {name}_w w ON {' AND '.join(f's.{k} = w.{k}' for k in ks)} AND s.{order} = w.{order})"""


def held_sql(rows: str, by: str, order: str, who: str) -> str:
    """Holder by the last three nearest on end, else the first one."""
    w, up_to = f"(PARTITION BY {by} ORDER BY {order})", f"(PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    return f"""hq AS (SELECT *, CASE WHEN {who} = lag({who} IGNORE NULLS) OVER {w} AND {who} = lag({who}, 2 IGNORE NULLS) OVER {w} THEN {who} END AS run3 FROM {rows}),
held3 AS (SELECT *, coalesce(last_value(run3 IGNORE NULLS) OVER {up_to}, first_value({who} IGNORE NULLS) OVER {up_to}, -1) AS holder FROM hq)"""

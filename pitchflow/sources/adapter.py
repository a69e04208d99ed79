"""Tracking tables derived from the driver's tables, by one SQL text for Spark and DuckDB.

All coordinates are multiples of 1/256, so sums of them are exact in any order. ``{a} DIV {b}`` is written
``div`` in Spark and ``//`` in DuckDB.
"""

from __future__ import annotations

from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .shared import stored

#: Orders' keys that make up four matches: their tracks have some 110,000 rows each, as in a real match. Larger tables have more matches, not longer ones.
ORDERS = 2_500_000

#: Tables that the running query has written, by folder.
_KEPT: ContextVar[dict[str, DataFrame] | None] = ContextVar("kept", default=None)


def base_once(query):
    """For queries that read several tables several times: numbering the rows of lineitem takes a shuffle and a sort, so it is done once and written."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        mark = _KEPT.set({})
        try:
            return query(spark, sf_dir)
        finally:
            _KEPT.reset(mark)

    return run


def _x(k: str, f: str, div: str) -> str:
    slot = f"({k} {div} 2)"
    base = f"(CASE WHEN {slot} = 0 THEN 4e0 WHEN {slot} <= 4 THEN 20e0 WHEN {slot} <= 8 THEN 38e0 ELSE 56e0 END)"
    px = f"({base} + (abs((({f} + 7 * {k}) % 120) - 60) - 30) * (CASE WHEN {k} % 5 = 0 THEN 3125e-4 ELSE 1875e-4 END))"
    return f"(CASE WHEN {k} % 2 = 0 THEN {px} ELSE 105e0 - {px} END)"


def _y(k: str, f: str, div: str) -> str:
    slot = f"({k} {div} 2)"
    base = f"(CASE WHEN {slot} = 0 THEN 34 WHEN {slot} <= 4 THEN 8 + 16 * ({slot} - 1) WHEN {slot} <= 8 THEN 10 + 15 * ({slot} - 5) ELSE 24 + 20 * ({slot} - 9) END)"
    return f"({base} + (abs((({f} + 11 * {k}) % 64) - 32) - 16) * 125e-3)"


def tables_sql(div: str) -> dict[str, str]:
    """Name to SQL, each using lineitem and the tables before it."""
    h0, h1 = (f"((6 * (({f}) {div} 32) + ({f}) {div} 160 + m) % 22)" for f in ("f", "f + 32"))
    live_x, live_y = ((f"(({g('a', 'f', div)}) * (1 - w) + ({g('b', 'f', div)}) * w + {o})") for g, o in ((_x, "5e-1"), (_y, "25e-2")))
    dead = f"((f {div} 320) % 4)"
    match = f"(l_suppkey % 4 + 4 * (l_orderkey {div} {ORDERS}))"
    return {
        "base": f"SELECT CAST({match} AS BIGINT) AS m, CAST(l_partkey % 22 AS BIGINT) AS k, CAST(l_linenumber AS BIGINT) AS ln, CAST(row_number() OVER (PARTITION BY {match}, l_partkey % 22 "
        "ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 AS BIGINT) AS f FROM lineitem",
        "points": f"SELECT concat('m', m) AS match_id, k AS track_id, k % 2 AS team_id, f AS frame_idx, {_x('k', 'f', div)} AS x, {_y('k', 'f', div)} AS y "
        f"FROM base WHERE ln <> 7 AND (f {div} 40) % 17 <> 3",
        "ball": f"SELECT concat('m', m) AS match_id, f AS frame_idx, "
        f"CASE WHEN f % 320 >= 288 THEN (CASE {dead} WHEN 0 THEN 1e0 WHEN 1 THEN 11e0 WHEN 2 THEN 50e0 ELSE 525e-1 END) ELSE {live_x} END AS x, "
        f"CASE WHEN f % 320 >= 288 THEN (CASE {dead} WHEN 0 THEN 1e0 WHEN 1 THEN 34e0 WHEN 2 THEN 1e0 ELSE 34e0 END) ELSE {live_y} END AS y, "
        "CASE WHEN f % 10 < 6 THEN 'yolo' WHEN f % 10 < 8 THEN 'hough_candidate' ELSE 'kalman_prediction' END AS source "
        f"FROM (SELECT m, f, {h0} AS a, {h1} AS b, CASE WHEN f % 32 < 16 THEN 0e0 ELSE ((f % 32) - 15) / 16e0 END AS w "
        f"FROM (SELECT DISTINCT m, f FROM base) d WHERE (7 * f + m) % 29 <> 0 AND NOT ((f {div} 200) % 5 = 4 AND f % 200 < 20)) e",
        "tracks": "SELECT match_id, track_id, min(team_id) AS team_id, CASE WHEN track_id < 2 THEN 'goalkeeper' ELSE 'player' END AS role, "
        "count(*) AS hits, min(frame_idx) AS first_seen, max(frame_idx) AS last_seen, count(DISTINCT frame_idx % (track_id + 1)) - 1 AS reid_merges FROM points GROUP BY match_id, track_id",
        "players": f"SELECT match_id, frame_idx, track_id + 100 * (frame_idx {div} 97) AS raw_track_id, CASE WHEN (17 * frame_idx + track_id) % 401 = 0 THEN concat('P', track_id % 20 + 2) ELSE concat('P', track_id + 1) END AS player_id, "
        "CASE WHEN (13 * frame_idx + track_id) % 211 = 0 THEN 1 - team_id ELSE team_id END AS team_id, CASE WHEN (frame_idx + 3 * track_id) % 307 = 0 THEN 'goalkeeper' WHEN track_id < 2 THEN 'goalkeeper' ELSE 'player' END AS role, "
        "(track_id = 21 AND frame_idx % 50 < 5) AS is_official, CASE WHEN (frame_idx + track_id) % 23 = 0 THEN 'unassigned' WHEN (frame_idx + track_id) % 23 <= 3 THEN 'revived' ELSE 'locked' END AS assignment_source, "
        "((frame_idx + 5 * track_id) % 16) / 16e0 AS identity_confidence, 16 * x - 12 AS x1, 12 * y - 30 AS y1, 16 * x + 12 AS x2, 12 * y + 30 AS y2, x, y FROM points",
        "motion": f"SELECT match_id, frame_idx, CAST(((frame_idx {div} 5) % 9) - 4 AS DOUBLE) AS dx, 0e0 AS dy, CASE WHEN frame_idx % 400 = 200 THEN 'cut' WHEN frame_idx % 130 < 10 THEN 'fast_pan' ELSE 'stable' END AS motion_class "
        "FROM (SELECT DISTINCT match_id, frame_idx FROM points) d WHERE frame_idx % 5 = 0",
        "homographies": "SELECT match_id, frame_idx, 625e-4 AS h0, 0e0 AS h1, (frame_idx % 7) * 125e-3 AS h2, 0e0 AS h3, 8e-2 AS h4, (frame_idx % 5) * 25e-2 AS h5, 0e0 AS h6, 0e0 AS h7, 1e0 AS h8 "
        "FROM (SELECT DISTINCT match_id, frame_idx FROM points) d WHERE frame_idx % 10 = 0",
        "matches": "SELECT match_id, 25e0 AS fps, max(frame_idx) + 1 AS frames_processed, count(DISTINCT frame_idx) AS valid_frames FROM points GROUP BY match_id",
    }


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named tables, as DataFrames over lineitem."""
    sql, made = tables_sql("div"), {"lineitem": spark.read.parquet(f"{sf_dir}/lineitem.parquet")}

    def get(name: str) -> DataFrame:
        if name not in made:
            text = sql[name]
            needs = [n for n in ("lineitem", "base", "points") if f"FROM {n}" in text]
            for n in needs:
                text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
            kept = _KEPT.get() if name == "base" else None
            if kept is not None and sf_dir in kept:
                made[name] = kept[sf_dir]
                return made[name]
            made[name] = spark.sql(text, **{n: get(n) for n in needs})
            if kept is not None:
                made[name] = kept[sf_dir] = stored(spark, made[name], name)
        return made[name]

    return [get(n) for n in names]


def with_tables(select: str) -> str:
    """DuckDB text: the same tables as common table expressions before ``select``, which may start with more of them."""
    sql = tables_sql("//")
    used = [n for n in sql if n == "base" or n == "points" or n in select]
    return "WITH RECURSIVE " + ", ".join(f"{n} AS MATERIALIZED ({sql[n]})" for n in used) + (", " + select[5:] if select.startswith("WITH ") else " " + select)

"""Distance, speeds and sprints of each track, from boxes and places on the pitch.

The filter that drops jumps remembers the last place it kept, and a sprint the moment it began, so a track (a row a frame) is one group. What comes before, which boxes
count and where they stand, and what comes after, teams' sums, are column expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .helpers import TRACK

#: Pixels a metre, the picture, the pitch, its margin, and the part of the picture's height in which players are.
PIXELS, PICTURE, PITCH, MARGIN, BAND = 15.5, (1920.0, 1080.0), (105.0, 68.0), 5.0, (0.15, 0.85)
#: Metres a frame that are a jump, the longest and the shortest step that counts, the discount of approximate places.
JUMP, LONGEST, SHORTEST, DISCOUNT = 8.0, 0.48, 0.3, 0.85
#: Fixed values in m/s and seconds: sprint, fast run, top; a sprint's quiet time before, its speeds before and after, its length, the length of one that isn't over, the gap of two that are one.
SPRINT, FAST, TOP, QUIET, BEFORE, AFTER, LENGTH, OPEN_LENGTH, MERGE, MOST = 7.0, 5.5, 12.0, 1.0, 4.0, 4.5, 1.0, 0.4, 2.0, 5


def kept_places(frame: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows at most 8 m a frame from the last one kept; x and y in metres."""
    out, last = [], -1
    for i in range(len(frame)):
        if last < 0 or np.hypot(x[i] - x[last], y[i] - y[last]) <= JUMP * max(abs(frame[i] - frame[last]), 1):
            out.append(i)
            last = i
    return np.array(out, dtype=np.int64)


def rolling_median(v: np.ndarray, window: int = 5) -> np.ndarray:
    """Centred, over fewer values at the ends; values as they are if there are fewer than ``window``."""
    if len(v) < window:
        return v
    half = window // 2
    ends = lambda i: np.median(v[max(0, i - half) : i + half + 1])
    inner = np.median(np.lib.stride_tricks.sliding_window_view(v, window), axis=1)
    return np.concatenate([[ends(i) for i in range(half)], inner, [ends(i) for i in range(len(v) - half, len(v))]])


def sprints(speed: np.ndarray, at: np.ndarray) -> list[tuple[float, float, float]]:
    """(start, end, peak): from 7 m/s after a quiet second until under 4.5 m/s, a second or longer; near ones are one, the five fastest count."""
    fast = np.maximum.accumulate(np.where(speed >= BEFORE, np.arange(len(speed)), -1))  # the last row of 4 m/s or more
    out, start = [], None
    for i in np.flatnonzero((speed >= SPRINT) | (speed < AFTER)):
        if speed[i] >= SPRINT:
            before = fast[i - 1] if i else -1
            if start is None and (before < 0 or at[i] - at[before] > QUIET):
                start = i
        elif start is not None:
            if at[i] - at[start] >= LENGTH:
                out.append((at[start], at[i], speed[start : i + 1].max()))
            start = None
    if start is not None and at[-1] - at[start] >= OPEN_LENGTH:
        out.append((at[start], at[-1], speed[start:].max()))
    one: list[tuple[float, float, float]] = []
    for s in out:
        if one and s[0] - one[-1][1] < MERGE:
            one[-1] = (one[-1][0], max(s[1], one[-1][1]), max(s[2], one[-1][2]))
        else:
            one.append(s)
    return sorted(one, key=lambda s: -s[2])[:MOST] if len(one) > MOST else one


def velocity_of(frame, at, px, py, wx, wy, approximate) -> tuple[float, int, float, float, int]:
    """(metres, sprints, top speed, mean speed, fast runs) of one track in order; px, py: centres over pixels a metre, wx, wy: places in metres."""
    nothing = (0.0, 0, 0.0, 0.0, 0)
    if len(frame) < 2:
        return nothing
    own = kept_places(frame, px, py)
    if len(own) < 2:
        return nothing
    at, wx, wy, approximate = at[own], wx[own], wy[own], approximate[own]
    if len(own) > 2:
        wx, wy = (np.concatenate([v[:1], (v[:-2] + v[1:-1] + v[2:]) / 3, v[-1:]]) for v in (wx, wy))
    dt, step = np.diff(at), np.minimum(np.hypot(np.diff(wx), np.diff(wy)), LONGEST)
    step = np.where(approximate[1:], step * DISCOUNT, step)
    raw = np.divide(step, dt, out=np.zeros(len(dt)), where=dt > 0)
    speed = rolling_median(np.where(raw > TOP, 0.0, raw))
    run = speed >= FAST
    fast_runs = int(run[0]) + int((run[1:] & ~run[:-1]).sum())
    return round(float(step[(dt > 0) & (step >= SHORTEST)].sum()), 1), len(sprints(speed, at[1:])), round(min(float(speed.max()), TOP), 2), round(float(speed.mean()), 2), fast_runs


def velocities(boxes: DataFrame, tracks: DataFrame, pixels: float = PIXELS, visible: float = 0.55, least: int = 5) -> DataFrame:
    """A4: a row for each track with ``least`` detections or more that is no staff's: distance_m, sprints, top_ms, mean_ms, fast_runs.

    boxes: match_id, track_id, frame_idx, at (seconds), x1, y1, x2, y2, world_x, world_y (null where unknown: then the share of the picture that shows ``visible`` of the
    pitch), approximate. Boxes off the pitch or in the picture's upper or lower 15 % don't count.
    """
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    rough = [c / size * (length * visible) for c, size, length in zip((cx, cy), PICTURE, PITCH, strict=True)]
    on = rough[0].between(-MARGIN, PITCH[0] + MARGIN) & rough[1].between(-MARGIN, PITCH[1] + MARGIN) & (cy / PICTURE[1]).between(*BAND)
    both = F.col("world_x").isNotNull() & F.col("world_y").isNotNull()
    rows = boxes.where(on).select(
        *TRACK, "frame_idx", "at", (cx / pixels).alias("px"), (cy / pixels).alias("py"), F.when(both, F.col("world_x")).otherwise(rough[0]).alias("wx"), F.when(both, F.col("world_y")).otherwise(rough[1]).alias("wy"),
        F.coalesce("approximate", F.lit(False)).alias("approximate"))
    names = ["match_id", "track_id", "distance_m", "sprints", "top_ms", "mean_ms", "fast_runs"]

    def code(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("frame_idx", kind="stable")
        out = velocity_of(*(p[c].to_numpy() for c in ("frame_idx", "at", "px", "py", "wx", "wy", "approximate")))
        return pd.DataFrame([(p.match_id.iloc[0], p.track_id.iloc[0], *out)], columns=names)

    chosen = tracks.where((F.coalesce("detections", F.lit(0)) >= least) & ~F.coalesce("is_staff", F.lit(False))).select(*TRACK, "team_id")
    made = rows.join(chosen.select(*TRACK), TRACK, "left_semi").groupBy(*TRACK).applyInPandas(code, "match_id string, track_id long, distance_m double, sprints long, top_ms double, mean_ms double, fast_runs long")
    out = chosen.join(made, TRACK, "left")
    return out.na.fill(0.0, ["distance_m", "top_ms", "mean_ms"]).na.fill(0, ["sprints", "fast_runs"])


def team_velocities(found: DataFrame) -> DataFrame:
    """A4 by team: tracks, metres, sprints, the highest top speed and the mean of means."""
    return found.groupBy("match_id", "team_id").agg(F.count("*").alias("tracks"), F.round(F.sum("distance_m"), 1).alias("distance_m"), F.sum("sprints").alias("sprints"), F.max("top_ms").alias("top_ms"), F.round(F.avg("mean_ms"), 4).alias("mean_ms"))

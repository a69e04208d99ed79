"""Rules that are recursive along a track or match: small numpy helpers, one call per bounded group.

A track has one row per frame at most (135,000 for a match), and a match is first reduced to one row per
frame where a rule works by match. Each helper takes arrays in frame order and returns arrays of that length.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACK = ["match_id", "track_id"]
FPS = 25.0


def _per(df: DataFrame, by: list[str], schema: str, code) -> DataFrame:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        return code(part.sort_values("frame_idx", kind="stable"))

    return df.groupBy(*by).applyInPandas(run, schema)


def kept_after_jumps(frame, x, y, limit: float = 8.0) -> np.ndarray:
    """Whether a point is kept: at most ``limit`` m per frame from the last kept point."""
    out = np.zeros(len(frame), dtype=bool)
    last = -1
    for i in range(len(frame)):
        if last < 0 or np.hypot(x[i] - x[last], y[i] - y[last]) <= limit * (frame[i] - frame[last]):
            out[i], last = True, i
    return out


def drop_jumps(points: DataFrame, limit: float = 8.0) -> DataFrame:
    """P15."""
    schema = "match_id string, track_id long, team_id long, frame_idx long, x double, y double"
    cols = [c.split()[0] for c in schema.split(", ")]
    return _per(points.select(*cols), TRACK, schema, lambda p: p[kept_after_jumps(p.frame_idx.to_numpy(), p.x.to_numpy(), p.y.to_numpy(), limit)])


def capped(frame, x, y, step: float = 2.8, top: float = 11.5, up: float = 5.0, down: float = 7.0):
    """Positions re-placed along each move so that step, speed and acceleration stay in bounds."""
    ox, oy = x.astype(float).copy(), y.astype(float).copy()
    speed = 0.0
    for i in range(1, len(frame)):
        n = frame[i] - frame[i - 1]
        dt = n / FPS
        dx, dy = ox[i] - ox[i - 1], oy[i] - oy[i - 1]
        d = float(np.hypot(dx, dy))
        v = min(d / dt, step * n / dt, top)
        if i > 1:
            v = min(max(v, speed - down * dt), speed + up * dt)
        if d > 0:
            k = v * dt / d
            ox[i], oy[i] = ox[i - 1] + dx * min(k, 1.0), oy[i - 1] + dy * min(k, 1.0)
            v = min(v, d / dt)
        else:
            v = 0.0
        speed = v
    return ox, oy


def cap_motion(points: DataFrame) -> DataFrame:
    """P16."""
    schema = "match_id string, track_id long, frame_idx long, x double, y double"

    def code(p: pd.DataFrame) -> pd.DataFrame:
        x, y = capped(p.frame_idx.to_numpy(), p.x.to_numpy(), p.y.to_numpy())
        return p[["match_id", "track_id", "frame_idx"]].assign(x=x, y=y)

    return _per(points.select("match_id", "track_id", "frame_idx", "x", "y"), TRACK, schema, code)


def kalman(values: np.ndarray, q: float = 0.5, r: float = 1.0, p0: float = 10.0) -> np.ndarray:
    """Constant-velocity filter of one coordinate; NaN is filled by the prediction."""
    first = int(np.argmax(~np.isnan(values))) if (~np.isnan(values)).any() else -1
    out = values.astype(float).copy()
    if first < 0:
        return out
    pos, vel = float(values[first]), 0.0
    a, b, d = p0, 0.0, p0  # covariance: position, cross, velocity
    for i in range(first + 1, len(values)):
        pos += vel
        a, b, d = a + 2 * b + d + q, b + d, d + q
        if not np.isnan(values[i]):
            s = a + r
            gain, gain_v, e = a / s, b / s, values[i] - pos
            pos, vel = pos + gain * e, vel + gain_v * e
            a, b, d = (1 - gain) * a, (1 - gain) * b, d - gain_v * b
        out[i] = pos
    return out


def kalman_tracks(points: DataFrame) -> DataFrame:
    """P22."""
    schema = "match_id string, track_id long, frame_idx long, x double, y double"
    return _per(points.select("match_id", "track_id", "frame_idx", "x", "y"), TRACK, schema, lambda p: p.assign(x=kalman(p.x.to_numpy(dtype=float)), y=kalman(p.y.to_numpy(dtype=float))))


MATRIX = [f"h{k}" for k in range(9)]


def smoothed_matrices(h: np.ndarray, q: float = 1e-4, r: float = 1e-2) -> np.ndarray:
    """P22 for maps of the pitch: rows of nine values, each over its last one, filtered as constant; all values share one gain.

    The first row is taken as it is; rows whose last value is nearly zero stay as they are and tell the filter nothing.
    """
    out, state, p = h.astype(float).copy(), None, 1.0
    for i in np.flatnonzero(np.abs(out[:, 8]) >= 1e-9):
        z = out[i] / out[i, 8]
        if state is None:
            state = z
        else:
            p += q
            gain = p / (p + r)
            state, p = state + gain * (z - state), (1 - gain) * p
        out[i] = state
    return out


def smooth_homographies(maps: DataFrame) -> DataFrame:
    """P22 over (match_id, frame_idx, h0 to h8): a match has one map a sampled frame."""

    def code(p: pd.DataFrame) -> pd.DataFrame:
        return p.assign(**dict(zip(MATRIX, smoothed_matrices(p[MATRIX].to_numpy(dtype=float)).T, strict=True)))

    return _per(maps.select("match_id", "frame_idx", *MATRIX), ["match_id"], "match_id string, frame_idx long, " + ", ".join(f"{c} double" for c in MATRIX), code)


def held_possession(who: np.ndarray, least: int = 3, state: tuple[int, int, int] = (-1, -1, 0)) -> tuple[np.ndarray, tuple[int, int, int]]:
    """Holder with hysteresis: changes when another has been nearest ``least`` rows on end; -1 rows carry it forward.

    The state (holder, rival, rows of the rival) lets a stream go on where a batch ended.
    """
    out = np.full(len(who), -1, dtype=np.int64)
    holder, rival, n = state
    for i, w in enumerate(who):
        if w >= 0:
            if holder < 0 or w == holder:
                holder, rival, n = int(w), -1, 0
            else:
                n = n + 1 if w == rival else 1
                rival = int(w)
                if n >= least:
                    holder, rival, n = rival, -1, 0
        out[i] = holder
    return out, (holder, rival, n)


def possession_hysteresis(near: DataFrame, least: int = 3) -> DataFrame:
    """W5 over one row per frame (match_id, frame_idx, carrier; null or -1 without one): what ``held_possession`` gives, as one window.

    A holder is whoever was nearest ``least`` times on end last, before that the first one: such a run gives the ball to its player, whoever held it.
    """
    over = "OVER (PARTITION BY match_id ORDER BY frame_idx)"
    rows = near.select("match_id", "frame_idx", F.when(F.col("carrier") >= 0, F.col("carrier").cast("long")).alias("_w"))
    run = " AND ".join(["_w IS NOT NULL", *(f"_w = lag(_w, {k}) IGNORE NULLS {over}" for k in range(1, least))])
    rows = rows.withColumn("_held", F.expr(f"CASE WHEN {run} THEN _w END"))
    up_to = "OVER (PARTITION BY match_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)"
    return rows.select("match_id", "frame_idx", F.expr(f"coalesce(last(_held) IGNORE NULLS {up_to}, first(_w) IGNORE NULLS {up_to}, -1L)").alias("carrier"))


def sprints(t: np.ndarray, v: np.ndarray, top: int = 5) -> list[tuple[float, float, float]]:
    """(start, end, peak): from 7 m/s after a second under 4 m/s, to under 4.5 m/s; a second long, or 0.4 s if still open at the end; merged within 2 s; the ``top`` by peak."""
    found, start, peak, last_fast = [], None, 0.0, -np.inf
    for i in range(len(t)):
        if start is None:
            if v[i] >= 7 and t[i] - last_fast >= 1.0:
                start, peak = t[i], v[i]
        else:
            peak = max(peak, v[i])
            if v[i] < 4.5:
                if t[i] - start >= 1.0:
                    found.append((start, t[i], peak))
                start = None
        if v[i] >= 4 and start is None:
            last_fast = t[i]
    if start is not None and t[-1] - start >= 0.4:
        found.append((start, t[-1], peak))
    merged: list[tuple[float, float, float]] = []
    for s in found:
        if merged and s[0] - merged[-1][1] < 2.0:
            merged[-1] = (merged[-1][0], s[1], max(merged[-1][2], s[2]))
        else:
            merged.append(s)
    return sorted(sorted(merged, key=lambda s: (-s[2], s[0]))[:top])


def sprint_intervals(stepped: DataFrame) -> DataFrame:
    """W9 over rows with speed_ms."""
    schema = "match_id string, track_id long, start_s double, end_s double, peak_ms double"

    def code(p: pd.DataFrame) -> pd.DataFrame:
        p = p[p.speed_ms.notna()]
        rows = sprints(p.frame_idx.to_numpy() / FPS, p.speed_ms.to_numpy()) if len(p) else []
        out = pd.DataFrame(rows, columns=["start_s", "end_s", "peak_ms"], dtype=float)
        out.insert(0, "track_id", int(p.track_id.iloc[0]) if len(p) else 0)
        out.insert(0, "match_id", p.match_id.iloc[0] if len(p) else "")
        return out

    return _per(stepped.select("match_id", "track_id", "frame_idx", "speed_ms"), TRACK, schema, code)


def spectrum(v: np.ndarray) -> tuple[float, float]:
    """Share of amplitude at and above a quarter of the row count, and normalised entropy of the amplitudes; (0, 0) under eight rows."""
    n = len(v)
    if n < 8:
        return 0.0, 0.0
    amp = np.round(np.abs(np.fft.fft(v)[: n // 2]) / n, 4)
    total = amp.sum()
    if total <= 0:
        return 0.0, 0.0
    p = amp[amp > 0] / total
    return round(float(amp[n // 4 :].sum() / total), 3), round(float(-(p * np.log(p)).sum() / np.log(len(amp))), 3)


def recoveries(fast: np.ndarray) -> list[int]:
    """Rows from the end of each sprint to the start of the next."""
    edge = np.diff(fast.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [int(s - e) for s, e in zip(starts[1:], ends, strict=False)]


def fatigue_of(v: np.ndarray, sprint_ms: float = 5.5, row_s: float = 0.08) -> dict | None:
    """A17 over a player's speeds: four marks of tiring in percent, seconds and points, the spectrum's points, and the score."""
    if len(v) < 10:
        return None
    a, b = v[: len(v) // 2], v[len(v) // 2 :]
    drop = max(0.0, (a.max() - b.max()) / a.max() * 100) if a.max() > 0 else 0.0
    fast = [x[x >= sprint_ms].mean() if (x >= sprint_ms).any() else 0.0 for x in (a, b)]
    drift = max(0.0, (fast[0] - fast[1]) / fast[0] * 100) if fast[0] > 0 else 0.0
    rest = recoveries(v >= sprint_ms)
    half = len(rest) // 2
    expansion = max(0.0, (np.mean(rest[half:]) - np.mean(rest[:half])) * row_s) if len(rest) >= 4 else 0.0
    mean = v.mean()
    predictability = max(0.0, (1 - min(v.std() / mean, 1.0)) * 100) if mean > 0 else 50.0
    high, entropy = spectrum(v)
    slow = round((1 - high) * 50 + (1 - entropy) * 50) if (high, entropy) != (0.0, 0.0) else 0
    parts = ((drop * 2, 0.30), (drift * 1.5, 0.25), (expansion * 15, 0.15), (predictability, 0.10), (slow, 0.20))
    score = round(sum(min(100.0, max(0.0, x)) * w for x, w in parts))
    return {
        "ceiling_drop": round(drop, 1), "sprint_drift": round(drift, 1), "recovery_s": round(float(expansion), 2), "predictability": round(float(predictability), 1),
        "high_share": high, "entropy": entropy, "score": score, "label": "HIGH" if score >= 70 else "MEDIUM" if score >= 40 else "LOW",
    }


def fatigue(stepped: DataFrame) -> DataFrame:
    """One row for each track of ten speeds or more, as ``fatigue_of``."""
    schema = "match_id string, track_id long, ceiling_drop double, sprint_drift double, recovery_s double, predictability double, high_share double, entropy double, score long, label string"
    names = [c.split()[0] for c in schema.split(", ")]

    def code(p: pd.DataFrame) -> pd.DataFrame:
        got = fatigue_of(p.speed_ms.dropna().to_numpy(dtype=float))
        rows = [{"match_id": p.match_id.iloc[0], "track_id": int(p.track_id.iloc[0]), **got}] if got else []
        return pd.DataFrame(rows, columns=names)

    return _per(stepped.select("match_id", "track_id", "frame_idx", "speed_ms"), TRACK, schema, code)


def trend_of(xs: list[float], ys: list[float]) -> tuple[float, float, float, float, float]:
    """(slope, R2, mean, deviation, last) of two values or more at growing places, one by one; products of both are added without rounding between, as DuckDB adds them."""
    mx = my = xy = xx = yy = total = 0.0
    for n, (x, y) in enumerate(zip(xs, ys, strict=True), 1):
        dx, dy = x - mx, y - my
        mx, my = mx + dx / n, my + dy / n
        xy, xx, yy, total = math.fma(dx, y - my, xy), xx + (x - mx) * dx, yy + (y - my) * dy, total + y
    sx, sy = math.sqrt(xx / n), math.sqrt(yy / n)
    r = (xy / n) / (sx * sy) if yy else 1.0
    return (xy / n) / (xx / n), r * r, total / n, sy, y


def trend():
    """``trend_of`` for arrays of (place, value)."""

    @F.arrow_udf("struct<slope:double,r2:double,mean:double,sd:double,last:double>")
    def found(rows: pa.Array) -> pa.Array:
        x, y = (rows.flatten().field(k).to_pylist() for k in (0, 1))
        off = np.concatenate([[0], np.cumsum(np.diff(rows.offsets.to_numpy()))]).tolist()
        out = zip(*(trend_of(x[a:b], y[a:b]) for a, b in zip(off, off[1:])), strict=True)
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in out] if len(rows) else [pa.array([], pa.float64())] * 5, ["slope", "r2", "mean", "sd", "last"])

    return found


def nearest_share(nx: int, ny: int, step: float, at_once: int = 64):
    """Of arrays of (track_id, team_id, x, y) in order of track_id, the share of lattice points nearest to team 0."""
    gx, gy = np.repeat(np.arange(nx), ny) * step, np.tile(np.arange(ny), nx) * step

    @F.arrow_udf("double")
    def share(ps: pa.Array) -> pa.Array:
        rows = ps.flatten()
        x, y, team = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "team_id"))
        off = np.concatenate([[0], np.cumsum(np.diff(ps.offsets.to_numpy()))])
        out = np.zeros(len(ps))
        for a in range(0, len(ps), at_once):
            b = min(len(ps), a + at_once)
            own = slice(off[a], off[b])
            first = off[a:b] - off[a]
            d = (x[own, None] - gx) * (x[own, None] - gx) + (y[own, None] - gy) * (y[own, None] - gy)
            least = np.repeat(np.minimum.reduceat(d, first, axis=0), np.diff(off[a : b + 1]), axis=0)
            owner = np.minimum.reduceat(np.where(d == least, np.arange(off[b] - off[a])[:, None], off[b]), first, axis=0)
            out[a:b] = (team[own][owner] == 0).sum(axis=1) / (nx * ny)
        return pa.array(out)

    return share


def widest_angle(angles: np.ndarray) -> float:
    """Largest angle in degrees between two of these directions."""
    if len(angles) < 2:
        return 0.0
    d = np.abs(angles[:, None] - angles[None])
    return float(np.minimum(d, 360.0 - d).max())


def hull_area(points: list[tuple[float, float]]) -> float:
    """Area of the convex hull; 0 for fewer than three points."""
    p = sorted(set(points))
    if len(p) < 3:
        return 0.0

    def chain(some):
        out: list[tuple[float, float]] = []
        for q in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    hull = chain(p) + chain(p[::-1])
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1], strict=True))) / 2


def press_geometry():
    """(spread, area) of a carrier's place and an array of pressers' places."""

    @F.arrow_udf("struct<spread:double,area:double>")
    def geometry(cx: pa.Array, cy: pa.Array, ps: pa.Array) -> pa.Array:
        spread, area = [], []
        for x, y, rows in zip(cx.to_pylist(), cy.to_pylist(), ps.to_pylist(), strict=True):
            own = [(r["x"], r["y"]) for r in rows]
            spread.append(widest_angle(np.degrees(np.arctan2([q[1] - y for q in own], [q[0] - x for q in own]))))
            area.append(hull_area([(x, y), *own]))
        return pa.StructArray.from_arrays([pa.array(spread, pa.float64()), pa.array(area, pa.float64())], ["spread", "area"])

    return geometry


def two_means(f: np.ndarray, weights=(2.0, 1.5, 0.5), rounds: int = 50) -> np.ndarray:
    """Labels 0 and 1 of weighted 2-means that starts from the farthest pair; label 0 has the lower first feature."""
    z = f * np.sqrt(np.array(weights))
    if len(z) < 2:
        return np.zeros(len(z), dtype=np.int64)
    far = ((z[:, None] - z[None]) ** 2).sum(-1)
    i, j = np.unravel_index(far.argmax(), far.shape)
    c = z[[i, j]]
    label = np.zeros(len(z), dtype=np.int64)
    for _ in range(rounds):
        new = ((z[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        if (new == label).all() and _:
            break
        label = new
        c = np.stack([z[label == k].mean(0) if (label == k).any() else c[k] for k in (0, 1)])
    return label if c[0][0] <= c[1][0] else 1 - label


def teams_by_colour(features: DataFrame) -> DataFrame:
    """A36 over one row per track (match_id, track_id, hue, sat_ratio, brightness, hits): tracks of 15 hits and more set the centres."""
    schema = "match_id string, track_id long, team_id long"

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("track_id")
        f = p[["hue", "sat_ratio", "brightness"]].to_numpy(dtype=float)
        firm = (p.hits >= 15).to_numpy()
        label = np.full(len(p), -1, dtype=np.int64)
        if firm.sum() >= 2:
            label[firm] = two_means(f[firm])
            w = np.sqrt(np.array((2.0, 1.5, 0.5)))
            centres = np.stack([f[firm][label[firm] == k].mean(0) if (label[firm] == k).any() else np.full(3, np.inf) for k in (0, 1)])
            label[~firm] = (((f[~firm][:, None] - centres[None]) * w) ** 2).sum(-1).argmin(1)
        return p[["match_id", "track_id"]].assign(team_id=label)

    return features.groupBy("match_id").applyInPandas(run, schema)


def drift(v: np.ndarray, low: float = 0.5, patience: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """I12 over one player's rows, from the first one on."""
    return drift_from(v, None, low, patience)[:2]


def drift_from(v, state: tuple[np.ndarray, int] | None, low: float = 0.5, patience: int = 5) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, int]]:
    """Cosine of each row to the anchor, and where the anchor is reset (after ``patience`` rows under ``low``).

    The state (anchor, rows under ``low`` on end) lets a stream go on where a batch ended; without one the first row is the anchor.
    """
    sims, resets = np.ones(len(v)), np.zeros(len(v), dtype=bool)
    anchor, under = state or (v[0], 0)
    for i in range(0 if state else 1, len(v)):
        norm = np.linalg.norm(anchor) * np.linalg.norm(v[i]) if len(anchor) == len(v[i]) else 0.0
        sims[i] = float(anchor @ v[i] / norm) if norm > 0 else 0.0
        under = under + 1 if sims[i] < low else 0
        if under >= patience:
            anchor, under, resets[i] = v[i], 0, True
    return sims, resets, (anchor, under)


def embedding_drift(rows: DataFrame, trigger: float = 0.70) -> DataFrame:
    """I12 over (match_id, player_id, frame_idx, embedding): counts of rows, alerts and resets, and the least similarity."""
    schema = "match_id string, player_id string, n long, alerts long, resets long, least double"

    def code(p: pd.DataFrame) -> pd.DataFrame:
        sims, resets = drift(np.stack(p.embedding.to_list()).astype(float))
        return pd.DataFrame([(p.match_id.iloc[0], p.player_id.iloc[0], len(p), int((sims < trigger).sum()), int(resets.sum()), round(float(sims.min()), 5))], columns=["match_id", "player_id", "n", "alerts", "resets", "least"])

    return _per(rows, ["match_id", "player_id"], schema, code)


def nearest_rows(a: np.ndarray, reach: int) -> np.ndarray:
    """Between the first and last value of each column, the nearest one up to ``reach`` rows away, the earlier on ties."""
    n = len(a)
    row = np.arange(n)[:, None]
    there = ~np.isnan(a)
    before = np.maximum.accumulate(np.where(there, row, -n), axis=0)
    after = np.minimum.accumulate(np.where(there, row, 2 * n)[::-1], axis=0)[::-1]
    best = np.where(row - before <= after - row, before, after)
    ok = (before >= 0) & (after < n) & (np.abs(best - row) <= reach)
    return np.where(ok, np.take_along_axis(a, np.clip(best, 0, n - 1), axis=0), np.nan)


def capped_players(p: pd.DataFrame, most: int = 25, near: float = 10.0, drops: int = 20, reach: int = 4) -> list[tuple[int, int, int]]:
    """P18 for one match's points: (frame, dropped track, track it gave way to).

    In each frame with over ``most`` active tracks (three rows or more, one within ``reach`` frames) the closest pair gives up the
    track of fewer rows, pairs of one team first, unless it is over ``near`` m apart; dropped tracks stay away; ``drops`` a match.
    """
    hits = p.groupby("track_id").size()
    p = p[p.track_id.isin(hits.index[hits >= 3])]
    tracks = np.array(sorted(p.track_id.unique()))
    team = p.groupby("track_id").team_id.min().reindex(tracks).to_numpy()
    frames = np.arange(p.frame_idx.min(), p.frame_idx.max() + 1) if len(p) else np.zeros(0, np.int64)
    place = [nearest_rows(p.pivot(index="frame_idx", columns="track_id", values=c).reindex(index=frames, columns=tracks).to_numpy(), reach) for c in ("x", "y")] if len(p) else []
    gone, out = np.zeros(len(tracks), dtype=bool), []
    busy = np.flatnonzero((~np.isnan(place[0])).sum(1) > most) if len(p) else []
    for f in busy:
        active = np.flatnonzero(~np.isnan(place[0][f]) & ~gone)
        while len(active) > most and len(out) < drops:
            x, y, t = place[0][f][active], place[1][f][active], team[active]
            d = np.hypot(x[:, None] - x, y[:, None] - y)
            d[np.tril_indices(len(active))] = np.inf
            same = np.where(t[:, None] == t, d, np.inf)
            d = same if np.isfinite(same).any() else d
            i, j = divmod(int(d.argmin()), len(active))
            if d[i, j] > near:
                break
            weak, strong = (j, i) if hits[tracks[active[i]]] >= hits[tracks[active[j]]] else (i, j)
            out.append((int(frames[f]), int(tracks[active[weak]]), int(tracks[active[strong]])))
            gone[active[weak]] = True
            active = np.delete(active, weak)
        if len(out) >= drops:
            break
    return out


def cap_players(points: DataFrame, most: int = 25) -> DataFrame:
    """The tracks that are dropped, with the frame and the track they gave way to."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(p.match_id.iloc[0], *row) for row in capped_players(p, most)], columns=["match_id", "frame_idx", "track_id", "kept"])

    return points.select("match_id", "track_id", "team_id", "frame_idx", "x", "y").groupBy("match_id").applyInPandas(run, "match_id string, frame_idx long, track_id long, kept long")


def stitched(pieces: pd.DataFrame, gap: int = 10, metres: float = 12.0) -> pd.DataFrame:
    """Joins each fragment to the nearest next one of its team within ``gap`` frames and ``metres``; ids of the first."""
    p = pieces.sort_values(["first_seen", "track_id"]).reset_index(drop=True)
    root, taken = list(range(len(p))), np.zeros(len(p), dtype=bool)
    track, team, first, last, x0, y0, x1, y1 = (p[c].to_numpy() for c in ("track_id", "team_id", "first_seen", "last_seen", "x0", "y0", "x1", "y1"))
    start, end = np.searchsorted(first, last, side="right"), np.searchsorted(first, last + gap, side="right")
    for i in range(len(p)):
        j = np.arange(start[i], end[i])
        j = j[~taken[j] & (team[j] == team[i]) & (j != i)]
        m = np.round(np.hypot(x1[i] - x0[j], y1[i] - y0[j]), 6)
        j, m = j[m < metres], m[m < metres]
        if len(j):
            best = j[np.lexsort((track[j], m))[0]]
            taken[best] = True
            root[best] = root[i]
    return pd.DataFrame({"match_id": p.match_id, "track_id": p.track_id, "thread": [int(p.track_id[r]) for r in root]})


def stitch(pieces: DataFrame, gap: int = 10, metres: float = 12.0) -> DataFrame:
    """I6 per match and team; fragments are few hundred for each."""
    return pieces.groupBy("match_id", "team_id").applyInPandas(lambda p: stitched(p, gap, metres), "match_id string, track_id long, thread long")

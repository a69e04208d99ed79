"""Phases and anomalies of a match against a walk over its frames."""

import random

from pitchflow.operators import quality


def walk(counts):
    """Phase of each frame, by a streak of candidates."""
    phase, pending, streak, was, out = "unknown", None, 0, None, []
    for n in counts:
        health = 1.0 if n >= 10 else 0.6 + (n - 5) / 12.5 if n >= 5 else 0.3 + (n - 1) / 13.3 if n else 0.0
        by = abs(n - was) if was is not None else 0
        health = round(health * (0.4 if by > 8 else 0.7 if by > 4 else 1.0), 3)
        health = 0.1 if not n else min(health, 0.4) if n < 3 else min(health, 1.0)
        says = "dead_ball" if n < 2 and health < 0.3 else "open_play" if n >= 8 else phase
        streak = streak + 1 if says == pending else 1
        pending = says
        if streak >= 3:
            phase = says
        out.append((n, health, phase))
        was = n
    return out


def test_phases_against_a_walk(spark):
    rng = random.Random(3)
    matches = {m: [] for m in "abc"}
    for counts in matches.values():
        n = 11
        for _ in range(300):
            n = rng.choice([0, 0, 1, 2, 6, 8, 11, 22, 27]) if rng.random() < 0.3 else n
            counts.append(n)
    points = spark.createDataFrame([(m, f, k, k % 2, 3.5 * k, 1.0) for m, counts in matches.items() for f, n in enumerate(counts) for k in range(n)], "match_id string, frame_idx long, track_id long, team_id long, x double, y double")
    seen = quality.observed(points, spark.createDataFrame([(m, 300) for m in matches], "match_id string, frames_processed long"))
    rows = seen.orderBy("match_id", "frame_idx").collect()
    assert [(r.n, r.health, r.phase) for r in rows] == [x for counts in matches.values() for x in walk(counts)]
    assert {r.phase for r in rows} == {"unknown", "dead_ball", "open_play"} or {r.phase for r in rows} == {"dead_ball", "open_play"}
    runs = quality.match_phases(seen).orderBy("match_id", "run").collect()
    for m, counts in matches.items():
        own, want = [r for r in runs if r.match_id == m], walk(counts)
        starts = [f for f in range(300) if not f or want[f][2] != want[f - 1][2]]
        assert [(r.phase, r.start_s, r.end_s) for r in own] == [(want[a][2], round(a / 25, 1), round((b if b is not None else 299) / 25, 1)) for a, b in zip(starts, [*starts[1:], None], strict=True)]
    speeds = spark.createDataFrame([("a", 5, 3, 10.5), ("a", 6, 3, 10.0)], "match_id string, frame_idx long, track_id long, speed_ms double")
    got = {}
    for r in quality.anomalies(seen, points, speeds).collect():
        got.setdefault(r.anomaly, set()).add((r.match_id, r.frame_idx, r.subject))
    want = {k: set() for k in ("camera_interruption", "track_instability", "overcounting", "geometry_unreliable")}
    for m, counts in matches.items():
        wide = {0: 0.0, 1: 0.0}
        for f, n in enumerate(counts):
            if not n:
                want["camera_interruption"].add((m, f, None))
            if f and abs(n - counts[f - 1]) > 8:
                want["track_instability"].add((m, f, f"{counts[f - 1]}-{n}"))
            if n > 25:
                want["overcounting"].add((m, f, str(n)))
            for team in (0, 1):
                own = [3.5 * k for k in range(n) if k % 2 == team]
                if n >= 3 and len(own) >= 3:
                    wide[team] = max(own) - min(own)
                if wide[team] > 68:
                    want["geometry_unreliable"].add((m, f, str(team)))
    assert got == want | {"speed_spike": {("a", 5, "3")}}

"""Velocities and smoothed carriers against plain walks over the rows."""

import math
import random
from collections import Counter
from statistics import median

import numpy as np

from pitchflow.operators import possession, velocity


def plain_sprints(speed, at):
    runs, start = [], None
    for i, v in enumerate(speed):
        if v >= 7:
            if start is None and all(speed[j] < 4 for j in range(i) if at[i] - at[j] <= 1):
                start = i
        elif v < 4.5 and start is not None:
            if at[i] - at[start] >= 1:
                runs.append([at[start], at[i], max(speed[start : i + 1])])
            start = None
    if start is not None and at[-1] - at[start] >= 0.4:
        runs.append([at[start], at[-1], max(speed[start:])])
    one = []
    for r in runs:
        if one and r[0] - one[-1][1] < 2:
            one[-1][1:] = [max(r[1], one[-1][1]), max(r[2], one[-1][2])]
        else:
            one.append(r)
    return one


def plain(rows):
    """rows: (frame, second, px, py, wx, wy, approximate): metres, sprints, top, mean, fast runs."""
    kept = rows[:1]
    for r in rows[1:]:
        p = kept[-1]
        if math.dist(r[2:4], p[2:4]) <= 8 * max(abs(r[0] - p[0]), 1):
            kept.append(r)
    if len(kept) < 2:
        return (0.0, 0, 0.0, 0.0, 0)
    n = len(kept)
    flat = [kept[i][4:6] if i in (0, n - 1) else [sum(kept[j][k] for j in (i - 1, i, i + 1)) / 3 for k in (4, 5)] for i in range(n)]
    total, speed, at = 0.0, [], []
    for i in range(1, n):
        dt = kept[i][1] - kept[i - 1][1]
        at.append(kept[i][1])
        if dt <= 0:
            speed.append(0.0)
            continue
        step = min(math.dist(flat[i], flat[i - 1]), 0.48) * (0.85 if kept[i][6] else 1)
        total += step if step >= 0.3 else 0
        speed.append(step / dt if step / dt <= 12 else 0.0)
    if len(speed) >= 5:
        speed = [median(speed[max(0, i - 2) : i + 3]) for i in range(len(speed))]
    one = plain_sprints(speed, at)
    fast = sum(v >= 5.5 and (not i or speed[i - 1] < 5.5) for i, v in enumerate(speed))
    return (round(total, 1), min(len(one), 5), round(min(max(speed), 12), 2), round(sum(speed) / len(speed), 2), fast)


def test_velocities_against_a_walk(spark):
    rng = random.Random(5)
    boxes, want = [], {}
    for track in range(30):
        f, x, y, rows, v = 0, 30.0, 30.0, [], 0.1
        for _ in range(rng.choice([1, 2, 4, 60, 400, 400, 400])):
            v = rng.choice([0.02, 0.1, 0.12, 0.31, 0.36, 0.4, 0.46]) if rng.random() < 0.02 else v
            x, y = 10 + (x - 10 + v) % 45, y + rng.uniform(-0.01, 0.01)
            f += 1 if rng.random() < 0.95 else rng.randrange(2, 5)
            far = 400 if rng.random() < 0.02 else 0
            cx, cy = x * 1920 / 105 / 0.55 + far, y * 1080 / 68 / 0.55 + (600 if rng.random() < 0.02 else 0)
            known, approx = rng.random() < 0.9, rng.choice([True, False, False, None])
            wx, wy = (x, y) if known else (cx / 1920 * 105 * 0.55, cy / 1080 * 68 * 0.55)
            at = f / 25 if rng.random() < 0.98 else (rows[-1][1] if rows else 0.0)
            boxes.append(("m", track, f, at, cx - 10, cy - 20, cx + 10, cy + 20, x if known else None, y if known and rng.random() < 2 else None, approx))
            if 0.15 <= cy / 1080 <= 0.85 and cx / 1920 * 105 * 0.55 <= 110:
                rows.append((f, at, cx / 15.5, cy / 15.5, wx, wy, bool(approx)))
        want[track] = plain(rows) if len(rows) > 1 else (0.0, 0, 0.0, 0.0, 0)
    frame = spark.createDataFrame(boxes, "match_id string, track_id long, frame_idx long, at double, x1 double, y1 double, x2 double, y2 double, world_x double, world_y double, approximate boolean")
    tracks = spark.createDataFrame([("m", k, k % 2, 5 if k != 3 else 4, k == 4) for k in range(31)], "match_id string, track_id long, team_id long, detections long, is_staff boolean")
    got = {r.track_id: (r.distance_m, r.sprints, r.top_ms, r.mean_ms, r.fast_runs) for r in velocity.velocities(frame, tracks).collect()}
    assert set(got) == set(range(31)) - {3, 4} and got[30] == (0.0, 0, 0.0, 0.0, 0)
    for k in set(range(30)) - {3, 4}:
        assert np.allclose(got[k], want[k], atol=0.011), k
    assert sum(g[1] for g in got.values()) > 0 and sum(g[4] for g in got.values()) > 10
    teams = velocity.team_velocities(velocity.velocities(frame, tracks)).collect()
    assert sum(t.tracks for t in teams) == 29 and sum(t.sprints for t in teams) == sum(g[1] for g in got.values())


def test_sprints_against_a_walk():
    """A sprint starts from a quiet second, so smoothed speeds have few: here speeds change at once."""
    rng, counts = random.Random(7), Counter()
    for _ in range(60):
        at, speed, v = [0.0], [1.0], 1.0
        for _ in range(rng.randrange(0, 5000)):
            v = rng.choice([1.0, 1.0, 3.9, 4.2, 5.0, 7.5, 9.0]) if rng.random() < 0.04 else v
            at.append(at[-1] + rng.choice([0.0, 0.04, 0.04, 0.04, 0.2]))
            speed.append(v + rng.random() / 10)
        want = plain_sprints(speed, at)
        got = velocity.sprints(np.array(speed), np.array(at))
        counts[len(want)] += 1
        assert len(got) == min(len(want), 5) and sorted(map(tuple, got)) == sorted(sorted(map(tuple, want), key=lambda s: -s[2])[:5])
    assert sum(n for k, n in counts.items() if 0 < k < 6) > 5 and sum(n for k, n in counts.items() if k > 5) > 5


def smoothed_plain(rows):
    """rows: {frame: (carrier, confidence, missing)}: {frame: (carrier, confidence, votes, switched)}."""
    out, prev, had = {}, None, 0
    for f in sorted(rows):
        window = [rows[g] for g in range(f - 6, f + 7) if g in rows and not rows[g][2] and rows[g][0] is not None]
        n = Counter(r[0] for r in window)
        mean = lambda k: sum(r[1] or 0 for r in window if r[0] == k) / n[k]  # noqa: B023, E731
        took = False
        if not n:
            who, votes, sure = prev if prev is not None else rows[f][0], 0, rows[f][1] or 0
        else:
            best, votes = n.most_common(1)[0]
            share = votes / len(window)
            sure = mean(best) * (1 if share >= 0.5 else 2 * share)
            who = best
            if prev is not None and best != prev:
                took = votes >= had + 3
                if not took:
                    who, votes = prev, had
                    sure = mean(prev) * n[prev] / len(window) if n[prev] else max(0.3, sure * 0.5)
            elif prev is None:
                took = True
        out[f] = (who, sure, votes, took)
        if who is not None:
            prev, had = who, votes
    return out


def test_carriers_are_smoothed_with_hysteresis(spark):
    rng = random.Random(6)
    matches = {}
    for m in ("a", "b", "c"):
        rows, f, who = {}, 0, 1
        for _ in range(250):
            f += 1 if rng.random() < 0.95 else rng.randrange(2, 20)
            who = rng.randrange(1, 5) if rng.random() < 0.08 else who
            near = rng.choice([who] * 7 + [rng.randrange(1, 5), None])
            rows[f] = (None if m == "c" and f < 60 else near, rng.choice([None, 0.25, 0.5, 1.0]), rng.random() < 0.1)
        matches[m] = rows
    frame = spark.createDataFrame([(m, f, *r) for m, rows in matches.items() for f, r in rows.items()], "match_id string, frame_idx long, carrier long, confidence double, missing boolean").repartition(4)
    smoothed = possession.smoothed_carriers(frame)
    got = smoothed.collect()
    assert len(got) == 750
    for m, rows in matches.items():
        want = smoothed_plain(rows)
        for r in got:
            if r.match_id == m:
                who, sure, votes, took = want[r.frame_idx]
                assert (r.smooth_carrier, r.votes, r.switched) == (who, votes, took), (m, r.frame_idx)
                assert abs(r.smooth_confidence - sure) < 1e-4
    report = {r.match_id: r for r in possession.smoothing_report(smoothed).collect()}
    for m, rows in matches.items():
        raw = [r[0] for _, r in sorted(rows.items()) if r[0] is not None]
        want = smoothed_plain(rows)
        assert report[m].changes == sum(a != b for a, b in zip(raw, raw[1:], strict=False)) and report[m].smooth_changes == sum(w[3] for w in want.values()) - 1
        assert report[m].frames == 250 and report[m].smooth_changes < report[m].changes

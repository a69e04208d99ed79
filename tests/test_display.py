"""What is shown of each player, frame by frame, against a plain walk over the frames."""

import math
import random
from collections import Counter

from pitchflow.operators import display

PLAYERS = "match_id string, frame_idx long, raw_track_id long, player_id string, is_official boolean, assignment_source string, identity_confidence double, x1 double, y1 double, x2 double, y2 double"
MOTION = "match_id string, frame_idx long, dx double, dy double, motion_class string"


def plain(rows, motion, frames):
    """rows: (frame, raw, player, official, source, confidence, x1, y1, x2, y2): {(player, frame, raw of the box it goes by): (state, reason, box)}."""
    way, at = [], (0.0, 0.0)
    for i, (f, dx, dy, kind) in enumerate(motion):
        at = (0.0, 0.0) if not i or kind == "cut" else (at[0] + dx, at[1] + dy)
        way.append((f, *at, kind))
    cuts = [f for f, *_, k in motion if k == "cut"]

    def offset(f):
        before = [s for s in way if s[0] <= f]
        after = [s for s in way if s[0] > f]
        if not before:
            return (0.0, 0.0)
        p = before[-1]
        if not after or after[0][3] == "cut":
            return p[1:3]
        t = (f - p[0]) / (after[0][0] - p[0])
        return (p[1] + (after[0][1] - p[1]) * t, p[2] + (after[0][2] - p[2]) * t)

    cut = lambda a, b: any(a < c <= b for c in cuts)
    kind_at = lambda f: next((k for g, *_, k in reversed(way) if g <= f), "stable")
    officials = {(r[0], r[1]) for r in rows if r[3]}
    obs = {}
    for r in sorted(rows, key=lambda r: r[:2]):
        if not r[3] and r[2] and r[2].startswith("P") and r[4] in ("locked", "revived"):
            box = [min(max(v, 0.0), m) for v, m in zip(r[6:], (1920, 1080, 1920, 1080), strict=True)]
            obs.setdefault(r[2], []).append((r[0], r[1], r[5] or 0.0, box))
    out, last = {}, {}
    centre = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    for f in range(frames):
        for who, own in obs.items():
            exact = [o for o in own if o[0] == f]
            if exact:
                fit = sorted((o for o in exact if (f, o[1]) not in officials), key=lambda o: (-o[2], o[1]))
                for o in exact:
                    why = "official" if (f, o[1]) in officials else "duplicate_id" if o is not fit[0] else None
                    out[who, f, o[1]] = ("hidden" if why else "visible", why, None if why else o[3])
                if fit:
                    last[who] = centre(fit[0][3])
                continue
            p = next((o for o in reversed(own) if o[0] < f), None)
            n = next((o for o in own if o[0] > f), None)
            state = box = None
            if p is None:
                why = "no_box_before"
            elif n is not None and cut(p[0], n[0]):
                why = "cut"
            elif n is not None and n[0] - p[0] <= 8:
                t = (f - p[0]) / (n[0] - p[0])
                s = t * t * (3 - 2 * t)
                po, no, co = offset(p[0]), offset(n[0]), offset(f)
                c = [(centre(p[3])[i] - po[i]) + ((centre(n[3])[i] - no[i]) - (centre(p[3])[i] - po[i])) * s + co[i] for i in (0, 1)]
                size = [(p[3][i + 2] - p[3][i]) * (1 - t) + (n[3][i + 2] - n[3][i]) * t for i in (0, 1)]
                state, box = "interpolated", [c[0] - size[0] / 2, c[1] - size[1] / 2, c[0] + size[0] / 2, c[1] + size[1] / 2]
            elif f - p[0] <= 15 and not cut(p[0], f):
                state, box = "held", p[3]
            else:
                why = "gap_too_large" if n is not None else "cut" if cut(p[0], f) else "hold_expired"
            raw = (p or n)[1]
            if state:
                why = None
                if (box[2] - box[0]) * (box[3] - box[1]) < 80:
                    why = "empty_box"
                elif who in last and math.dist(centre(box), last[who]) > 140:
                    why = "jump"
            if (f, raw) in officials:
                state, why = None, "official"
            if state and not why and who not in last and kind_at(f) == "fast_pan":
                why = "pan_freeze"
            if state and not why:
                last[who] = centre(box)
            out[who, f, raw] = (state if state and not why else "hidden", why, box if state and not why else None)
    return out


def frames_of(spark, matches):
    players = spark.createDataFrame([(m, *r) for m, (rows, _) in matches.items() for r in rows], PLAYERS)
    motion = spark.createDataFrame([(m, *r) for m, (_, samples) in matches.items() for r in samples], MOTION)
    return players, motion, spark.createDataFrame([(m, 120) for m in matches], "match_id string, frames_processed long")


def match(rng):
    rows = []
    for k in range(6):
        f, x, y = rng.randrange(0, 20), rng.uniform(50, 1800), rng.uniform(50, 900)
        while f < 115:
            wide = rng.choice([30.0] * 9 + [3.0])
            source = rng.choice(["locked"] * 6 + ["revived", "provisional"])
            rows.append((f, k, rng.choice([f"P{k}"] * 12 + [None, "X1"]), False, source, rng.choice([0.5, 0.75, None]), x, y, x + wide, y + 2 * wide))
            if rng.random() < 0.1:
                rows.append((f, 50 + k, f"P{k}", False, "locked", 0.75, x + 9, y, x + 39, y + 60))
            if rng.random() < 0.06:  # the track, or the double's, is an official's for some frames
                rows += [(g, k + rng.choice([0, 50]), None, True, "locked", 0.9, x, y, x + 30, y + 60) for g in range(f, f + rng.randrange(1, 5))]
            f += rng.choice([1, 1, 1, 2, 5, 8, 9, 14, 25])
            x, y = (x + rng.uniform(-30, 30), y) if rng.random() < 0.85 else (rng.uniform(0, 1900), rng.uniform(0, 1000))
    motion = [(f, rng.uniform(-40, 40), rng.uniform(-5, 5), rng.choice(["stable", "pan", "fast_pan", "fast_pan", "cut"] if rng.random() < 0.4 else ["stable"])) for f in range(3, 118, 5)]
    return rows, motion


def test_against_a_walk_over_frames(spark):
    rng = random.Random(4)
    matches = {f"m{k}": match(rng) for k in range(6)}
    matches["none"] = (match(rng)[0], [])
    players, motion, sizes = frames_of(spark, matches)
    decided = display.decisions(display.candidates(players, motion, sizes))
    rows = decided.collect()
    seen = Counter()
    for m, (own, samples) in matches.items():
        want = plain(own, samples, 120)
        got = {(r.player_id, r.frame_idx, r.raw_track_id): r for r in rows if r.match_id == m}
        assert got.keys() == want.keys()
        for key, (state, why, box) in want.items():
            r = got[key]
            assert (r.state, r.reason) == (state, why), (m, key)
            assert (r.x1 is None) == (box is None) and (box is None or all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip((r.x1, r.y1, r.x2, r.y2), box, strict=True)))
            seen[why or state] += 1
    assert set(seen) == {"visible", "interpolated", "held", "cut", "gap_too_large", "hold_expired", "no_box_before", "empty_box", "official", "duplicate_id", "jump", "pan_freeze"}
    out = {r.match_id: r for r in display.manifest(decided, players, motion, sizes).collect()}
    for m in matches:
        own = [r for r in rows if r.match_id == m]
        assert out[m].sound and out[m].frames == 120 and out[m].hidden_jump == sum(r.reason == "jump" for r in own) and out[m].visible_boxes == sum(r.state == "visible" for r in own)
        assert out[m].frames_shown == len({r.frame_idx for r in own if r.state != "hidden"}) and out[m].frames_empty == 120 - out[m].frames_shown
    assert out["none"].warnings == "no_camera_motion" and out["m0"].warnings == ""


def test_empty_match(spark):
    players, motion, sizes = frames_of(spark, {"m": ([], [])})
    assert display.decisions(display.candidates(players, motion, sizes)).count() == 0
    r = display.manifest(display.decisions(display.candidates(players, motion, sizes)), players, motion, sizes).first()
    assert (r.frames, r.frames_empty, r.head, r.coverage, r.warnings, r.sound) == (120, 120, 120, 0.0, "no_camera_motion,partial_tracking", True)

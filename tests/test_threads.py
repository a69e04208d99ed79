"""Identity threads and review edits: brute force over made-up matches, and worked cases."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from pitchflow.operators import threads

PLAYER = "match_id string, frame_idx long, raw_track_id long, player_id string, team_id long, is_official boolean, identity_confidence double, x1 double, y1 double, x2 double, y2 double, assignment_source string"
MOTION = "match_id string, frame_idx long, dx double, dy double, motion_class string"


def offset(motion, frame):
    """Camera offset at a frame, sample by sample."""
    x, at = 0.0, []
    for i, (f, dx, kind) in enumerate(motion):
        x = 0.0 if kind == "cut" else x
        x += dx if i else 0.0
        at.append((f, x))
    if not at or frame <= at[0][0]:
        return at[0][1] if at else 0.0
    for (f, a), (g, b) in zip(at, at[1:], strict=False):
        if f <= frame < g:
            return a + (b - a) * (frame - f) / (g - f)
    return at[-1][1]


def plain(rows, motion):
    """rows: (frame, raw, player, team, confidence, x), y always 0: threads as lists of (raw, start, end), with each join's gap, way, confidence."""
    pieces = []
    for raw in sorted({r[1] for r in rows}):
        last = None
        for r in sorted(r for r in rows if r[1] == raw):
            x = r[5] - offset(motion, r[0])
            if last is None or r[0] - last[0] > 8 or abs(x - last[1]) > 180:
                pieces.append({"raw": raw, "rows": []})
            pieces[-1]["rows"].append((r[0], x, r[2], r[3], r[4]))
            last = (r[0], x)
    done = []
    for s in sorted(pieces, key=lambda s: (s["rows"][0][0], s["raw"])):
        teams = [t for *_, t, _ in s["rows"] if t is not None]
        s["team"] = Counter(teams).most_common(1)[0][0] if teams else None
        s["ids"] = {p for _, _, p, _, _ in s["rows"] if p}
        best = None
        for t in done:
            p = t[-1][0]
            gap = s["rows"][0][0] - p["rows"][-1][0]
            if not 0 < gap <= 45 or (p["team"] is not None and s["team"] is not None and p["team"] != s["team"]):
                continue
            a, b = p["rows"][max(0, len(p["rows"]) - 6)], p["rows"][-1]
            speed = (b[1] - a[1]) / max(1, b[0] - a[0])
            away = abs(b[1] + speed * gap - s["rows"][0][1])
            if away > 260:
                continue
            bonus = 0.14 * bool(p["ids"] & s["ids"]) + 0.18 * (p["raw"] == s["raw"])
            sure = max(0, min(1, 1 - away / 260 - gap / 112.5 + bonus + 0.08 * (p["team"] is not None and p["team"] == s["team"])))
            cost = away / 260 + gap / 45 * 0.4 - bonus
            if sure >= 0.42 and (best is None or cost < best[0] - 1e-12):
                best = (cost, t, gap, away, sure)
        if best:
            best[1].append((s, best[2], best[3], best[4]))
        else:
            done.append([(s, None, None, None)])
    return done


def match(rng, n_raw):
    rows = []
    for raw in range(n_raw):
        f, x = rng.randrange(0, 400), rng.uniform(0, 1500)
        team = rng.choice([0, 1, None])
        for _ in range(rng.randrange(1, 60)):
            rows.append((f, raw, rng.choice([f"P{raw % 9}"] * 30 + [None, "P77"]), team if rng.random() < 0.9 else 1, rng.choice([0.25, 0.5, None]), x))
            f += 1 if rng.random() < 0.97 else rng.randrange(2, 30)
            x += rng.uniform(-4, 6) if rng.random() < 0.99 else 400
    motion = [(f, float(rng.randrange(-3, 4)), "cut" if rng.random() < 0.05 else "pan") for f in range(10, 420, 7)]
    return rows, motion


def frames(spark, matches):
    players = [(m, f, raw, p, t, False, c, x - 5, -9.0, x + 5, 9.0, "locked") for m, (rows, _) in matches.items() for f, raw, p, t, c, x in rows]
    motion = [(m, f, dx, 0.0, kind) for m, (_, samples) in matches.items() for f, dx, kind in samples]
    return spark.createDataFrame(players, PLAYER), spark.createDataFrame(motion, MOTION)


def test_threads_against_brute_force(spark):
    rng = random.Random(1)
    matches = {"a": match(rng, 60), "b": match(rng, 25), "c": (match(rng, 9)[0], [])}
    found = threads.threads(threads.segments(*frames(spark, matches)))
    rows = found.collect()
    joins = 0
    for m, (own, motion) in matches.items():
        want = {}
        for k, t in enumerate(plain(own, motion), 1):
            for s, gap, away, sure in t:
                want[s["raw"], s["rows"][0][0], s["rows"][-1][0]] = (k, len(s["rows"]), s["team"], sorted(s["ids"]), gap, away, sure)
                joins += gap is not None
        got = {(r.raw_track_id, r.start_frame, r.end_frame): (r.thread, r.rows, r.team_id, r.players, r.gap, r.away, r.join_confidence) for r in rows if r.match_id == m}
        assert got.keys() == want.keys()
        for key, (*a, away, sure) in got.items():
            *b, away_b, sure_b = want[key]
            assert a == b
            assert (away is None) == (away_b is None) and (away is None or (math.isclose(away, away_b, abs_tol=6e-4) and math.isclose(sure, sure_b, abs_tol=6e-4)))
    assert joins > 10
    events = threads.thread_events(found).collect()
    assert sum(e.type == "gap_reconnect" for e in events) == joins and sum(e.type == "possible_switch" for e in events) == sum(len(r.players) > 1 for r in rows)
    assert all((e.status == "needs_review") == (e.confidence < 0.7 or e.gap > 14) for e in events if e.type == "gap_reconnect")
    summary = threads.thread_summary(found, threads.thread_events(found)).collect()
    assert sum(t.segments for t in summary) == len(rows) and sum(t.reviews for t in summary) == threads.review_sheet(threads.thread_events(found)).count()
    one = next(t for t in summary if t.match_id == "a" and t.thread_id == "CT01")
    own = [r for r in rows if r.match_id == "a" and r.thread == 1]
    marks = [e.confidence for e in events if e.match_id == "a" and e.thread_id == "CT01"]
    assert one.colour == "#e6194b" and math.isclose(one.confidence, min(1, (sum(r.confidence for r in own) + sum(marks)) / (len(own) + len(marks))), abs_tol=6e-4)


def test_worked_segments(spark):
    """A raw track of frames 0, 1 and another of 20, 21 of one player join, for review; a jump cuts a track."""
    rows = [(f, 1, "P1", 0, 0.9, x) for f, x in ((0, 90.0), (1, 95.0))] + [(f, 2, "P1", 0, 0.9, x) for f, x in ((20, 155.0), (21, 160.0))]
    found = threads.threads(threads.segments(*frames(spark, {"m": (rows, [])})))
    assert [(r.thread, r.raw_track_id, r.join_status) for r in found.orderBy("number").collect()] == [(1, 1, None), (1, 2, "needs_review")]
    jump = frames(spark, {"m": ([(0, 4, None, None, None, 0.0), (1, 4, None, None, None, 410.0)], [])})
    assert [(r.reason, r.confidence, r.team_id, r.players) for r in threads.segments(*jump).orderBy("start_frame").collect()] == [(None, 0.72, None, []), ("jump", 0.72, None, [])]
    assert threads.threads(threads.segments(*frames(spark, {"m": ([], [])}))).count() == 0


def test_many_segments_in_one_match(spark):
    """5,000 segments are one bounded group: only live threads are tried."""
    rows = [(40 * (k // 25) + j, k, None, k % 25 % 2, None, 50.0 * (k % 25)) for k in range(5000) for j in range(3)]
    found = threads.threads(threads.segments(*frames(spark, {"m": (rows, [])})))
    assert found.count() == 5000 and found.select("thread").distinct().count() == 25


LOG = "match_id string, edit long, action string, thread_id string, target_thread_id string, event_id string, segment_id string, frame string, label string, scope string, force string"


def test_edits_are_replayed_in_order(spark):
    """Merges refused for overlap unless forced, splits, edits of threads that earlier edits made or took away, refused edits with their reasons."""
    pieces = spark.createDataFrame([("m", t, n, raw, a, b) for t, n, raw, a, b in ((1, 1, 10, 0, 9), (1, 3, 11, 20, 29), (2, 2, 12, 12, 18), (3, 4, 13, 5, 25), (4, 5, 14, 40, 49))], "match_id string, thread long, number long, raw_track_id long, start_frame long, end_frame long")
    events = spark.createDataFrame([("m", 1, "CT01", "needs_review"), ("m", 2, "CT02", "needs_review"), ("m", 3, "CT03", "inferred")], "match_id string, event long, thread_id string, status string")
    edit = lambda k, action, a="", b="", event="", seg="", frame="", label="", scope="", force="": ("m", k, action, a, b, event, seg, frame, label, scope, force)
    log = spark.createDataFrame([
        edit(1, "merge_threads", "CT02", "CT01", "cte_00002"), edit(2, "merge_threads", "CT03", "CT01"), edit(3, "Split_Thread_After_Frame", "CT01", frame="14.0"), edit(4, "merge_threads", "CT02", "CT04"), edit(5, "merge_threads", "CT03", "CT01", force="YES"),
        edit(6, "split_thread_after_frame", "CT04", frame="99"), edit(7, "split_thread_after_frame", "CT04", frame="x"), edit(8, "merge_threads", "CT01"), edit(9, "merge_threads", "CT01", "CT01"), edit(10, "paint"), edit(11, "merge_threads", "CT09", "CT01"),
        edit(12, "mark_unknown", "CT01", event="cte_00001", frame="8"), edit(13, " "), edit(14, "assign_label", "", seg="seg_00005", label="Star", frame="45"), edit(15, "assign_label", "CT04", label="Late", frame="48", scope="after_frame"), edit(16, "assign_label", "CT04"),
    ], LOG)
    after, outcome = threads.review_edits(pieces, events, log)
    assert {r.edit: (r.applied, r.reason) for r in outcome.collect()} == {
        1: (True, "merged into CT01"), 2: (False, "overlap"), 3: (True, "split into CT02"), 4: (True, "merged into CT04"), 5: (True, "merged into CT01"), 6: (False, "separates_nothing"), 7: (False, "needs_frame"),
        8: (False, "needs_both_threads"), 9: (False, "same_thread"), 10: (False, "unsupported"), 11: (False, "not_found"), 12: (True, "queued"), 14: (True, "queued"), 15: (True, "queued"), 16: (True, "queued"),
    }
    got = sorted((r.thread_id, r.segment_id, r.raw_track_id, r.start_frame, r.end_frame, r.thread_status) for r in after.collect())
    assert got == [("CT01", "seg_00001", 10, 0, 9, "confirmed"), ("CT01", "seg_00002", 12, 12, 14, "confirmed"), ("CT01", "seg_00004", 13, 5, 25, "confirmed"), ("CT04", "seg_00002_split_15", 12, 15, 18, "confirmed"), ("CT04", "seg_00003", 11, 20, 29, "confirmed"), ("CT04", "seg_00005", 14, 40, 49, "confirmed")]
    players = spark.createDataFrame([("m", f, raw, "P", 0, False, 0.5, 0.0, 0.0, 1.0, 1.0, "locked") for f, raw in ((3, 10), (9, 10), (14, 12), (15, 12), (44, 14), (48, 14), (60, 14), (1, 99))], PLAYER)
    out = {(r.frame_idx, r.raw_track_id): (r.thread_id, r.player_id, r.assignment_source) for r in threads.annotated(players, after, log).collect()}
    assert out == {(3, 10): ("CT01", "P", "locked"), (9, 10): ("CT01", None, "thread_unknown"), (14, 12): ("CT01", None, "thread_unknown"), (15, 12): ("CT04", "P", "locked"), (44, 14): ("CT04", "Star", "thread_review"), (48, 14): ("CT04", "Late", "thread_review"), (60, 14): (None, "P", "locked"), (1, 99): (None, "P", "locked")}
    same, none = threads.review_edits(pieces, events, log.limit(0))
    assert none.count() == 0 and same.count() == 5 and {r.thread_status for r in same.where("thread_id IN ('CT01', 'CT02')").collect()} == {"needs_review"}
    assert threads.review_edits(pieces.limit(0), events.limit(0), log.limit(1))[1].collect()[0].reason == "not_found"
    assert threads.annotated(players, after, log.limit(0)).where(F.col("player_id") != "P").count() == 0

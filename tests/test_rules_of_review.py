"""Rules of a review log against a plain walk over rows and rules."""

import random

from pyspark.sql import functions as F

from pitchflow.operators import threads

PLAYERS = "match_id string, frame_idx long, raw_track_id long, player_id string, assignment_source string"
EDITED = "match_id string, thread_id string, segment_id string, raw_track_id long, start_frame long, end_frame long, thread_status string"
LOG = "match_id string, edit long, action string, thread_id string, segment_id string, frame string, label string, scope string"


def test_rules_against_a_walk(spark):
    rng = random.Random(3)
    edited = [("m", f"CT{rng.randint(1, 4):02d}", f"seg_{raw}_{k}", raw, 30 * k, 30 * k + 24, "confirmed") for raw in range(6) for k in range(4)]
    players = [("m", f, raw, "P1", "locked") for raw in range(7) for f in range(0, 125, 3)]
    log = [("m", e, rng.choice(["mark_unknown", "assign_label"]), rng.choice(["", "CT01", "CT02", "CT03", "CT09"]), rng.choice(["", "", f"seg_{rng.randrange(6)}_{rng.randrange(4)}"]),
            rng.choice([None, "20", "55.9", "x", "110"]), f"R{e}", rng.choice([None, "after_frame", "from_frame"])) for e in range(60)]

    def fits(rule, thread, segment, frame):
        _, _, action, t, p, since, _, scope = rule
        ranged = since is not None and (action == "mark_unknown" or scope)
        return t in ("", thread) and p in ("", segment) and (not ranged or (since != "x" and frame >= int(float(since))))

    want = {}
    for _, f, raw, who, source in players:
        seg = next((s for s in edited if s[3] == raw and s[4] <= f <= s[5]), None)
        rule = next((r for r in reversed(log) if seg and fits(r, seg[1], seg[2], f)), None)
        want[raw, f] = (seg and seg[2], who, source) if rule is None else (seg[2], rule[6], "thread_review") if rule[2] == "assign_label" else (seg[2], None, "thread_unknown")
    out = threads.annotated(spark.createDataFrame(players, PLAYERS), spark.createDataFrame(edited, EDITED), spark.createDataFrame(log, LOG))
    assert {(r.raw_track_id, r.frame_idx): (r.segment_id, r.player_id, r.assignment_source) for r in out.collect()} == want
    assert len(set(want.values())) > 20


def test_overruled_rules_go(spark):
    rules = spark.createDataFrame([([(1, 50), (2, None), (3, 9), (4, 30), (5, 20), (6, 20), (7, 90)],)], "r array<struct<edit:long,frame:long>>")
    assert [r.edit for r in rules.select(threads._standing(F.col("r"))).first()[0]] == [2, 3, 6, 7]

"""Identity threads: segments of raw tracks joined over gaps, the doubtful joins listed for review, and review edits replayed.

Segments, their features, events and sheets are DataFrame operations. Two rules are recursive in a match and take its segments (not its
frames) as a group, some thousands: the greedy choice of a thread, and the replay of an edit log.
"""

from __future__ import annotations

import colorsys
import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance
from .repair import spans
from .runs import with_run

RAW = ["match_id", "raw_track_id"]
#: Limits of segments and of joins, and the rewards of a join's confidence.
SEGMENT_GAP, SEGMENT_JUMP = 8, 180.0
JOIN_GAP, JOIN_DISTANCE, JOIN_CONFIDENCE = 45, 260.0, 0.42
SAME_PLAYER, SAME_RAW, SAME_TEAM = 0.14, 0.18, 0.08
SURE, LONG_GAP, SWITCH_CONFIDENCE, UNKNOWN_CONFIDENCE = 0.70, 14, 0.35, 0.72
#: The first colours of threads.
PALETTE = (
    "#e6194b #3cb44b #ffe119 #0082c8 #f58230 #911eb4 #46f0f0 #f032e6 #d2f53c #fabebe "
    "#008080 #e6beff #aa6e28 #fffac8 #800000 #aaffc3 #000080 #808000 #ffd7b4 #000000"
).split()


def colour(number: int) -> str:
    """Hex colour of the n-th thread, from 0: the palette's, then hues a golden angle apart."""
    if number < len(PALETTE):
        return PALETTE[number]
    rgb = colorsys.hsv_to_rgb(number * 137.508 % 360.0 / 360.0, 0.74, 0.92)
    return "#" + "".join(f"{int(c * 255):02x}" for c in rgb)


def camera_offsets(frames: DataFrame, motion: DataFrame) -> DataFrame:
    """(match_id, frame_idx, ox, oy): how far the camera has moved since the last cut, in a straight line between samples.

    The first sample of a match moves nothing; before it its own offset holds, after the last one that one's. Without samples offsets are zero.
    """
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    first = F.lag(F.lit(1)).over(w).isNull()
    cut = first | (F.coalesce("motion_class", F.lit("")) == "cut")
    rows = with_run(motion.select("match_id", "frame_idx", "dx", "dy", "motion_class").withColumn("_first", first), ["match_id"], "frame_idx", cut)
    so_far = Window.partitionBy("match_id", "run").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("match_id", "frame_idx", *(F.sum(F.when(F.col("_first"), 0.0).otherwise(F.coalesce(d, F.lit(0.0)))).over(so_far).alias(o) for d, o in (("dx", "ox"), ("dy", "oy"))))
    sample = F.struct(F.col("frame_idx").alias("f"), "ox", "oy", *(F.lead(c).over(w).alias(n) for c, n in (("frame_idx", "nf"), ("ox", "nx"), ("oy", "ny"))))
    rows = rows.select("match_id", "frame_idx", sample.alias("s"))
    start = rows.groupBy("match_id").agg(F.min_by("s", "frame_idx").alias("s0"))
    both = frames.select("match_id", "frame_idx").distinct().withColumn("s", F.lit(None).cast(rows.schema["s"].dataType)).withColumn("asks", F.lit(1))
    both = both.unionByName(rows.withColumn("asks", F.lit(0)))
    up_to = Window.partitionBy("match_id").orderBy("frame_idx", "asks").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("s", F.last("s", ignorenulls=True).over(up_to)).where("asks = 1").join(start, "match_id", "left")
    share = (F.col("frame_idx") - F.col("s.f")) / F.greatest(F.col("s.nf") - F.col("s.f"), F.lit(1))
    at = lambda o, n: F.coalesce(F.when(F.col("s.nf").isNull(), F.col(f"s.{o}")).otherwise(F.col(f"s.{o}") + (F.col(f"s.{n}") - F.col(f"s.{o}")) * share), F.col(f"s0.{o}"), F.lit(0.0))
    return met.select("match_id", "frame_idx", at("ox", "nx").alias("ox"), at("oy", "ny").alias("oy"))


def segments(players: DataFrame, motion: DataFrame) -> DataFrame:
    """I8's segments: a raw track cut at gaps over 8 frames and jumps over 180 px of its place without the camera's motion.

    One row each: number (in order of raw tracks), start_frame, end_frame, rows, reason of the cut (null for a track's first), first and last place,
    velocity over its last six rows, team (the most frequent, the earliest of such), players, mean confidence (0.72 if none is known).
    """
    rows = players.where("NOT coalesce(is_official, false) AND raw_track_id IS NOT NULL AND x1 IS NOT NULL").join(camera_offsets(players, motion), ["match_id", "frame_idx"])
    rows = rows.withColumns({"sx": (F.col("x1") + F.col("x2")) / 2 - F.col("ox"), "sy": (F.col("y1") + F.col("y2")) / 2 - F.col("oy")})
    w = Window.partitionBy(*RAW).orderBy("frame_idx")
    gap, jump = F.col("frame_idx") - F.lag("frame_idx").over(w), distance("sx", "sy", F.lag("sx").over(w), F.lag("sy").over(w))
    rows = rows.withColumn("_why", F.when(gap > SEGMENT_GAP, "gap").when(jump > SEGMENT_JUMP, "jump"))
    rows = with_run(rows, RAW, "frame_idx", gap.isNull() | F.col("_why").isNotNull())
    by = [*RAW, "run"]
    rows = rows.withColumn("_left", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("frame_idx"))))
    of_team = Window.partitionBy(*by, "team_id")
    team = F.struct((-F.count("*").over(of_team)).alias("n"), F.min("frame_idx").over(of_team).alias("f"), "team_id")
    rows = rows.withColumn("_team", F.when(F.col("team_id").isNotNull(), team))
    sixth = lambda c: F.max_by(c, F.when(F.col("_left") <= 6, F.col("_left")))
    last = lambda c: F.min_by(c, "_left")
    out = rows.groupBy(*by).agg(
        F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.count("*").alias("rows"), F.max_by("_why", "_left").alias("reason"),
        *(F.max_by(c, "_left").alias(f"first_{c}") for c in ("sx", "sy")), *(last(c).alias(f"last_{c}") for c in ("sx", "sy")), *(sixth(c).alias(f"from_{c}") for c in ("frame_idx", "sx", "sy")),
        F.array_sort(F.collect_set("player_id")).alias("players"), F.avg("identity_confidence").alias("mean"), F.min("_team")["team_id"].alias("team_id"))
    wait = F.greatest(F.col("end_frame") - F.col("from_frame_idx"), F.lit(1))
    out = out.withColumns({"vx": (F.col("last_sx") - F.col("from_sx")) / wait, "vy": (F.col("last_sy") - F.col("from_sy")) / wait})
    out = out.withColumn("confidence", F.when(F.col("mean").isNull(), UNKNOWN_CONFIDENCE).otherwise(F.least(F.greatest("mean", F.lit(0.0)), F.lit(1.0))))
    number = F.row_number().over(Window.partitionBy("match_id").orderBy("raw_track_id", "start_frame"))
    return out.withColumn("number", number.cast("long")).drop("run", "mean", "from_frame_idx", "from_sx", "from_sy")


@dataclass
class _Thread:
    number: int
    last: object  # its last segment


def joined(pieces: pd.DataFrame) -> list[tuple]:
    """(number, thread, gap, metres, confidence) of one match's segments, in order of their starts.

    A segment joins the live thread of least cost of those whose end, moved on by its velocity, comes near enough with enough confidence; else it starts one.
    """
    live: list[_Thread] = []
    out, threads = [], 0
    for s in pieces.sort_values(["start_frame", "raw_track_id", "number"]).itertuples():
        live = [t for t in live if s.start_frame - t.last.end_frame <= JOIN_GAP]  # starts only grow
        best = None
        for t in live:
            p, gap = t.last, s.start_frame - t.last.end_frame
            known = not (pd.isna(p.team_id) or pd.isna(s.team_id))
            if gap <= 0 or (known and p.team_id != s.team_id):
                continue
            away = math.hypot(p.last_sx + p.vx * gap - s.first_sx, p.last_sy + p.vy * gap - s.first_sy)
            if away > JOIN_DISTANCE:
                continue
            reward = (SAME_PLAYER if set(p.players) & set(s.players) else 0.0) + (SAME_RAW if p.raw_track_id == s.raw_track_id else 0.0)
            sure = min(max(1 - away / JOIN_DISTANCE - gap / (2.5 * JOIN_GAP) + reward + (SAME_TEAM if known else 0.0), 0.0), 1.0)
            cost = away / JOIN_DISTANCE + 0.4 * gap / JOIN_GAP - reward
            if sure >= JOIN_CONFIDENCE and (best is None or (cost, t.number) < best[:2]):
                best = (cost, t.number, t, gap, away, sure)
        if best:
            best[2].last = s
            out.append((s.number, best[1], int(best[3]), round(best[4], 3), round(best[5], 3)))
        else:
            threads += 1
            live.append(_Thread(threads, s))
            out.append((s.number, threads, None, None, None))
    return out


def threads(pieces: DataFrame) -> DataFrame:
    """I8: segments with thread and, where they join one, gap, metres, join_confidence and join_status (needs_review or inferred)."""
    names = ["match_id", "number", "thread", "gap", "away", "join_confidence"]

    def code(p: pd.DataFrame) -> pd.DataFrame:
        rows = pd.DataFrame([(p.match_id.iloc[0], *r) for r in joined(p)], columns=names)
        return rows.astype({"gap": "Int64", "away": "Float64", "join_confidence": "Float64"})

    needed = ["match_id", "number", "raw_track_id", "start_frame", "end_frame", "first_sx", "first_sy", "last_sx", "last_sy", "vx", "vy", "team_id", "players"]
    made = pieces.select(*needed).groupBy("match_id").applyInPandas(code, "match_id string, number long, thread long, gap long, away double, join_confidence double")
    doubt = (F.col("join_confidence") < SURE) | (F.col("gap") > LONG_GAP)
    return pieces.join(made, ["match_id", "number"]).withColumn("join_status", F.when(doubt, "needs_review").when(F.col("gap").isNotNull(), "inferred"))


def thread_id(number: Column) -> Column:
    return F.concat(F.lit("CT"), F.when(number < 10, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string")))


def segment_id(number: Column) -> Column:
    return F.concat(F.lit("seg_"), F.when(number < 100_000, F.lpad(number.cast("string"), 5, "0")).otherwise(number.cast("string")))


def thread_events(found: DataFrame) -> DataFrame:
    """I8's events of a match in order: a join over a gap, and a segment with several players (possible_switch, for review)."""
    join = F.when(F.col("gap").isNotNull(), F.struct(F.lit(0).alias("k"), F.lit("gap_reconnect").alias("type"), F.col("join_status").alias("status"), F.col("join_confidence").alias("confidence")))
    switch = F.when(F.size("players") > 1, F.struct(F.lit(1).alias("k"), F.lit("possible_switch").alias("type"), F.lit("needs_review").alias("status"), F.lit(SWITCH_CONFIDENCE).alias("confidence")))
    rows = found.select("match_id", "thread", "number", "raw_track_id", F.col("start_frame").alias("frame_idx"), "gap", "away", "players", F.explode(F.array_compact(F.array(join, switch))).alias("e"))
    place = F.row_number().over(Window.partitionBy("match_id").orderBy("frame_idx", "raw_track_id", "number", "e.k"))
    return rows.select("match_id", place.cast("long").alias("event"), thread_id(F.col("thread")).alias("thread_id"), segment_id(F.col("number")).alias("segment_id"), "frame_idx", "e.type", "e.status", "e.confidence", "gap", "away", "players")


def thread_summary(found: DataFrame, events: DataFrame) -> DataFrame:
    """I8's threads: raw tracks, frames, confidence (mean over segments and events) and whether an event waits for review."""
    by = ["match_id", "thread_id"]
    own = found.withColumn("thread_id", thread_id(F.col("thread")))
    part = own.groupBy(*by).agg(
        F.first("thread").alias("thread"), F.count("*").alias("segments"), F.array_sort(F.collect_set("raw_track_id")).alias("raw_track_ids"), F.min("start_frame").alias("start_frame"),
        F.max("end_frame").alias("end_frame"), F.sum("confidence").alias("_c"))
    marks = events.groupBy(*by).agg(F.count("*").alias("events"), F.count_if(F.col("status") == "needs_review").alias("reviews"), F.sum("confidence").alias("_e"))
    zero = F.lit(0)
    out = part.join(marks, by, "left").withColumns({"events": F.coalesce("events", zero), "reviews": F.coalesce("reviews", zero)})
    mean = (F.col("_c") + F.coalesce("_e", F.lit(0.0))) / (F.col("segments") + F.col("events"))
    out = out.withColumn("confidence", F.round(F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)), 3)).withColumn("status", F.when(F.col("reviews") > 0, "needs_review").otherwise("confirmed"))
    hexes = F.udf(lambda n: colour(n - 1), "string")  # a row for each thread
    return out.withColumn("colour", hexes("thread")).drop("_c", "_e", "thread")


def review_sheet(events: DataFrame) -> DataFrame:
    """I8's sheet of events for review, with empty columns for the reviewer's action, target, label and notes."""
    blank = [F.lit("").alias(c) for c in ("action", "target_thread_id", "label", "notes")]
    reason = F.when(F.col("type") == "gap_reconnect", F.format_string("raw tracklet reconnected after %d frames at %s px", "gap", F.col("away").cast("string"))).otherwise("raw tracklet contains several player labels")
    return events.where("status = 'needs_review'").select("match_id", F.format_string("cte_%05d", "event").alias("event_id"), "thread_id", "segment_id", "frame_idx", "status", reason.alias("reason"), *blank)


# ---------------------------------------------------------------- I9


@dataclass
class _Edited:
    segments: list = field(default_factory=list)  # [segment_id, raw_track_id, start, end]
    events: dict = field(default_factory=dict)  # event_id -> status


def _overlap(a: list, b: list) -> bool:
    """Whether a segment of one list shares a frame with one of the other: one sweep over both."""
    rows = sorted([(s[2], s[3], 0) for s in a] + [(s[2], s[3], 1) for s in b])
    ends = [-math.inf, -math.inf]
    for start, end, side in rows:
        if start <= ends[1 - side]:
            return True
        ends[side] = max(ends[side], end)
    return False


def _text(value) -> str:
    return "" if value is None or (not isinstance(value, str) and pd.isna(value)) else str(value).strip()


def _frame(value) -> int | None:
    try:
        return int(float(value))
    except (TypeError, ValueError, OverflowError):
        return None


def replayed(held: dict[str, _Edited], log) -> list[tuple[int, str, bool, str]]:
    """I9 for one match: edits in order, each applied to what those before it left, or refused with a reason: (edit, action, applied, reason)."""
    out, marked = [], {e for t in held.values() for e in t.events}
    for row in log:
        action, source, target = _text(row.action).lower(), _text(row.thread_id), _text(row.target_thread_id)
        ok, why = False, "unsupported"
        if action == "merge_threads":
            force = _text(row.force).lower() in ("1", "true", "yes", "y")
            if not source or not target:
                why = "needs_both_threads"
            elif source == target:
                why = "same_thread"
            elif source not in held or target not in held:
                why = "not_found"
            elif not force and _overlap(held[source].segments, held[target].segments):
                why = "overlap"
            else:
                gone = held.pop(source)
                held[target].segments += gone.segments
                held[target].events |= gone.events
                ok, why = True, f"merged into {target}"
        elif action == "split_thread_after_frame":
            frame = _frame(row.frame)
            if frame is None:
                why = "needs_frame"
            elif source not in held:
                why = "not_found"
            else:
                stay = [s if s[3] <= frame else [*s[:3], frame] for s in held[source].segments if s[2] <= frame]
                go = [s if s[2] > frame else [f"{s[0]}_split_{frame + 1}", s[1], frame + 1, s[3]] for s in held[source].segments if s[3] > frame]
                if not stay or not go:
                    why = "separates_nothing"
                else:
                    k = next(k for k in range(1, len(held) + 2) if f"CT{k:02d}" not in held)
                    held[source].segments, held[f"CT{k:02d}"] = stay, _Edited(go)
                    ok, why = True, f"split into CT{k:02d}"
        elif action in ("mark_unknown", "assign_label"):
            ok, why = True, "queued"
        event = _text(row.event_id)
        if ok and event in marked:
            for t in held.values():
                if event in t.events:
                    t.events[event] = "reviewed"
        out.append((row.edit, action, ok, why))
    return out


def review_edits(found: DataFrame, events: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments after the edits with thread_id and thread_status, outcome of each edit).

    log: match_id, edit (the order), action, thread_id, target_thread_id, event_id, segment_id, frame, label, scope, force; rows without action are passed
    over. Edits depend on those before them, so a match's segments, events and edits are one group.
    """
    kind = "match_id string, edit long, action string, applied boolean, reason string, thread_id string, segment_id string, raw_track_id long, start_frame long, end_frame long, thread_status string"
    names = [c.split()[0] for c in kind.split(", ")]
    null = lambda t: F.lit(None).cast(t)
    pieces = found.select("match_id", thread_id(F.col("thread")).alias("thread_id"), segment_id(F.col("number")).alias("segment_id"), "raw_track_id", "start_frame", "end_frame", null("string").alias("event_id"), null("string").alias("status"))
    marks = events.select("match_id", "thread_id", null("string").alias("segment_id"), null("long").alias("raw_track_id"), null("long").alias("start_frame"), null("long").alias("end_frame"), F.format_string("cte_%05d", "event").alias("event_id"), "status")

    def code(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, _Edited] = {}
        for r in left.sort_values(["start_frame", "segment_id"]).itertuples():
            own = held.setdefault(r.thread_id, _Edited())
            if isinstance(r.event_id, str):
                own.events[r.event_id] = r.status
            else:
                own.segments.append([r.segment_id, int(r.raw_track_id), int(r.start_frame), int(r.end_frame)])
        match = (left if len(left) else right).match_id.iloc[0] if len(left) + len(right) else None
        rows = [(match, *r, None, None, None, None, None, None) for r in replayed(held, right.sort_values("edit").itertuples())]
        for name, t in held.items():
            status = "needs_review" if "needs_review" in t.events.values() else "confirmed"
            rows += [(match, None, None, None, None, name, *s, status) for s in t.segments]
        return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("edit", "raw_track_id", "start_frame", "end_frame")})

    asked = log.where(F.trim(F.coalesce("action", F.lit(""))) != "").select(*(F.col(c).alias(c) for c in log.columns))  # names of its own, as it may come from the threads
    both = pieces.unionByName(marks).groupBy("match_id").cogroup(asked.groupBy("match_id")).applyInPandas(code, kind)
    return both.where("edit IS NULL").select("match_id", "thread_id", "segment_id", "raw_track_id", "start_frame", "end_frame", "thread_status"), both.where("edit IS NOT NULL").select("match_id", "edit", "action", "applied", "reason")


def _standing(rules: Column) -> Column:
    """Without the rules that a later one with the same frame, an earlier one or none always overrules; the frames of what is left rise."""
    start = F.struct(F.slice(rules, 1, 0).alias("kept"), F.lit(None).cast("long").alias("least"))

    def step(acc: Column, r: Column) -> Column:
        at = F.coalesce(r["frame"], F.lit(-(1 << 63)))
        stands = acc["least"].isNull() | (at < acc["least"])
        return F.struct(F.when(stands, F.concat(F.array(r), acc["kept"])).otherwise(acc["kept"]).alias("kept"), F.when(stands, at).otherwise(acc["least"]).alias("least"))

    return F.aggregate(F.reverse(rules), start, step)["kept"]


def annotated(players: DataFrame, edited: DataFrame, log: DataFrame) -> DataFrame:
    """Players with the thread of their segment (J10), and with the last rule that fits: mark_unknown takes the id away, assign_label sets it.

    A rule fits its thread and segment where they are named; from its frame on, where it has one (assign_label: only with the scope after_frame or from_frame).
    Rules meet the segments they fit by those names, so a row is asked about the few that stand for its own segment.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    action = F.lower(text("action"))
    ranged = (action == "mark_unknown") | F.lower(text("scope")).isin("after_frame", "from_frame")
    frame = F.when(ranged & (text("frame") != ""), F.coalesce(F.expr("try_cast(try_cast(frame AS double) AS bigint)"), F.lit((1 << 63) - 1)))  # what is no frame fits none
    names = [text("thread_id").alias("thread_id"), text("segment_id").alias("segment_id")]
    rules = log.select("match_id", *(n.alias(k) for n, k in zip(names, ("_t", "_p"), strict=True)), F.struct("edit", action.alias("action"), *names, frame.alias("frame"), text("label").alias("label")).alias("r"))
    rules = rules.where("r.action = 'mark_unknown' OR (r.action = 'assign_label' AND r.label <> '')")
    any_of = F.lit("")
    named = [F.struct(F.coalesce(t, any_of).alias("_t"), F.coalesce(p, any_of).alias("_p")) for t in (F.col("thread_id"), any_of) for p in (F.col("segment_id"), any_of)]
    asked = edited.select("*", F.explode(F.array_distinct(F.array(*named))).alias("_k")).select(*edited.columns, "_k.*")
    fit = asked.join(rules, ["match_id", "_t", "_p"], "left").groupBy(*edited.columns).agg(_standing(F.array_sort(F.collect_list("r"))).alias("rules"))
    hit = spans(players, fit, ["thread_id", "segment_id", "thread_status", "rules"])
    since = lambda r: r["frame"].isNull() | (F.col("frame_idx") >= r["frame"])
    out = hit.withColumn("_r", F.when(F.col("thread_id").isNotNull(), F.try_element_at(F.filter("rules", since), F.lit(-1))))
    unknown, labelled = F.col("_r.action") == "mark_unknown", F.col("_r.action") == "assign_label"
    changed = {"player_id": F.when(labelled, F.col("_r.label")).when(unknown, F.lit(None)).otherwise(F.col("player_id")),
               "assignment_source": F.when(labelled, "thread_review").when(unknown, "thread_unknown").otherwise(F.col("assignment_source"))}
    return out.withColumns(changed).drop("_r", "rules")

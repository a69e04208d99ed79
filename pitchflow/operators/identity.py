"""Identity audit: conflicts, proposals, fragments, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, iou
from .joins import FRAME, frame_pairs, fragments_to_merge
from .runs import with_run

#: Conflict types and their severity.
SEVERITY = {"team_flip": "critical", "keeper_to_outfield": "high", "duplicate_id": "critical", "overlap": "medium", "jump": "high", "speed": "medium", "source_downgrade": "low", "teleport": "high", "relock": "low"}


def player_changes(players: DataFrame, motion: DataFrame) -> DataFrame:
    """Each row of a known player with the row before: kinds of changes as an array.

    Distances are between box centres, the one before moved by the camera's dx, dy at this frame.
    """
    known = players.where("player_id IS NOT NULL AND NOT is_official").withColumn("cx", (F.col("x1") + F.col("x2")) / 2).withColumn("cy", (F.col("y1") + F.col("y2")) / 2)
    known = known.join(motion.select(*FRAME, "dx", "dy"), FRAME, "left")
    w = Window.partitionBy("match_id", "player_id").orderBy("frame_idx", "raw_track_id")
    lag = lambda c: F.lag(c).over(w)
    rows = known.withColumns({"p_frame": lag("frame_idx"), "p_raw": lag("raw_track_id"), "p_team": lag("team_id"), "p_role": lag("role"), "p_source": lag("assignment_source"), "px": lag("cx"), "py": lag("cy"), "boxes": F.count("*").over(Window.partitionBy(*FRAME, "player_id"))})
    rows = rows.where("p_frame < frame_idx").withColumn("dt", F.col("frame_idx") - F.col("p_frame"))
    rows = rows.withColumn("moved", distance("cx", "cy", F.col("px") + F.coalesce("dx", F.lit(0.0)), F.col("py") + F.coalesce("dy", F.lit(0.0))))
    rank = lambda c: F.when(F.col(c) == "locked", 3).when(F.col(c) == "revived", 2).when(F.col(c) == "provisional", 1).otherwise(0)
    kinds = F.array_compact(F.array(
        F.when(F.col("team_id") != F.col("p_team"), "team_flip"), F.when((F.col("p_role") == "goalkeeper") & (F.col("role") != "goalkeeper"), "keeper_to_outfield"),
        F.when(F.col("moved") > 150, "jump"), F.when(F.col("moved") / F.col("dt") > 60, "speed"), F.when((rank("p_source") == 3) & (rank("assignment_source") == 0), "source_downgrade"),
        F.when((F.col("raw_track_id") != F.col("p_raw")) & (F.col("moved") > 75), "teleport"),
        F.when((F.col("p_source") == "revived") & (F.col("assignment_source") == "locked") & (F.col("dt") <= 10), "relock"),
    ))
    return rows.withColumn("kinds", kinds)


def conflicts(players: DataFrame, motion: DataFrame) -> DataFrame:
    """Duplicate ids and overlapping boxes of a frame, and changes between frames, one row each with severity."""
    known = players.where("player_id IS NOT NULL AND NOT is_official")
    dup = known.groupBy(*FRAME, "player_id").agg(F.count("*").alias("n")).where("n > 1").select(*FRAME, "player_id", F.lit("duplicate_id").alias("conflict"))
    over = frame_pairs(known).where(iou("a_", "b_") > 0.30).select(*FRAME, F.col("a_player_id").alias("player_id"), F.lit("overlap").alias("conflict"))
    moved = player_changes(players, motion).select(*FRAME, "player_id", F.explode("kinds").alias("conflict"))
    out = dup.unionByName(over).unionByName(moved)
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return out.withColumn("severity", severity[F.col("conflict")])


def conflict_counts(found: DataFrame) -> DataFrame:
    """A34."""
    return found.groupBy("match_id", "conflict", "severity").agg(F.count("*").alias("n"), F.count_distinct("player_id").alias("players"))


#: The confidence of each kind of correction.
CORRECTIONS = {"swap": 0.80, "mark_unknown": 0.95, "suppress": 0.90, "reject_revival": 0.85}


def proposals(found: DataFrame, window: int = 25) -> DataFrame:
    """The corrections that a window of frames calls for, on its first players in order of their ids.

    A team flip of two players swaps them from the window's start, a keeper that turns outfield is unknown from its end,
    a duplicate id is suppressed within it, a teleport's revival is rejected from its end.
    """
    w = found.groupBy("match_id", F.floor(F.col("frame_idx") / window).alias("win")).agg(
        F.collect_set("conflict").alias("kinds"), F.array_sort(F.collect_set("player_id")).alias("pids"), F.min("frame_idx").alias("start"), F.max("frame_idx").alias("end")
    )
    has = lambda k: F.array_contains("kinds", k)
    none = F.lit(None)

    def row(action: str, why: str, start, end=none, other=none):
        return F.struct(F.lit(action).alias("action"), F.col("pids")[0].alias("pid_a"), other.cast("string").alias("pid_b"), start.alias("apply_from"), end.cast("long").alias("apply_to"), F.lit(CORRECTIONS[action]).alias("confidence"), F.lit(why).alias("reason"))

    start, end = F.col("start"), F.col("end")
    rows = F.array_compact(F.array(
        F.when(has("team_flip") & (F.size("pids") >= 2), row("swap", "team_flip", start, other=F.get("pids", F.lit(1)))), F.when(has("keeper_to_outfield"), row("mark_unknown", "keeper_to_outfield", end)),
        F.when(has("duplicate_id"), row("suppress", "duplicate_id", start, end)), F.when(has("teleport"), row("reject_revival", "teleport", end)),
    ))
    return w.select("match_id", "win", F.explode(rows).alias("r")).select("match_id", "win", "r.*")


def fragments(players: DataFrame, gap: int = 5) -> DataFrame:
    """Tracklets of a raw track, cut at gaps over ``gap`` frames, with first and last place and modes."""
    w = Window.partitionBy("match_id", "raw_track_id").orderBy("frame_idx")
    rows = with_run(players.where("NOT is_official"), ["match_id", "raw_track_id"], "frame_idx", F.lag("frame_idx").over(w).isNull() | (F.col("frame_idx") - F.lag("frame_idx").over(w) > gap))
    n = rows.groupBy("match_id", "raw_track_id", "run", "team_id").agg(F.count("*").alias("n"))
    mode = n.groupBy("match_id", "raw_track_id", "run").agg(F.max(F.struct("n", (-F.col("team_id")).alias("t"))).alias("m")).select("match_id", "raw_track_id", "run", (-F.col("m.t")).alias("team_id"))
    base = rows.groupBy("match_id", "raw_track_id", "run").agg(
        F.min("frame_idx").alias("first_seen"), F.max("frame_idx").alias("last_seen"), F.count("*").alias("rows"), F.min("identity_confidence").alias("least"), F.max("identity_confidence").alias("most"), F.avg("identity_confidence").alias("mean"),
        F.min_by("x", "frame_idx").alias("x0"), F.min_by("y", "frame_idx").alias("y0"), F.max_by("x", "frame_idx").alias("x1"), F.max_by("y", "frame_idx").alias("y1"),
    )
    return base.join(mode, ["match_id", "raw_track_id", "run"]).withColumn("track_id", F.col("raw_track_id") * 10_000 + F.col("run")).drop("run")


def merge_candidates(pieces: DataFrame, max_gap: int = 120, metres_per_frame: float = 0.5) -> DataFrame:
    """Pairs of fragments of one team where the second can be reached from the end of the first."""
    pairs = fragments_to_merge(pieces.select("match_id", "track_id", "first_seen", "last_seen"), max_gap)
    a = pieces.select("match_id", F.col("track_id").alias("a"), F.col("team_id").alias("ta"), F.col("x1").alias("ax"), F.col("y1").alias("ay"))
    b = pieces.select("match_id", F.col("track_id").alias("b"), F.col("team_id").alias("tb"), F.col("x0").alias("bx"), F.col("y0").alias("by"))
    met = pairs.join(a, ["match_id", "a"]).join(b, ["match_id", "b"]).withColumn("metres", distance("ax", "ay", "bx", "by"))
    return met.where((F.col("ta") == F.col("tb")) & (F.col("metres") <= metres_per_frame * F.greatest(F.col("gap"), F.lit(1)))).select("match_id", "a", "b", "gap", "metres")


def cosine(a: str, b: str) -> Column:
    """Cosine of two vectors; shorter ones count as filled with zeros, a zero vector is like none."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: F.coalesce(u, F.lit(0.0)) * F.coalesce(v, F.lit(0.0))), F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-8)


def alike(pieces: DataFrame, max_gap: int = 120, least: float = 0.65, pixels_per_frame: float = 80.0) -> DataFrame:
    """I4: (match_id, a, b, gap, similarity) of pieces where b starts at most ``max_gap`` frames after a's end, looks alike and can be reached.

    pieces: match_id, track_id, first_seen, last_seen, fx, fy, lx, ly (first and last centres in px), embedding (null: like none). Pairs meet by blocks of
    frames, so a piece meets those that start within reach of its end; vectors are compared there alone.
    """
    met = fragments_to_merge(pieces.where("embedding IS NOT NULL").select("match_id", "track_id", "first_seen", "last_seen"), max_gap)
    a = pieces.select("match_id", F.col("track_id").alias("a"), F.col("lx").alias("ax"), F.col("ly").alias("ay"), F.col("embedding").alias("ea"))
    b = pieces.select("match_id", F.col("track_id").alias("b"), F.col("fx").alias("bx"), F.col("fy").alias("by"), F.col("embedding").alias("eb"))
    rows = met.join(a, ["match_id", "a"]).join(b, ["match_id", "b"])
    near = (F.col("gap") <= 0) | (distance("ax", "ay", "bx", "by") / F.col("gap") <= pixels_per_frame)
    return rows.where(near).withColumn("similarity", cosine("ea", "eb")).where(F.col("similarity") >= least).select("match_id", "a", "b", "gap", "similarity")


def global_ids(spark: SparkSession, pieces: DataFrame, **limits) -> DataFrame:
    """I4: each piece's global id in its match: links followed, components numbered from 1 by their least piece."""
    from .components import components

    roots = components(spark, alike(pieces, **limits)).withColumnRenamed("node", "track_id")
    out = pieces.select("match_id", "track_id").join(roots, ["match_id", "track_id"], "left").withColumn("root", F.coalesce("root", "track_id"))
    return out.withColumn("global_id", F.dense_rank().over(Window.partitionBy("match_id").orderBy("root")).cast("long")).select("match_id", "track_id", "root", "global_id")


def physical_gate(rows: DataFrame) -> DataFrame:
    """The first failing code of official, team flip, speed (650 px/s), jump scaled by the gap, double occupancy; null if none."""
    gap = F.col("dt")
    limit = 300 + 15 * F.least(gap - 1, F.lit(10))
    code = (
        F.when(F.col("is_official"), "official").when(F.col("team_id") != F.col("p_team"), "team_flip").when(F.col("moved") / (gap / 25.0) > 650, "speed")
        .when(F.col("moved") > limit, "jump").when(F.col("boxes") > 1, "double_occupancy")
    )
    return rows.withColumn("gate", code)


def referee_score(detected, shirt=None, black=None, excluded=None, touchline=None):
    """How much a frame speaks for an official: a detector's word, a shirt's confidence (0 to 1), black, no team's colours, and place beside the pitch."""
    part = lambda c, w: F.when(c, w).otherwise(0.0) if c is not None else F.lit(0.0)
    bright = F.coalesce(shirt, F.lit(0.0)) if shirt is not None else F.lit(0.0)
    beside = (touchline & (detected | (bright > 0))) if touchline is not None else None
    return part(detected, 0.40) + 0.30 * bright + part(black, 0.15) + part(excluded, 0.20) + part(beside, 0.10)


def referee_votes(rows: DataFrame, enough: int = 4, vote: float = 0.35) -> DataFrame:
    """Running share of frames of a raw track that score 0.35 or more; the first decision from ``enough`` frames on sticks, else it is suspected from one vote on."""
    w = Window.partitionBy("match_id", "raw_track_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.count("*").over(w)).withColumn("yes", F.sum((F.col("score") >= vote).cast("long")).over(w))
    ratio = F.col("yes") / F.col("n")
    rows = rows.withColumn("_said", F.when(F.col("n") < enough, None).when(ratio >= 0.75, "official").when(ratio < 0.30, "player"))
    first = F.min_by("_said", F.when(F.col("_said").isNotNull(), F.col("frame_idx")))
    return rows.groupBy("match_id", "raw_track_id").agg(F.coalesce(first, F.when(F.max("yes") > 0, "suspected").otherwise("player")).alias("decision"), F.max("n").alias("votes"))


def jump_split(points: DataFrame, gap: int = 8, jump: float = 5.0) -> DataFrame:
    """Segments of a track, cut at a gap over 8 frames or a jump, with the cut's reason."""
    w = Window.partitionBy("match_id", "track_id").orderBy("frame_idx")
    df = F.col("frame_idx") - F.lag("frame_idx").over(w)
    step = distance("x", "y", F.lag("x").over(w), F.lag("y").over(w))
    rows = points.withColumn("_why", F.when(df.isNull(), "start").when(df > gap, "gap").when(step > jump, "jump"))
    rows = with_run(rows, ["match_id", "track_id"], "frame_idx", F.col("_why").isNotNull(), "segment")
    return rows.groupBy("match_id", "track_id", "segment").agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.count("*").alias("rows"), F.min_by("_why", "frame_idx").alias("reason"))


def display_coverage(points: DataFrame, matches: DataFrame, lerp: int = 8, hold: int = 15) -> DataFrame:
    """Per match the frames of each track that are visible, interpolated (gap up to 8), held (up to 15) or hidden."""
    from .physical import TRACK

    grid = points.select(*TRACK).distinct().join(matches.select("match_id", "frames_processed"), "match_id").select(*TRACK, F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames_processed") - 1)).alias("frame_idx"))
    rows = grid.join(points.select(*TRACK, "frame_idx", F.lit(1).alias("seen")), [*TRACK, "frame_idx"], "left")
    w = Window.partitionBy(*TRACK).orderBy("frame_idx")
    own = F.when(F.col("seen") == 1, F.col("frame_idx"))
    rows = rows.withColumn("_a", F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy(*TRACK).orderBy(F.desc("frame_idx"))  # from the end: a frame that grows costs less than one that shrinks
    rows = rows.withColumn("_b", F.last(own, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    state = F.when(F.col("seen") == 1, "visible").when(F.col("_b") - F.col("_a") <= lerp, "interpolated").when(F.col("frame_idx") - F.col("_a") <= hold, "held").otherwise("hidden")
    return rows.groupBy("match_id").agg(*(F.count_if(state == s).alias(s) for s in ("visible", "interpolated", "held", "hidden")))

"""What an overlay shows of each known player in each frame, and why it hides the rest; counts and warnings of a run.

All of it is windows by (match, player) over a grid of frames, dealt out once; what a frame knows for all players is brought along with the grid. What
was shown last is the only rule with memory: it runs between two seen boxes, so it is a fold over the few frames there, not over the match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance
from .joins import FRAME
from .runs import with_run

PLAYER = ["match_id", "player_id"]
#: Frames that may be filled in or held, a jump in px, the least area of a box, and the fading of held boxes.
FILL, HOLD, JUMP, AREA, FADE, FAINTEST, FILLED = 8, 15, 140.0, 80.0, 0.2, 0.2, 0.95
SHOWN_SOURCES = ("locked", "revived")


def timeline(matches: DataFrame, motion: DataFrame) -> DataFrame:
    """(match_id, frame_idx, ox, oy, motion_class, cuts) of every frame: the camera's way since the last cut, the class of the sample before, cuts so far.

    Between samples the way is a straight line, but it stays where it is before a cut; before the first sample it is zero and the class stable.
    """
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    still = F.lag(F.lit(1)).over(w).isNull() | (F.col("motion_class") == "cut")
    rows = with_run(motion.select(*FRAME, "dx", "dy", "motion_class").withColumn("_still", still), ["match_id"], "frame_idx", F.col("_still"))
    so_far = Window.partitionBy("match_id", "run").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    way = [F.sum(F.when(F.col("_still"), 0.0).otherwise(F.coalesce(d, F.lit(0.0)))).over(so_far).alias(o) for d, o in (("dx", "ox"), ("dy", "oy"))]
    cuts = F.sum((F.col("motion_class") == "cut").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cuts")
    rows = rows.select(*FRAME, "motion_class", *way, cuts)
    ahead = [F.lead(c).over(w).alias(f"n_{c}") for c in ("frame_idx", "ox", "oy", "motion_class")]
    samples = rows.select(*FRAME, F.struct("frame_idx", "ox", "oy", "motion_class", "cuts", *ahead).alias("s"))
    frames = matches.where("frames_processed > 0").select("match_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames_processed") - 1)).alias("frame_idx"))
    both = frames.select(*FRAME, F.lit(None).cast(samples.schema["s"].dataType).alias("s"), F.lit(1).alias("asks")).unionByName(samples.withColumn("asks", F.lit(0)))
    met = both.withColumn("s", F.last("s", ignorenulls=True).over(Window.partitionBy("match_id").orderBy("frame_idx", "asks").rowsBetween(Window.unboundedPreceding, 0))).where("asks = 1")
    share = (F.col("frame_idx") - F.col("s.frame_idx")) / (F.col("s.n_frame_idx") - F.col("s.frame_idx"))
    stays = F.col("s.n_frame_idx").isNull() | (F.col("s.n_motion_class") == "cut")
    at = lambda o: F.coalesce(F.when(stays, F.col(f"s.{o}")).otherwise(F.col(f"s.{o}") + (F.col(f"s.n_{o}") - F.col(f"s.{o}")) * share), F.lit(0.0)).alias(o)
    return met.select(*FRAME, at("ox"), at("oy"), F.coalesce("s.motion_class", F.lit("stable")).alias("motion_class"), F.coalesce("s.cuts", F.lit(0).cast("long")).alias("cuts"))


def shown(source: Column) -> Column:
    return F.coalesce(F.lower(source), F.lit("")).isin(*SHOWN_SOURCES)


def known(players: DataFrame, width: float, height: float) -> DataFrame:
    """Rows that may be shown: of a player with an id P..., locked or revived, no official; boxes cut to the picture."""
    fit = lambda c, most: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(most)).alias(c)
    rows = players.where(~F.coalesce("is_official", F.lit(False)) & F.coalesce(F.col("player_id").startswith("P"), F.lit(False)) & shown(F.col("assignment_source")))
    return rows.select(*FRAME, "player_id", "raw_track_id", "assignment_source", F.coalesce("identity_confidence", F.lit(0.0)).alias("confidence"), fit("x1", width), fit("y1", height), fit("x2", width), fit("y2", height))


def candidates(players: DataFrame, motion: DataFrame, matches: DataFrame, width: float = 1920.0, height: float = 1080.0) -> DataFrame:
    """I13 before what was shown last is asked: a row for each seen box, and for each frame without one of each player, with state, reason and box.

    Seen boxes are visible; of several of one id the surest stays (then the lower raw track), of a track that is an official's in this frame none. A gap of up to 8 frames
    is filled along the camera's way, the last box is held for up to 15 frames; neither goes over a cut.
    """
    officials = players.where("is_official").groupBy(*FRAME).agg(F.collect_set("raw_track_id").alias("officials"))
    line = timeline(matches, motion).join(officials, FRAME, "left")
    in_time = F.col("frame_idx").between(0, F.col("frames_processed") - 1)
    seen = known(players, width, height).join(matches.select("match_id", "frames_processed"), "match_id").where(in_time)
    own = F.struct("frame_idx", "raw_track_id", "assignment_source", "confidence", "x1", "y1", "x2", "y2")
    at = F.struct("ox", "oy", "motion_class", "cuts", "officials")
    grid = seen.select(*PLAYER).distinct().join(line, "match_id").select(*PLAYER, "frame_idx", at.alias("at"))
    both = grid.unionByName(seen.select(*PLAYER, "frame_idx", own.alias("own")), allowMissingColumns=True)
    w = Window.partitionBy(*PLAYER).orderBy("frame_idx", F.col("own").isNotNull(), "own.raw_track_id")  # each frame's row of the grid, then its boxes
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("at", F.last("at", ignorenulls=True).over(so_far)).withColumn("_next", F.lead("frame_idx").over(w)).select(*PLAYER, "frame_idx", "at.*", "own", "_next")
    rows = rows.withColumn("p", F.last(F.when(F.col("own").isNotNull(), F.struct("own.*", "ox", "oy", "cuts")), ignorenulls=True).over(so_far))
    rows = rows.where("own IS NOT NULL OR _next IS NULL OR _next > frame_idx").withColumn("mine", F.col("own").isNotNull()).drop("own", "_next")  # p is the own box then
    back = Window.partitionBy(*PLAYER).orderBy(F.desc("frame_idx"), F.desc("p.raw_track_id"))
    rows = rows.withColumn("n", F.last(F.when(F.col("mine"), F.col("p")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    age, gap = F.col("frame_idx") - F.col("p.frame_idx"), F.col("n.frame_idx") - F.col("p.frame_idx")
    held = (age <= HOLD) & (F.col("cuts") == F.col("p.cuts"))
    state = (
        F.when(F.col("mine"), "visible").when(F.col("p").isNull(), None).when(F.col("n").isNotNull() & (F.col("n.cuts") != F.col("p.cuts")), None)
        .when(gap <= FILL, "interpolated").when(held, "held")
    )
    reason = (
        F.when(F.col("p").isNull(), "no_box_before").when(F.col("n").isNotNull(), F.when(F.col("n.cuts") != F.col("p.cuts"), "cut").otherwise("gap_too_large"))
        .when(F.col("cuts") != F.col("p.cuts"), "cut").otherwise("hold_expired")
    )
    t = age / gap
    smooth = t * t * (3 - 2 * t)
    mid = lambda s, a, b: (F.col(f"{s}.{a}") + F.col(f"{s}.{b}")) / 2
    size = lambda a, b: (F.col(f"p.{b}") - F.col(f"p.{a}")) + ((F.col(f"n.{b}") - F.col(f"n.{a}")) - (F.col(f"p.{b}") - F.col(f"p.{a}"))) * t
    along = lambda a, b, o: (mid("p", a, b) - F.col(f"p.{o}")) + ((mid("n", a, b) - F.col(f"n.{o}")) - (mid("p", a, b) - F.col(f"p.{o}"))) * smooth + F.col(o)
    filled = {"x1": along("x1", "x2", "ox") - size("x1", "x2") / 2, "y1": along("y1", "y2", "oy") - size("y1", "y2") / 2, "x2": along("x1", "x2", "ox") + size("x1", "x2") / 2, "y2": along("y1", "y2", "oy") + size("y1", "y2") / 2}
    last = F.coalesce("p", "n")  # the box that the row goes by
    rows = rows.withColumn("state", state).withColumn("reason", F.when(F.col("state").isNull(), reason)).withColumn("by", last)
    rows = rows.withColumns({c: F.when(F.col("state") == "interpolated", v).when(F.col("state").isNotNull(), F.col(f"by.{c}")) for c, v in filled.items()})
    rows = rows.select(*FRAME, "player_id", "motion_class", F.col("by.raw_track_id").alias("raw_track_id"), F.col("by.assignment_source").alias("assignment_source"), F.col("by.confidence").alias("confidence"), "state", "reason", age.alias("age"), "x1", "y1", "x2", "y2", "officials")
    small = (F.col("state") != "visible") & ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) < AREA)
    rows = _hidden(rows, small, "empty_box")
    rows = _hidden(rows, F.array_contains("officials", F.col("raw_track_id")), "official", always=True).drop("officials")
    first = F.row_number().over(Window.partitionBy(*PLAYER, "frame_idx").orderBy(F.desc(F.col("state").isNotNull()), F.desc("confidence"), "raw_track_id"))
    return _hidden(rows.withColumn("_first", first), F.col("_first") > 1, "duplicate_id").drop("_first")


def _hidden(rows: DataFrame, when: Column, why: str, always: bool = False) -> DataFrame:
    """Hides rows; those that are hidden already keep their reason, unless ``always``."""
    when = F.coalesce(when, F.lit(False)) & (F.lit(True) if always else F.col("state").isNotNull())
    return rows.withColumn("reason", F.when(when, why).otherwise(F.col("reason"))).withColumn("state", F.when(~when, F.col("state")))


def decisions(found: DataFrame) -> DataFrame:
    """Candidates with the rules of what was shown last: a filled or held box over 140 px from it is hidden, and so is a player's very first box in a fast pan.

    The state starts anew at each seen box that is shown, so a fold over the frames up to the next one decides.
    """
    seen = F.coalesce(F.col("state") == "visible", F.lit(False))
    so_far = Window.partitionBy(*PLAYER).orderBy("frame_idx").rangeBetween(Window.unboundedPreceding, 0)  # all rows of a frame are in one block
    rows = found.withColumn("block", F.count_if(seen).over(so_far))
    centre = lambda a, b: (F.col(a) + F.col(b)) / 2
    asked = F.when(F.col("state").isNotNull(), F.struct("frame_idx", (F.col("state") == "visible").alias("seen"), centre("x1", "x2").alias("x"), centre("y1", "y2").alias("y"), (F.col("motion_class") == "fast_pan").alias("pan")))
    start = F.struct(F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.array().cast("array<struct<f:bigint,why:string>>").alias("gone"))

    def step(acc: Column, r: Column) -> Column:
        far = ~r["seen"] & acc["x"].isNotNull() & (distance(acc["x"], acc["y"], r["x"], r["y"]) > JUMP)
        frozen = ~r["seen"] & acc["x"].isNull() & r["pan"]
        why = F.when(far, "jump").when(frozen, "pan_freeze")
        return F.struct(F.when(why.isNull(), r["x"]).otherwise(acc["x"]).alias("x"), F.when(why.isNull(), r["y"]).otherwise(acc["y"]).alias("y"),
                        F.when(why.isNull(), acc["gone"]).otherwise(F.concat(acc["gone"], F.array(F.struct(r["frame_idx"].alias("f"), why.alias("why"))))).alias("gone"))

    in_block = Window.partitionBy(*PLAYER, "block").orderBy("frame_idx")
    whole = in_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_asked", F.collect_list(asked).over(whole)).withColumn("_nth", F.row_number().over(in_block))
    folded = F.when((F.col("_nth") == 1) & F.exists("_asked", lambda r: ~r["seen"]), F.aggregate(F.array_sort("_asked"), start, step)["gone"])  # once a block
    rows = rows.withColumn("_gone", F.first(folded, ignorenulls=True).over(whole))
    why = F.get(F.filter("_gone", lambda g: g["f"] == F.col("frame_idx")), F.lit(0))["why"]
    out = rows.withColumn("_why", F.when(F.col("state") != "visible", why))
    out = out.withColumn("reason", F.coalesce("_why", "reason")).withColumn("state", F.when(F.col("_why").isNull(), F.col("state")))
    alpha = F.when(F.col("state") == "visible", 1.0).when(F.col("state") == "interpolated", FILLED).when(F.col("state") == "held", F.greatest(F.lit(FAINTEST), 1 - FADE * F.col("age")))
    box = [F.when(F.col("state").isNotNull(), F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")]
    return out.select(*FRAME, "player_id", "raw_track_id", "assignment_source", F.coalesce("state", F.lit("hidden")).alias("state"), "reason", alpha.alias("alpha"), *box)


def manifest(decided: DataFrame, players: DataFrame, motion: DataFrame, matches: DataFrame) -> DataFrame:
    """Per match the frames and boxes shown and hidden by reason, coverage of tracking, warnings, and whether the invariants hold.

    Invariants: no id is shown twice in a frame, and none that isn't locked or revived.
    """
    on = F.col("state") != "hidden"
    frames = decided.groupBy(*FRAME).agg(F.count_if(on).alias("n"), F.count_if(on & shown(F.col("assignment_source"))).alias("sure"), (F.count_if(on) - F.count_distinct(F.when(on, F.col("player_id")))).alias("twice"))
    frames = frames.groupBy("match_id").agg(F.count_if(F.col("n") > 0).alias("frames_shown"), F.count_if(F.col("sure") > 0).alias("frames_sure"), F.max("twice").alias("most_twice"))
    states = {s: F.count_if(F.col("state") == s).alias(f"{s}_boxes") for s in ("visible", "interpolated", "held", "hidden")}
    reasons = [F.count_if(F.col("reason") == r).alias(f"hidden_{r}") for r in ("cut", "gap_too_large", "hold_expired", "no_box_before", "empty_box", "official", "duplicate_id", "jump", "pan_freeze")]
    boxes = decided.groupBy("match_id").agg(*states.values(), *reasons, F.count_if(on & (F.col("assignment_source") == "locked")).alias("locked_boxes"), F.count_if(on & ~shown(F.col("assignment_source"))).alias("_odd"))
    official = F.coalesce("is_official", F.lit(False))
    tracked = players.groupBy("match_id").agg(
        F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.count_if(official).alias("official_boxes"),
        F.count_if(~official & ~(F.coalesce(F.col("player_id").startswith("P"), F.lit(False)) & shown(F.col("assignment_source")))).alias("unknown_boxes"))
    classes = timeline(matches, motion).groupBy("match_id").agg(F.count_if(F.col("motion_class") == "fast_pan").alias("fast_pan_frames"), F.count_if(F.col("motion_class") == "cut").alias("cut_frames"))
    samples = motion.groupBy("match_id").agg(F.count("*").alias("samples"))
    out = matches.select("match_id", F.col("frames_processed").alias("frames"))
    for part in (frames, boxes, tracked, classes, samples):
        out = out.join(part, "match_id", "left")
    out = out.na.fill(0, [c for c, t in out.dtypes if t in ("bigint", "int") and c not in ("first_frame", "last_frame")])
    covered = F.coalesce(F.col("last_frame") - F.col("first_frame") + 1, F.lit(0).cast("long"))
    out = out.withColumns({"frames_empty": F.col("frames") - F.col("frames_shown"), "coverage": F.round(covered / F.col("frames"), 6), "head": F.coalesce("first_frame", "frames"), "tail": F.coalesce(F.greatest(F.col("frames") - F.col("last_frame") - 1, F.lit(0)), F.lit(0).cast("long"))})
    warnings = F.array_compact(F.array(F.when(F.col("samples") == 0, "no_camera_motion"), F.when(F.col("coverage") < 0.8, "partial_tracking")))
    return out.withColumns({"warnings": F.array_join(warnings, ","), "sound": (F.col("most_twice") == 0) & (F.col("_odd") == 0)}).drop("_odd", "most_twice", "samples", "first_frame", "last_frame")

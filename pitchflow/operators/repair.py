"""Identity repair: suppression of surplus boxes, span look-up, gates on the pitch, re-id merges, stitching, patches."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, iou
from .components import components
from .joins import FRAME, frame_pairs


# ---------------------------------------------------------------- P25


def box_quality() -> Column:
    """Quality of a tracked box by score, age, time since its last update and height."""
    age = F.least(F.col("age") / 30.0, F.lit(1.0))
    recent = F.greatest(1.0 - F.col("since_update") / 15.0, F.lit(0.0))
    size = F.least((F.col("y2") - F.col("y1")) / 200.0, F.lit(1.0))
    return 0.40 * F.col("score") + 0.30 * age + 0.20 * recent + 0.10 * size


def duplicates(boxes: DataFrame, overlap: float = 0.65, near: float = 35.0) -> DataFrame:
    """(match_id, frame_idx, raw_track_id): of boxes that cover each other the ones of less quality, best first; a removed box removes none.

    Only pairs that do cover each other are collected, a few to a frame.
    """
    rank = F.row_number().over(Window.partitionBy(*FRAME).orderBy(F.desc("quality"), "raw_track_id"))
    ranked = boxes.withColumn("_rank", rank)
    cx, cy = ((lambda s, a=a, b=b: (F.col(f"{s}{a}") + F.col(f"{s}{b}")) / 2) for a, b in (("x1", "x2"), ("y1", "y2")))
    close = (iou("a_", "b_") > overlap) & (distance(cx("a_"), cy("a_"), cx("b_"), cy("b_")) < near)
    pairs = frame_pairs(ranked, "_rank").where(close)
    order = F.array_sort(F.collect_list(F.struct(F.col("a__rank").alias("i"), F.col("b__rank").alias("j"), F.col("b_raw_track_id").alias("id"))))
    none = F.array().cast("array<struct<rank:int,id:bigint>>")
    gone = lambda acc, r: F.exists(acc, lambda x: x["rank"] == r)
    walk = lambda acc, p: F.when(gone(acc, p["i"]) | gone(acc, p["j"]), acc).otherwise(F.concat(acc, F.array(F.struct(p["j"].alias("rank"), p["id"].alias("id")))))
    kept = pairs.groupBy(*FRAME).agg(order.alias("p")).select(*FRAME, F.explode(F.aggregate("p", none, walk)).alias("g"))
    return kept.select(*FRAME, F.col("g.id").alias("raw_track_id"))


def suppressed(boxes: DataFrame, stale: int = 25, most: int = 28) -> DataFrame:
    """P25: boxes (raw_track_id, x1..y2, score, age, since_update) with ``removed_by``: ghost, duplicate, overlay, cap or null.

    Ghosts weren't updated for over 25 frames; overlays are low, at the picture's top or bottom edge, or wide; at most 28
    boxes of the best quality stay in a frame.
    """
    rows = boxes.withColumn("quality", box_quality())
    live = rows.where(F.col("since_update") <= stale)
    dup = duplicates(live).withColumn("_dup", F.lit(True))
    rows = rows.join(dup, [*FRAME, "raw_track_id"], "left")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    overlay = (h < 30) | ((F.col("y1") + F.col("y2")) / 2 < 80) | ((F.col("y1") > 620) & (h < 60)) | ((w > 0) & (h / w < 0.5))
    why = F.when(F.col("since_update") > stale, "ghost").when(F.col("_dup"), "duplicate").when(overlay, "overlay")
    rows = rows.withColumn("_why", why).drop("_dup")
    place = F.row_number().over(Window.partitionBy(*FRAME, F.col("_why").isNull()).orderBy(F.desc("quality"), "raw_track_id"))
    return rows.withColumn("removed_by", F.coalesce("_why", F.when(place > most, "cap"))).drop("_why")


# ---------------------------------------------------------------- J10, I11


def spans(rows: DataFrame, segments: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the first segment (match_id, raw_track_id, start_frame, end_frame) that each row's frame lies in; nulls if none does.

    Segments of a raw track are few, so each row is given those of its raw track, and the frame decides.
    """
    key = ["match_id", "raw_track_id"]
    own = segments.groupBy(*key).agg(F.collect_list(F.struct(F.col("start_frame").alias("_a"), F.col("end_frame").alias("_b"), *columns)).alias("_own"))
    first = F.array_min(F.filter("_own", lambda s: F.col("frame_idx").between(s["_a"], s["_b"])))
    return rows.join(own, key, "left").withColumn("_s", first).select(*rows.columns, *(F.col(f"_s.{c}").alias(c) for c in columns))


def pitch_gate(rows: DataFrame, metres_a_frame: float = 1.2, reach: float = 31.5) -> DataFrame:
    """Whether a player's step since the row before is possible, and its cost of 0 to 1 (0.5 for a first row)."""
    w = Window.partitionBy("match_id", "player_id").orderBy("frame_idx", "raw_track_id")
    out = rows.withColumn("dt", F.col("frame_idx") - F.lag("frame_idx").over(w)).withColumn("metres", distance("x", "y", F.lag("x").over(w), F.lag("y").over(w)))
    ok = F.col("dt").isNull() | (F.col("dt") <= 0) | (F.col("metres") <= metres_a_frame * F.col("dt"))
    return out.withColumn("possible", ok).withColumn("cost", F.when(F.col("dt").isNull(), 0.5).otherwise(F.least(F.col("metres") / reach, F.lit(1.0))))


# ---------------------------------------------------------------- I5


def bhattacharyya(a: str, b: str) -> Column:
    """Distance of two histograms: 0 if equal in shape, 1 if apart."""
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda acc, x: acc + x)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    return F.sqrt(F.greatest(F.lit(0.0), 1 - shared / F.sqrt(total(a) * total(b))))


def reid_links(pieces: DataFrame, gap: tuple[int, int] = (-5, 125), pixels: float = 400.0, unlike: float = 0.5, block: int = 128) -> DataFrame:
    """Pairs (match_id, a, b) of track pieces that may be one player: near in time, place and size, and alike in colour.

    Pieces (track_id, first_seen, last_seen, first and last centres fx, fy, lx, ly and heights fh, lh, hist) meet by blocks of frames.
    """
    lo, hi = gap
    a = pieces.select("match_id", *(F.col(c).alias(f"a_{c}") for c in ("track_id", "first_seen", "last_seen", "lx", "ly", "lh", "hist")))
    a = a.withColumn("_k", F.explode(F.sequence(F.floor((F.col("a_last_seen") + lo) / block), F.floor((F.col("a_last_seen") + hi) / block))))
    b = pieces.select("match_id", *(F.col(c).alias(f"b_{c}") for c in ("track_id", "first_seen", "fx", "fy", "fh", "hist"))).withColumn("_k", F.floor(F.col("b_first_seen") / block))
    wait = F.col("b_first_seen") - F.col("a_last_seen")
    size = F.col("b_fh") / F.col("a_lh")
    near = wait.between(lo, hi) & (distance("a_lx", "a_ly", "b_fx", "b_fy") <= pixels) & ((F.col("a_lh") <= 0) | (F.col("b_fh") <= 0) | size.between(0.4, 2.5))
    met = a.join(b, ["match_id", "_k"]).where(F.col("a_track_id") != F.col("b_track_id")).where(near).where(bhattacharyya("a_hist", "b_hist") < unlike)
    return met.select("match_id", F.least("a_track_id", "b_track_id").alias("a"), F.greatest("a_track_id", "b_track_id").alias("b")).distinct()


def reid_merged(spark: SparkSession, pieces: DataFrame, **limits) -> DataFrame:
    """One row for each merged track: its lowest id, numbers of pieces and hits, first and last frame."""
    roots = components(spark, reid_links(pieces, **limits)).withColumnRenamed("node", "track_id")
    merged = pieces.join(roots, ["match_id", "track_id"], "left").withColumn("merged_id", F.coalesce("root", "track_id"))
    return merged.groupBy("match_id", "merged_id").agg(F.count("*").alias("pieces"), F.sum("hits").alias("hits"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


# ---------------------------------------------------------------- I7


def stitch_costs(p: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cost of joining each piece j to its i (rows in order): colour, jump, gap and, where there is one, embedding."""
    out = np.zeros(len(i))
    hist = np.stack(p["hist"].to_list()).astype(float) + 1e-7
    e = np.stack(p["embedding"].to_list()).astype(float) if "embedding" in p else None
    e = e / (np.linalg.norm(e, axis=1, keepdims=True) + 1e-6) if e is not None else None
    x0, y0, x1, y1, first, last = (p[c].to_numpy() for c in ("x0", "y0", "x1", "y1", "first_seen", "last_seen"))
    for k in range(0, len(i), 1 << 15):  # so many pairs' histograms at once
        a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
        colour = np.minimum((((hist[a] - hist[b]) ** 2) / (hist[a] + hist[b])).sum(-1) / 5.0, 1.0)
        jump = np.hypot(x1[a] - x0[b], y1[a] - y0[b])
        cost = 0.30 * colour + 0.25 * np.where(jump < 8, 0.0, np.minimum((jump - 8) / 20.0, 1.0)) + 0.10 * np.minimum(np.maximum(first[b] - last[a], 0) / 120.0, 1.0)
        out[k : k + len(a)] = cost + (0.35 * (1 - (e[a] * e[b]).sum(-1)) if e is not None else 0.0)
    return np.round(out, 9)


def stitched_ids(p: pd.DataFrame, max_gap: int = 60, team_size: int = 11, most: float = 0.60) -> list[int]:
    """I7 for the pieces of one team, in order of their first frames: the cheapest join first, while there are more than ``team_size`` ids and it costs at most 0.60.

    Two groups cost what their cheapest pair of pieces does, seen from the group that comes first, and take its id. Only pairs that lie
    within ``max_gap`` frames of each other have a cost; a heap holds them.
    """
    n = len(p)
    first, last = p.first_seen.to_numpy(), p.last_seen.to_numpy()
    till = np.searchsorted(first, last + max_gap, side="right")
    many = np.maximum(till - np.arange(n) - 1, 0)
    i = np.repeat(np.arange(n), many)
    j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + i + 1
    ahead: list[dict[int, float]] = [{} for _ in range(n)]  # what a group costs seen from the one before
    behind: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, there, back in zip(i.tolist(), j.tolist(), stitch_costs(p, i, j).tolist(), stitch_costs(p, j, i).tolist(), strict=True):
        ahead[a][b] = behind[b][a] = there
        ahead[b][a] = behind[a][b] = back
    heap = [(c, a, b) for a in range(n) for b, c in ahead[a].items() if a < b]
    heapq.heapify(heap)
    root, alive, left = list(range(n)), [True] * n, n
    while left > team_size and heap:
        c, a, b = heapq.heappop(heap)
        if c > most:
            break
        if not (alive[a] and alive[b]) or ahead[a].get(b) != c:
            continue
        alive[b], root[b], left = False, a, left - 1
        for mine, theirs in ((ahead, behind), (behind, ahead)):
            for other, cost in mine[b].items():
                if alive[other] and other != a and cost < mine[a].get(other, np.inf):
                    mine[a][other] = theirs[other][a] = cost
                    x, y = (a, other) if mine is ahead else (other, a)
                    if x < y:
                        heapq.heappush(heap, (cost, x, y))
        ahead[b], behind[b] = {}, {}
    for k in range(n):  # a group's id is that of the group that took it in
        root[k] = root[root[k]] if root[k] < k else k
    return [int(p.track_id.iloc[r]) for r in root]


def stitched(pieces: DataFrame) -> DataFrame:
    """I7 over (match_id, team_id, track_id, first_seen, last_seen, x0, y0, x1, y1, hist): each piece's joined id; a team's pieces are one group."""

    def code(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["first_seen", "track_id"]).reset_index(drop=True)
        return p[["match_id", "team_id", "track_id"]].assign(stitched_id=stitched_ids(p))

    return pieces.groupBy("match_id", "team_id").applyInPandas(code, "match_id string, team_id long, track_id long, stitched_id long")


# ---------------------------------------------------------------- I3


class Identities:
    """The boxes of a match by player, and the first violation of each: an id on two boxes of a frame, a gap over 150 frames, or over 60 px a frame.

    A change touches the players that it names; the others' first violations stand.
    """

    def __init__(self, rows: pd.DataFrame):
        r = rows.sort_values(["frame_idx", "raw_track_id"], kind="stable")
        self.index, self.frame, self.official = r.index.to_numpy(), r.frame_idx.to_numpy(), r.is_official.to_numpy(dtype=bool)
        self.x, self.y = r.cx.to_numpy(dtype=float), r.cy.to_numpy(dtype=float)
        known = np.flatnonzero(r.player_id.notna().to_numpy())
        names, code = np.unique(r.player_id.to_numpy()[known].astype(str), return_inverse=True)
        order = np.argsort(code, kind="stable")
        self.of = dict(zip(names.tolist(), np.split(known[order], np.cumsum(np.bincount(code, minlength=len(names)))[:-1]), strict=True)) if len(names) else {}
        self.first = {name: self.checked(own) for name, own in self.of.items()}

    def checked(self, own: np.ndarray) -> tuple[tuple[float, str], tuple[float, str]]:
        """Places in the order of frames of a player's first double box, and of its first gap or speed."""
        own = own[~self.official[own]]
        f = self.frame[own]
        twice = np.flatnonzero(f[1:] == f[:-1]) + 1
        double = (np.inf, "")
        if len(twice):
            early, late = own[np.searchsorted(f, f[twice[0]])], own[twice[0]]
            double = (int(late), "raw_id_collision" if np.hypot(self.x[late] - self.x[early], self.y[late] - self.y[early]) < 10 else "duplicate_id")
        one = np.delete(own, twice)
        dt = np.diff(self.frame[one])
        moved = np.flatnonzero((dt > 150) | (np.hypot(np.diff(self.x[one]), np.diff(self.y[one])) / dt > 60))
        return double, ((int(one[moved[0] + 1]), "gap" if dt[moved[0]] > 150 else "speed") if len(moved) else (np.inf, ""))

    def violation(self) -> str | None:
        """The first of all, in the order of frames; a double box comes before a move in its frame."""
        double = min((d for d, _ in self.first.values()), default=(np.inf, ""))
        moved = min((m for _, m in self.first.values()), default=(np.inf, ""))
        if double[0] < np.inf and (moved[0] == np.inf or self.frame[double[0]] <= self.frame[moved[0]]):
            return double[1]
        return moved[1] or None

    def tried(self, start: float, end: float, a: str, b: str | None) -> str | None:
        """Moves a's boxes in these frames to b and b's to a (without b: to nobody), if no violation comes of it; else tells the violation."""
        none = np.zeros(0, np.int64)
        own = {name: self.of.get(name, none) for name in (a, b) if name}
        inside = {name: (self.frame[rows] >= start) & (self.frame[rows] <= end) for name, rows in own.items()}
        before = {name: (self.of.get(name), self.first.get(name)) for name in own}
        for name, other in ((a, b), (b, a)):
            if name:
                gets = own[other][inside[other]] if other and a != b else own[name][inside[name]] if a == b else none
                self.of[name] = np.sort(np.concatenate([own[name][~inside[name]], gets]))
                self.first[name] = self.checked(self.of[name])
        why = self.violation()
        if why:
            for name, (rows, first) in before.items():
                if rows is None:
                    del self.of[name], self.first[name]
                else:
                    self.of[name], self.first[name] = rows, first
        return why

    def ids(self) -> pd.Series:
        out = pd.Series([None] * len(self.index), index=self.index, dtype=object)
        for name, own in self.of.items():
            out.loc[self.index[own]] = name
        return out


def violation(rows: pd.DataFrame) -> str | None:
    """The first of these in the order of frames: an id on two boxes under 10 px apart, or further apart; a gap over 150 frames; over 60 px a frame."""
    return Identities(rows.reset_index(drop=True)).violation()


def patched(rows: pd.DataFrame, patches: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple]]:
    """I3 for one match: patches in their order; each is refused before (confidence under 0.75, an official, a keeper that would leave its role), or taken back after a violation."""
    rows, out = rows.reset_index(drop=True), []
    keepers = set(rows.player_id[rows.role == "goalkeeper"].dropna())
    officials = set(rows.player_id[rows.is_official].dropna())
    held = Identities(rows)
    for p in patches.sort_values("patch").itertuples():
        pids = {x for x in (p.pid_a, p.pid_b) if isinstance(x, str)}
        why = "low_confidence" if p.confidence < 0.75 else "official" if pids & officials else "keeper" if p.action == "swap" and len(pids & keepers) == 1 else None
        if not why:
            last = np.inf if pd.isna(p.apply_to) else p.apply_to
            other = p.pid_b if p.action == "swap" and isinstance(p.pid_b, str) else None
            known = p.action in ("swap", "mark_unknown", "reject_revival", "suppress") and isinstance(p.pid_a, str)
            why = held.tried(p.apply_from, last, p.pid_a, other) if known else held.violation()
        out.append((p.match_id, p.patch, p.action, why is None, why))
    return rows.assign(player_id=held.ids()), out


def patch_log(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """For each patch whether it was accepted, else why not. Patches depend on those before them, so a match is one group."""
    names = ["match_id", "patch", "action", "accepted", "reason"]

    def code(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(patched(left, right)[1] if len(right) else [], columns=names)

    boxes = rows.select("match_id", "frame_idx", "raw_track_id", "player_id", "role", "is_official", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    return boxes.groupBy("match_id").cogroup(patches.groupBy("match_id")).applyInPandas(code, "match_id string, patch long, action string, accepted boolean, reason string")

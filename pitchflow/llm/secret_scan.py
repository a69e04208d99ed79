"""Secret scans with built-in functions only: fixed patterns, and character Markov models.

Three fixed kinds of spans (assign, access, hex) come from patterns. A fourth kind, markov, adds runs of
key-like characters that a first-order Markov model of random strings explains better than one of ordinary
identifiers, by a log-likelihood ratio above a threshold; runs that lie within a fixed span add nothing, runs
that reach out of one are added whole. Both models are trained from labelled samples; in ``sample_values``
the values that the fixed patterns find are the random strings, and the other long words are the
identifiers, from a bounded share of the texts (``max_texts``).

Positions are code points, ends are exclusive. A text is split at a pattern once, and running sums over the
lengths of what lies between and of the matches give all spans. They are made in blocks of blocks, so that time
grows with the text's length and its number of matches.

Cases: null text counts as empty and has no spans; texts are scanned whole, whatever their length and number
of matches; with no samples no markov span is found; repeated rows are scanned alike; columns of docs with the
names of the results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds, in their order; assign's group is the value.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that can be key or hash material for the Markov models.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SYMBOLS = 128
PRIOR = 16.0
CHUNK = 32
BLOCK = 1024  # code points of a text that are searched for a place

SPAN = "struct<start:int,rank:int,end:int,kind:string>"
FOUND = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def running(values: Column, op: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """For each integer of an array what op makes of 0 and those before it, in blocks of blocks of ``CHUNK``."""

    def blocked(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda b: F.slice(v, b * CHUNK + 1, CHUNK))
        within = lambda b, head: F.transform(b, lambda x, i: F.aggregate(F.slice(b, 1, i), head, op))
        whole = lambda bs: F.transform(bs, lambda b: F.aggregate(b, F.lit(0), op))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, running(whole(bs), op, levels - 1), within)))

    if not levels:
        return let(values, lambda v: F.transform(v, lambda x, i: F.aggregate(F.slice(v, 1, i), F.lit(0), op)))
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(values, blocked))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _spans(text: Column, pattern: str, test: str, rank: int, value_least: int = 0, least: int = 1, with_value: bool = False) -> Column:
    """Spans of the leftmost non-overlapping matches; ``test`` is a pattern that any text with a span has."""
    size = lambda x: F.coalesce(F.length(x), F.lit(0))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.split(text, pattern, -1), hits, lambda p, h: F.struct(F.length(p).alias("gap"), size(h).alias("size"), h.alias("hit")))
    if value_least:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        parts = F.zip_with(parts, values, lambda x, v: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), x["hit"].alias("hit"), size(v).alias("value")))

    def placed(p: Column) -> Column:
        at = running(F.transform(p, lambda x: x["gap"] + x["size"]), _add)
        every = F.zip_with(p, at, lambda x, a: F.struct((a + x["gap"]).alias("start"), x.alias("x")))
        kept = F.filter(every, lambda y: (y["x"]["size"] >= least) & (y["x"]["value"] >= value_least if value_least else F.lit(True)))
        fields = lambda y: [y["start"].alias("start"), F.lit(rank).alias("rank"), (y["start"] + y["x"]["size"]).alias("end"), F.lit(KINDS[rank]).alias("kind")]
        return F.transform(kept, lambda y: F.struct(*fields(y), *([y["x"]["hit"].alias("value")] if with_value else [])))

    return F.when(text.rlike(test), let(parts, placed)).otherwise(F.array().cast(f"array<{FOUND if with_value else SPAN}>"))


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds, by start, then kind."""
    found = (
        _spans(text, ASSIGN, ASSIGN, 0, value_least=6),
        # greedy runs: a run that is long enough is found whole by its bounded form, and a short one not at all
        _spans(text, r"AKIA[A-Z0-9]{16,}", r"AKIA[A-Z0-9]{16}", 1, least=20),
        _spans(text, r"[0-9a-f]{24,}", r"[0-9a-f]{24}", 2, least=24),
    )
    return F.array_sort(F.concat(*found))


def characters(value: Column) -> Column:
    """The characters of a string, each as one, in time that grows with its length."""
    return F.filter(F.split(value, ""), lambda c: c != "")


def sample_values(texts: DataFrame, text: str = "text", max_texts: int = 20_000) -> DataFrame:
    """(value, random): labelled strings from about max_texts texts, drawn by the hash of the text."""
    n = texts.select(F.count(text)).first()[0]
    share = min(1.0, max_texts / max(1, n))
    drawn = texts.select(F.col(text).alias("_t")).where(F.xxhash64(F.lit(29), "_t").bitwiseAND((1 << 30) - 1) / float(1 << 30) < share).distinct()
    keys = F.concat(
        F.regexp_extract_all("_t", F.lit(ASSIGN), F.lit(1)), F.regexp_extract_all("_t", F.lit(r"AKIA[A-Z0-9]{16,}"), F.lit(0)), F.regexp_extract_all("_t", F.lit(r"[0-9a-f]{24,}"), F.lit(0))
    )
    rest = F.regexp_replace(F.regexp_replace("_t", ASSIGN, " "), r"[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}", " ")
    words = F.regexp_extract_all(rest, F.lit(r"[A-Za-z_][A-Za-z0-9_-]{7,}"), F.lit(0))
    rows = drawn.select(F.explode(F.concat(F.transform(keys, lambda v: F.struct(v.alias("value"), F.lit(True).alias("random"))), F.transform(words, lambda v: F.struct(v.alias("value"), F.lit(False).alias("random"))))).alias("s"))
    return rows.select("s.value", "s.random").where("NOT random OR length(value) >= 16")


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs, 128 x 128: random strings over identifiers.

    A pair's probability leans on that of its second character, with the weight of PRIOR observations.

    What comes to the driver is one count for each label and pair of ASCII characters.
    """
    values = samples.where("length(value) >= 2").groupBy("random", "value").agg(F.count("*").alias("_n"))
    codes = values.select("random", "_n", F.transform(characters(F.col("value")), F.ascii).alias("_c"))
    pairs = codes.select("random", "_n", F.explode(F.arrays_zip(F.slice("_c", 1, F.size("_c") - 1).alias("a"), F.slice("_c", 2, F.size("_c") - 1).alias("b"))).alias("p"))
    pairs = pairs.select("random", "_n", "p.a", "p.b").where(f"a < {SYMBOLS} AND b < {SYMBOLS} AND a > 0 AND b > 0")
    counts = pairs.groupBy("random", "a", "b").agg(F.sum("_n").alias("n")).collect()
    seen = {True: {}, False: {}}
    for r in counts:
        seen[r.random][r.a, r.b] = r.n
    if not seen[True] or not seen[False]:
        return []
    rows = {k: dict.fromkeys(range(SYMBOLS), 0) for k in seen}
    ends = {k: dict.fromkeys(range(SYMBOLS), 0) for k in seen}
    for k, table in seen.items():
        for (a, b), n in table.items():
            rows[k][a] += n
            ends[k][b] += n
    total = {k: sum(rows[k].values()) for k in seen}
    kinds = 64  # characters of a candidate

    def log_p(k: bool, a: int, b: int) -> float:
        alone = (ends[k][b] + 0.5) / (total[k] + 0.5 * kinds)
        return math.log((seen[k].get((a, b), 0) + PRIOR * alone) / (rows[k][a] + PRIOR))

    return [round(log_p(True, a, b) - log_p(False, a, b), 5) for a in range(SYMBOLS) for b in range(SYMBOLS)]


def ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of an ASCII string."""
    table = F.split(F.lit(" ".join(map(str, model))), " ").cast("array<double>")  # one literal after constant folding
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] >= 0, F.element_at(table, acc["last"] * SYMBOLS + c + 1)).otherwise(0.0)).alias("sum"))
    return F.aggregate(F.transform(characters(value), F.ascii), start, step, lambda acc: acc["sum"])


def markov_spans(text: Column, base: Column, model: list[float], threshold: float = 8.0) -> Column:
    """Candidate runs, but those within a base span, whose ratio is over the threshold."""
    if not model:
        return F.array().cast(f"array<{SPAN}>")
    found = _spans(text, CANDIDATE, CANDIDATE, 3, with_value=True)
    both = F.array_sort(F.concat(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["rank"].alias("rank"), b["end"].alias("end"), b["kind"].alias("kind"), F.lit("").alias("value"))), found))

    def outside(every: Column) -> Column:
        # by start, base spans first: a run is within one if it ends before the furthest end so far
        reach = running(F.transform(every, lambda x: F.when(x["rank"] < 3, x["end"]).otherwise(0)), _most)
        out = F.filter(F.zip_with(every, reach, lambda x, r: F.struct(x.alias("x"), r.alias("r"))), lambda y: (y["x"]["rank"] == 3) & (y["x"]["end"] > y["r"]))
        return F.transform(out, lambda y: y["x"])

    apart = F.when((F.size(base) > 0) & (F.size(found) > 0), let(both, outside)).otherwise(found)
    likely = F.filter(apart, lambda x: ratio(x["value"], model) > threshold)
    return F.transform(likely, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def scan(docs: DataFrame, model: list[float], text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """Adds the columns ``base`` (the fixed kinds' spans) and ``spans`` (all of them), or replaces those of these names."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn(base, base_spans(whole))
    return out.withColumn(spans, F.array_sort(F.concat(base, markov_spans(whole, F.col(base), model))))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span, or run of overlapping spans, replaced."""

    def part(blocks: Column, a: Column, b: Column) -> Column:
        """Code points a to b - 1; only the blocks they lie in are looked at."""
        first = F.floor(a / BLOCK).cast("int")
        some = F.slice(blocks, first + 1, F.floor((b + BLOCK - 1) / BLOCK).cast("int") - first)
        cut = lambda x, i: F.substring(x, F.greatest(a - (first + i) * BLOCK, F.lit(0)) + 1, F.least(b - (first + i) * BLOCK, F.lit(BLOCK)) - F.greatest(a - (first + i) * BLOCK, F.lit(0)))
        return F.when(b > a, F.array_join(F.transform(some, cut), "")).otherwise("")

    end = F.array(F.struct(F.length(text).alias("start"), F.lit(9).alias("rank"), F.length(text).alias("end"), F.lit("").alias("kind")))

    def gaps(both: Column) -> Column:
        at = running(F.transform(both["spans"], lambda x: x["end"]), _most)
        each = F.zip_with(both["spans"], at, lambda x, a: F.struct(x["start"].alias("start"), a.alias("at"), x["rank"].alias("rank")))
        free = F.filter(each, lambda x: (x["start"] >= x["at"]) | (x["rank"] == 9))
        return F.transform(free, lambda x: part(both["blocks"], x["at"], F.greatest(x["at"], x["start"])))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    whole = F.array_join(let(F.struct(F.concat(spans, end).alias("spans"), blocks.alias("blocks")), gaps), mark)
    return F.when(F.size(spans) > 0, whole).otherwise(text)

"""The analytics services of a match as declared jobs: each with the tables it needs, run on its own, its outcome recorded."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import physical, possession, tactics


@dataclass(frozen=True)
class Service:
    """A job over named tables."""

    name: str
    needs: tuple[str, ...]
    run: Callable[..., DataFrame]


def _events(points: DataFrame, ball: DataFrame) -> DataFrame:
    runs = possession.sequences(possession.confirmed(points, ball))
    found = [(possession.passes(runs), "pass"), (possession.turnovers(runs, physical.ball_speed(ball)), "turnover"), (possession.carries(runs), "carry")]
    rows = [r.select("match_id", "frame_idx", "team_id", F.lit(kind).alias("kind")) for r, kind in found]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _pressing(points: DataFrame, ball: DataFrame) -> DataFrame:
    held = possession.confirmed(points, ball)
    return possession.ppda(possession.press_actions(points, held), held)


def _counter_press(points: DataFrame, ball: DataFrame) -> DataFrame:
    held = possession.confirmed(points, ball)
    return possession.counter_press(possession.turnovers(possession.sequences(held), physical.ball_speed(ball)), points, ball, held)


SERVICES = (
    Service("pass_network", ("points", "ball"), lambda points, ball: possession.pass_nodes(possession.passes(possession.sequences(possession.confirmed(points, ball))), points)),
    Service("xg", ("points", "ball"), lambda points, ball: possession.shots(physical.ball_speed(ball), points)),
    Service("heatmaps", ("points",), lambda points: physical.heatmap(points, physical.TRACK)),
    Service("pressing", ("points", "ball"), _pressing),
    Service("formations", ("points",), lambda points: tactics.formations(points)),
    Service("defensive_lines", ("points",), lambda points: tactics.defensive_lines(points)),
    Service("counter_press", ("points", "ball"), _counter_press),
    Service("tactics", ("points",), lambda points: tactics.shape(points)),
    Service("events", ("points", "ball"), _events),
    Service("set_pieces", ("ball",), lambda ball: possession.set_pieces(possession.stationary(physical.ball_speed(ball)))),
)


def run_services(spark: SparkSession, tables: dict[str, DataFrame | None], services: tuple[Service, ...] = SERVICES, at_once: int = 4) -> tuple[dict[str, DataFrame | None], DataFrame]:
    """(results by service, record of service, status, rows, missing, error).

    A service of which a table is missing isn't run and has no result (missing). The others are run ``at_once`` at a time, each written to the shared folder, so that a
    service that fails, in planning or in a task, is recorded (failed) and stops none of the rest.
    """
    def outcome(service: Service) -> tuple[DataFrame | None, tuple]:
        missing = [n for n in service.needs if tables.get(n) is None]
        if missing:
            return None, (service.name, "missing", None, ",".join(missing), None)
        try:
            found = stored(spark, service.run(*(tables[n] for n in service.needs)), f"service-{service.name}")
            return found, (service.name, "done", found.count(), None, None)
        except Exception as error:  # whatever it is: the record tells, and the other services run
            return None, (service.name, "failed", None, None, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"[:500])

    with ThreadPoolExecutor(at_once) as pool:
        out = list(pool.map(outcome, services))
    record = spark.createDataFrame([row for _, row in out], "service string, status string, rows long, missing string, error string")
    return {s.name: found for s, (found, _) in zip(services, out, strict=True)}, record


def found_by_match(results: dict[str, DataFrame | None]) -> DataFrame | None:
    """(match_id, service, rows) of all results; a service without a result has no row."""
    parts = [r.groupBy("match_id").agg(F.count("*").alias("rows")).select("match_id", F.lit(name).alias("service"), "rows") for name, r in results.items() if r is not None]
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

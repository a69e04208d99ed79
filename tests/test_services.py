"""Services run one by one: missing tables, failures in planning and in tasks, and the rest go on."""

from pyspark.sql import functions as F

from pitchflow.operators import services


def test_a_service_that_fails_stops_none_of_the_rest(spark):
    points = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "match_id string, x long")
    some = (
        services.Service("first", ("points",), lambda p: p),
        services.Service("no_table", ("points", "ball", "pitch"), lambda *t: t[0]),
        services.Service("bad_plan", ("points",), lambda p: p.select("nothing")),
        services.Service("bad_row", ("points",), lambda p: p.select("match_id", F.raise_error(F.lit("row is bad")).cast("long").alias("x"))),
        services.Service("bad_code", ("points",), lambda p: 1 / 0),
        services.Service("last", ("points",), lambda p: p.where("x > 1")),
    )
    results, record = services.run_services(spark, {"points": points, "ball": None}, some)
    got = {r.service: (r.status, r.rows, r.missing) for r in record.collect()}
    assert got == {"first": ("done", 3, None), "no_table": ("missing", None, "ball,pitch"), "bad_plan": ("failed", None, None), "bad_row": ("failed", None, None), "bad_code": ("failed", None, None), "last": ("done", 2, None)}
    errors = {r.service: r.error for r in record.collect() if r.error}
    assert set(errors) == {"bad_plan", "bad_row", "bad_code"} and errors["bad_code"].startswith("ZeroDivisionError") and "nothing" in errors["bad_plan"]
    assert {k: v is not None for k, v in results.items()} == {"first": True, "no_table": False, "bad_plan": False, "bad_row": False, "bad_code": False, "last": True}
    assert {(r.match_id, r.service, r.rows) for r in services.found_by_match(results).collect()} == {("a", "first", 2), ("b", "first", 1), ("a", "last", 1), ("b", "last", 1)}
    assert services.found_by_match({"x": None}) is None and services.run_services(spark, {}, ())[1].count() == 0


def test_without_a_ball_the_declared_services_that_need_it_are_missing(spark):
    points = spark.createDataFrame([("a", f, k, k % 2, 10.0 * k, 5.0) for f in range(6) for k in range(4)], "match_id string, frame_idx long, track_id long, team_id long, x double, y double")
    record = {r.service: r.status for r in services.run_services(spark, {"points": points})[1].collect()}
    assert record == {s.name: "missing" if "ball" in s.needs else "done" for s in services.SERVICES}

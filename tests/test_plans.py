"""How large plans get: each exchange costs the driver memory for every task of every map and every update of the plan."""

import pytest

from pitchflow.operators import display
from pitchflow.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name, most", [("i13_decisions", 10), ("a35_manifest", 13), ("i9_annotated", 12)])
def test_exchanges(spark, name, most):
    assert exchanges(QUERIES[name](spark, SF)) <= most


def test_a_match_without_frames(spark):
    players = spark.createDataFrame([("m", 0, 1, "P1", False, "locked", 0.5, 0.0, 0.0, 30.0, 60.0)], "match_id string, frame_idx long, raw_track_id long, player_id string, is_official boolean, assignment_source string, identity_confidence double, x1 double, y1 double, x2 double, y2 double")
    motion = spark.createDataFrame([], "match_id string, frame_idx long, dx double, dy double, motion_class string")
    found = display.candidates(players, motion, spark.createDataFrame([("m", 0)], "match_id string, frames_processed long"))
    assert display.decisions(found).count() == 0

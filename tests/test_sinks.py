"""Writers, stores and labels: what is written is read again."""

import json

from pyspark.sql import functions as F

from pitchflow.sources import readers


def test_review_queue_round_trip(spark, tmp_path):
    rows = [("e1", "needs_review", "t1"), ("e2", "ok", "t2"), ("e3", "needs_review", None)]
    events = spark.createDataFrame([(e, t, None, None, 5, "why", s, None, None) for e, s, t in rows], "event_id string, thread_id string, target_thread_id string, segment_id string, frame long, reason string, status string, label string, notes string")
    columns = "event_id action thread_id target_thread_id segment_id frame reason status label notes".split()
    readers.write_review(events.withColumn("action", F.lit("")).select(*columns), f"{tmp_path}/queue")
    assert readers.read_actions(spark, f"{tmp_path}/queue").count() == 0  # a blank action does nothing
    text = [r.value for r in spark.read.text(f"{tmp_path}/queue").collect()]
    assert sum("e1" in t for t in text) == sum("e3" in t for t in text) == 1 and not any("e2" in t for t in text)
    (tmp_path / "done.csv").write_text(",".join(columns) + "\ne1,merge,t1,t2,,5,why,needs_review,,\ne3, ,t3,,,5,why,needs_review,,\n")
    done = readers.read_actions(spark, f"{tmp_path}/done.csv").collect()
    assert [(r.event_id, r.action, r.frame) for r in done] == [("e1", "merge", 5)]


def test_memory_keeps_the_newest_of_a_match(spark, tmp_path):
    for k, (m, ts, sprints) in enumerate([("a", 1.0, 3), ("a", 5.0, 4), ("b", 2.0, 9), ("c", 9.0, 1)]):
        (tmp_path / f"{k}.json").write_text(json.dumps({"match_id": m, "ts": ts, "sprints": sprints, "max_kmh": 30.0, "width": 40.0}))
    got = [(r.match_id, r.sprints) for r in readers.read_memory(spark, str(tmp_path)).collect()]
    assert got == [("c", 1), ("a", 4), ("b", 9)] and len(readers.read_memory(spark, str(tmp_path), 2).collect()) == 2


def test_timeline_is_partitioned_by_match(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.25), ("b", 2, 0.75)], "match_id string, frame_idx long, x double")
    readers.export_timeline(rows, f"{tmp_path}/out")
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"match_id=a", "match_id=b"}
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("match_id", "frame_idx", "x").collect())) == [("a", 1, 0.5), ("b", 1, 0.25), ("b", 2, 0.75)]


def test_label_statistics(spark, tmp_path):
    for split, name, text in (("train", "f1", "0 0.5 0.5 0.2 0.4\n1 0.5 0.5 0.1 0.1\n"), ("train", "f2", "0 0.5 0.5 0.4 0.2\nbad line\n"), ("test", "f3", "0 0.1 0.1 1.0 1.0\n")):
        (tmp_path / split).mkdir(exist_ok=True)
        (tmp_path / split / f"{name}.txt").write_text(text)
    got = {(r.split, r.cls): (r.files, r.boxes, round(r.mean_w, 6), round(r.mean_area, 6)) for r in readers.label_statistics(readers.read_labels(spark, f"{tmp_path}/*/*.txt")).collect()}
    assert got == {("train", 0): (2, 2, 0.3, 0.08), ("train", 1): (1, 1, 0.1, 0.01), ("test", 0): (1, 1, 1.0, 1.0)}

"""The ledger, storage places, and logs of keyed rows."""

import os

from pyspark.sql import functions as F

from trellium.sources.catalog import Catalog
from trellium.sources.keyed_log import KeyedLog
from trellium.sources.places import csv_places, processed_places, resolve
from trellium.streaming.ledger import Entry, Ledger, digest_of, once
from trellium.streaming.status import read_status, settle, status_log, status_step


def test_places():
    assert csv_places("s3a://b", "/tmp/x.csv", "uploads/j/x.csv", "j") == ["/tmp/x.csv", "s3a://b/uploads/j/x.csv"]
    assert csv_places("s3a://b/", "/tmp/1778_x.csv", None, "j") == ["/tmp/1778_x.csv", "s3a://b/uploads/j/x.csv"]
    assert csv_places("r", " ", "s3a://c/k.csv", "j") == ["s3a://c/k.csv"] and csv_places("r", None, "/k.csv", None) == ["/k.csv"]
    assert csv_places("r", "", "", "j") == [] and csv_places("r", None, None, None) == []
    assert processed_places("r", "", "processed/k.parquet", "j") == ["r/processed/k.parquet", "r/processed/j.parquet"]


def test_the_first_place_that_exists(spark, tmp_path):
    (tmp_path / "uploads" / "j").mkdir(parents=True)
    (tmp_path / "uploads" / "j" / "x.csv").write_text("a")
    there = str(tmp_path / "uploads" / "j" / "x.csv")
    for path, key in ((there, None), ("/no/17_x.csv", None), ("/no/y.csv", "uploads/j/x.csv"), ("", "uploads/j/x.csv")):
        assert resolve(spark, csv_places(str(tmp_path), path, key, "j")) == there
    assert resolve(spark, csv_places(str(tmp_path), "/no/y.csv", "gone.csv", "j")) == "/no/y.csv"
    assert resolve(spark, []) is None


def test_a_log_folds_its_parts(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "log"), "k string, v int, t int", ["k"], ["t"])
    assert log.read().count() == 0 and not log.fold()
    expected = {}
    for t in range(50):
        rows = [("a", t, t), (f"b{t % 3}", -t, t), (None, t, t)]
        frame = spark.createDataFrame(rows, "k string, v int, t int").coalesce(1)
        log.write(frame, f"{t:03d}")
        if t % 7 == 0:
            log.write(frame, f"{t:03d}")
        expected |= {k: v for k, v, _ in rows}
        log.fold(4)
        assert len(log.parts()) <= 10
        if t % 10 == 9:
            assert {r.k: r.v for r in log.read().collect()} == expected
    # A part that was folded and comes again changes nothing.
    log.write(spark.createDataFrame([("a", 3, 3)], "k string, v int, t int"), "003")
    assert {r.k: r.v for r in log.read().collect()} == expected


def test_a_fold_that_ended_early_is_done_again(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "log"), "k string, v int", ["k"], ["v"])
    for t in range(3):
        log.write(spark.createDataFrame([("a", t), (f"b{t}", t)], "k string, v int"), str(t))
    before = sorted(map(tuple, log.read().collect()))
    held = log.read()
    log.fold(0)
    os.rename(tmp_path / "log" / "folded", tmp_path / "lost")
    assert sorted(map(tuple, log.read().collect())) == before
    assert log.fold(0) and sorted(map(tuple, log.read().collect())) == before
    assert sorted(map(tuple, held.collect())) == before


def test_work_is_done_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    worked = []

    def work(messages):
        worked.extend(m["job_id"] for m in messages)
        return [Entry(m["job_id"], digest_of(m), {"job_id": m["job_id"]}, "bad" if m["job_id"] == "x" else None) for m in messages]

    def run(batch, *jobs, time=1):
        entries = once(ledger, "s", batch, [{"job_id": j, "timestamp": time} for j in jobs], work)
        ledger.record("s", batch, entries)
        return sorted(e.key for e in entries)

    assert run("1", "a", "x") == ["a", "x"] and run("1", "a", "x") == ["a", "x"]
    assert worked == ["a", "x", "x"]  # the replay sends both again, but only the reject is tried again
    assert run("2", "a", "b") == ["b"] and run("2", "a", "b") == ["b"] and worked[3:] == ["b"]
    assert run("3", "a", time=2) == ["a"] and worked[4:] == ["a"]
    got = {(r.key, r.batch, r.status) for r in ledger.read().collect()}
    assert got == {("a", "1", "done"), ("x", "1", "rejected"), ("b", "2", "done"), ("a", "3", "done")}
    assert once(None, "s", "1", [{"job_id": "a"}], work)[0].key == "a"


def test_status_reaches_the_catalog_and_parts_stay_few(spark, tmp_path):
    root, catalog = str(tmp_path / "s"), str(tmp_path / "c")
    tables = Catalog(spark, catalog)
    tables.add_jobs(spark.createDataFrame([("j0", "m", "completed"), ("other", "m", "queued")], "job_id string, model_name string, status string").withColumns(
        {"task_type": F.lit("regression"), "target_column": F.lit("y"), "uploader": F.lit("l"), "user_id": F.lit("me"), "created_at": F.current_timestamp()}))
    step = status_step(root, catalog, parts=5)
    for batch in range(50):
        step(spark.createDataFrame([(f"j{batch % 4}", batch % 3), (None, 1)], "job_id string, rank int").coalesce(1), batch)
        assert len(status_log(spark, root).parts()) <= 12
    settle(spark, root, catalog)
    jobs = {r.job_id: (r.status, r.model_name) for r in tables.read("jobs").collect()}
    assert jobs == {"j0": ("completed", "m"), "other": ("queued", "m"), "j1": ("training", None), "j2": ("training", None), "j3": ("training", None)}
    assert {r.job_id: r.status for r in read_status(spark, root).collect()} == {None: "ingested", **{f"j{i}": "training" for i in range(4)}}
    assert len(os.listdir(f"{root}/base")) <= 2

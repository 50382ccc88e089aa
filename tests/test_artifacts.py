"""The index of a project's files."""

import os
import time

from trellium.sources.artifacts import ArtifactIndex


def put(path, at=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("x")
    if at is not None:
        os.utime(path, (at, at))


def test_only_new_files_are_added(spark, tmp_path):
    index = ArtifactIndex(spark, str(tmp_path))
    index.refresh()
    assert index.read().count() == 0
    now = time.time()
    put(tmp_path / "uploads" / "j 1" / "a+b.csv", now - 90_000)
    put(tmp_path / "processed" / "j1.parquet" / "part-0.parquet", now - 80_000)
    put(tmp_path / "models" / "notes.txt", now - 70_000)
    put(tmp_path / "other" / "x" / "y.csv", now)
    index.refresh()
    known = {(r.kind, r.id): r for r in index.read().collect()}
    assert set(known) == {("uploads", "j 1"), ("processed", "j1")} and known["uploads", "j 1"].path.endswith("uploads/j 1/a+b.csv")
    put(tmp_path / "models" / "j1.pkl.meta", now - 60_000)
    put(tmp_path / "processed" / "j1.parquet" / "part-1.parquet", now - 50_000)
    for _ in range(3):
        index.refresh()
    again = {(r.kind, r.id): r for r in index.read().collect()}
    assert set(again) == {*known, ("models", "j1")} and again["processed", "j1"].path.endswith("part-1.parquet")
    assert again["uploads", "j 1"] == known["uploads", "j 1"]
    parts = len(index.log.parts())
    for _ in range(20):
        index.refresh()
    assert len(index.log.parts()) <= max(parts, 34) and index.read().count() == 3

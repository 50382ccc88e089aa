import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import agree
from trellium.llm import negatives
from trellium.llm.queries import QUERIES, SQL


def brute(rows, is_anchor, mining):
    """rows: (id, label, whole vector)."""
    out = []
    for ai, al, av in rows:
        if not is_anchor(ai):
            continue
        scored = [(-sum(a * b for a, b in zip(av, v)), i, lab) for i, lab, v in rows if i != ai]
        near = sorted((s, i) for s, i, lab in scored if lab == al)[: mining.positives]
        for s, p in near:
            window = sorted((t, i) for t, i, lab in scored if lab != al and mining.low * -s <= 100 * -t <= mining.high * -s)
            out += [(ai, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(window[: mining.negatives])]
    return sorted(out)


def floors(v):
    return [int(np.floor(256.0 * c)) for c in v]


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, sf_dir):
    import os

    if not os.path.isdir(sf_dir):
        pytest.skip("test tables are not here")
    text, n = agree.difference(spark, agree.connect(sf_dir), "op12", QUERIES["op12_negatives"], SQL["op12_negatives"], sf_dir)
    assert not text and n > 0


@pytest.mark.parametrize("seed", range(3))
def test_ties_small_blocks_and_groups(spark, seed, monkeypatch):
    """Few distinct scores, several blocks to a task and several groups of anchors."""
    rng = random.Random(seed)
    rows = [(i, rng.choice([0, 1, 1, 1, 2]), [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(6)]) for i in range(120)]
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 7 * 48)
    monkeypatch.setattr(negatives, "GROUP_BYTES", 4 * 48)
    mining = negatives.Mining(positives=3, negatives=4, low=20, high=80)
    frame = spark.createDataFrame(rows, "vec_id int, label int, embedding array<double>").repartition(3)
    got = negatives.mine(frame, F.col("vec_id") % 10 == 0, F.col("label"), mining)
    expected = brute([(i, lab, floors(v)) for i, lab, v in rows], lambda i: i % 10 == 0, mining)
    assert sorted(tuple(r) for r in got.collect()) == expected and expected


def test_bounds_never_lose_a_row():
    """A block's scan against all scores, with columns that prune early."""
    rng = np.random.default_rng(1)
    for _ in range(30):
        x = (rng.standard_normal((200, 20)) * rng.uniform(1, 300, 20)).astype(np.int64)
        labels = rng.integers(0, 3, 200)
        block = negatives._unpack(negatives._pack(np.arange(200), labels, x))
        q = x[5]
        scores = x @ q
        best = negatives.Best(5)
        negatives.scan_positives(block, negatives.Scan(q), 5, int(labels[5]), best)
        expected = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != 5 and labels[i] == labels[5])[:5]
        assert list(zip(best.scores, best.ids)) == [(-s, i) for s, i in expected]
        top = best.scores[0]
        windows = [(top // 3, top // 2, negatives.Best(4)), (-top, top // 4, negatives.Best(4))]
        negatives.scan_negatives(block, negatives.Scan(q), 5, int(labels[5]), windows)
        for low, high, b in windows:
            inside = sorted((-s, i) for i, s in enumerate(scores.tolist()) if labels[i] != labels[5] and low <= s <= high)[:4]
            assert list(zip(b.scores, b.ids)) == [(-s, i) for s, i in inside]


def test_few_columns_are_read_when_bounds_decide():
    rng = np.random.default_rng(2)
    x = np.concatenate([np.full((1, 64), 100), rng.integers(-5, 6, (999, 64))]).astype(np.int64)
    x[:, 7] = rng.integers(-9000, 9000, 1000)
    x[:, 40] = rng.integers(-9000, 9000, 1000)
    x[0, [7, 40]] = 9000
    block = negatives._unpack(negatives._pack(np.arange(1000), np.zeros(1000, int), x))
    left = []

    def bounds(partial, low, high):
        floor = int(np.partition(partial, len(partial) - 5)[-5]) + low if len(partial) > 5 else None
        alive = np.ones(len(partial), bool) if floor is None else partial >= floor - high
        left.append(int(alive.sum()))
        return alive

    negatives.Scan(x[0]).exact(block, np.arange(1000), bounds)
    assert left[0] < 50


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5], "s"), (100, 2, [1.0, 0.25], None), (3, 1, [0.5, 1.0], "s"), (3, 1, [0.5, 1.0], "s"), (4, None, [1.0, 1.0], "s"),
            (None, 1, [9.0, 9.0], "s"), (5, 1, None, "s"), (6, 1, [nan, 1.0], "s"), (7, 2, [1.0, inf], "s"), (8, 2, [None, 1.0], "s"),
            (9, 2, [1.0], "s"), (10, 2, [], "s"), (11, 2, [0.25, 0.25], "s"), (0, 1, [1.0, 0.5], "s")]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, score string").withColumn("x", F.lit(1)).withColumn("id", F.lit(2))
    got = negatives.mine(frame, F.col("vec_id") % 100 == 0, F.col("label"))
    whole = [(i, lab, floors(v)) for i, lab, v, _ in rows if i in (0, 3, 11, 100)]
    assert sorted(tuple(r) for r in got.collect()) == brute(whole, lambda i: i % 100 == 0, negatives.Mining())
    assert negatives.mine(frame.limit(0), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    assert negatives.mine(frame.where("vec_id = 3"), F.col("vec_id") % 100 == 0, F.col("label")).columns == got.columns

import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from trellium.llm import reshard
from trellium.llm.queries import QUERIES


def least_moved(supplies, capacities):
    return sum(max(0, s - c) for s, c in zip(supplies, capacities))


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(2)
    for _ in range(50):
        n = rng.randint(1, 6)
        supplies = [rng.randint(0, 100) for _ in range(n)]
        capacities = reshard.equal_capacities(sum(supplies), n)
        flow = reshard.min_cost_flow(supplies, capacities)
        assert [sum(a for (i, _), a in flow.items() if i == k) for k in range(n)] == supplies
        assert [sum(a for (_, j), a in flow.items() if j == k) for k in range(n)] == capacities
        assert sum(a for (i, j), a in flow.items() if i != j) == least_moved(supplies, capacities)


def test_flow_with_costs_equals_all_ways():
    rng = random.Random(4)
    for _ in range(30):
        cost = {(i, j): rng.randint(0, 9) for i in range(3) for j in range(3)}
        flow = reshard.min_cost_flow([1, 1, 1], [1, 1, 1], cost)
        best = min(sum(cost[i, p[i]] for i in range(3)) for p in itertools.permutations(range(3)))
        assert sum(cost[e] * a for e, a in flow.items()) == best


def test_too_little_room_is_an_error():
    with pytest.raises(ValueError):
        reshard.min_cost_flow([5], [4])


def laws(rows, given, shards=16):
    assert len(rows) == len(given)
    for k in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == k)
        assert slots == list(range(len(slots)))
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in given
    )


def test_query(spark, sf):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op2_reshard"](spark, sf).collect()
    laws(rows, given)
    sizes = [sum(r.size for r in rows if r.shard == k) for k in range(16)]
    assert max(sizes) - min(sizes) <= max(r.size for r in rows)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    old = [sum(r.size for r in rows if r.old_shard == k) for k in range(16)]
    moved = sum(r.size for r in rows if r.shard != r.old_shard)
    assert moved <= least_moved(old, reshard.equal_capacities(sum(old), 16)) + 2 * 16 * max(r.size for r in rows)


def test_small_rows_are_cut_near_equal(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text"))
    rows = reshard.reshard(docs, F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 16), 16).collect()
    sizes = [sum(r.size for r in rows if r.shard == k) for k in range(16)]
    assert max(sizes) - min(sizes) <= 50
    for k in range(16):
        slots = sorted(r.slot for r in rows if r.shard == k)
        assert slots == list(range(len(slots)))


def test_odd_rows(odd, none):
    rows = reshard.reshard(odd, F.lit(3)).collect()
    laws(rows, [(r.doc_id, r.text) for r in odd.collect()])
    assert reshard.reshard(none, F.lit(0)).count() == 0


def test_rewrite_touches_affected_shards_only(spark, tmp_path):
    root, target = str(tmp_path / "old"), str(tmp_path / "new")
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"),
                                   F.when(F.col("id") < 200, 0).when(F.col("id") < 300, 1).otherwise(2).alias("shard"))
    docs.write.partitionBy("shard").parquet(root)
    folders = reshard.rewrite_shards(spark.read.parquet(root), root, target, shards=4)
    assert folders[1].startswith(root) and folders[2].startswith(root)
    assert folders[0].startswith(target) and folders[3].startswith(target)
    parts = [spark.read.parquet(folders[k]) for k in range(4)]
    assert [p.count() for p in parts] == [100] * 4
    assert sorted(r.doc_id for p in parts for r in p.select("doc_id").collect()) == list(range(400))


def test_large_rows_follow_the_flow_and_its_costs():
    """Of three rows of 10 bytes one stays; the flow splits another, which goes the cheap way, not to the emptiest shard."""
    cost = {(0, 0): 0, (0, 1): 5, (0, 2): 1}
    placed = reshard.place_large([(0, k, 10) for k in range(3)], [30, 0, 0], [15, 30, 30], cost)
    assert sorted(placed.values()) == [0, 2, 2]


def test_spare_room_moves_nothing(spark):
    """Where every shard may hold all rows, the cheapest flow leaves them where they are; large rows and small ones."""
    for n in (5, 30_000):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), (F.col("id") % 2).alias("old"))
        rows = reshard.reshard(docs, F.col("old"), 4, [10 * n] * 4)
        assert rows.where("shard <> old_shard").count() == 0 and rows.count() == n

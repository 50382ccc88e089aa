import hashlib
import math
from collections import defaultdict

from pyspark.sql import functions as F

from trellium.operators import split


def digest(key):
    return hashlib.md5(f"{key}|42".encode()).hexdigest()


def test_hash_split_is_stable_and_whole(spark, rows):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    one = rows(split.with_test_flag(df))
    assert one == rows(split.with_test_flag(df.repartition(13, "x")))
    assert len(one) == 1000
    assert {r[0] for r in one if r[2]} == {i for i in range(1000) if int(digest(i)[:8], 16) % 100 < 20}
    parts = split.train_test(split.with_test_flag(df))
    assert parts.n_train + parts.n_test == 1000 and parts.holdout
    assert parts.train.intersect(parts.test).count() == 0


def brute(pairs):
    by_label = defaultdict(set)
    for key, label in pairs:
        by_label[label].add(digest(key))
    chosen = {label: set(sorted(ds)[: math.ceil(len(ds) * 20 / 100)]) for label, ds in by_label.items()}
    return sorted(((k, l, digest(k) in chosen[l]) for k, l in pairs), key=repr)


def test_stratified_split_is_exact(spark, rows):
    pairs = [(i, ["hot", "rare", None][0 if i % 3 else (1 if i % 9 else 2)]) for i in range(2000)]
    df = spark.createDataFrame(pairs, "id long, label string")
    for n in (1, 5):
        assert rows(split.with_stratified_flag(df.repartition(n), "label")) == brute(pairs)
    assert rows(split.with_stratified_flag(df, "label", unique_keys=True)) == brute(pairs)


def test_stratified_split_keeps_copies_on_one_side(spark, rows):
    pairs = [(i % 40, "a") for i in range(400)] + [(1000, "b")]
    df = spark.createDataFrame(pairs, "id long, label string")
    assert rows(split.with_stratified_flag(df, "label")) == brute(pairs)


def test_without_a_hold_out_test_is_train(spark):
    flagged = spark.range(3).withColumn("is_test", F.lit(False))
    parts = split.train_test(flagged, "id")
    assert not parts.holdout and parts.n_test == parts.n_train == 3 and parts.varies
    empty = split.train_test(flagged.limit(0), "id")
    assert not empty.holdout and empty.n_test == 0 and not empty.varies


def test_key_falls_back_to_all_columns(spark):
    assert split.split_key(spark.range(1)) == ["id"]
    assert split.split_key(spark.range(1).toDF("a")) == ["a"]


def test_random_split_covers(spark):
    train, test = split.random_split(spark.range(500))
    assert train.count() + test.count() == 500


def test_random_flag_marks_the_same_rows(spark, rows):
    df = spark.range(300)
    flagged = split.with_random_flag(df)
    _, test = split.random_split(df)
    assert {r.id for r in flagged.filter("is_test").collect()} == {r.id for r in test.collect()}
    assert flagged.count() == 300

"""Plans that must keep their shape: what is pushed down, pruned, and cut before a shuffle."""

import pytest
from pyspark.sql import functions as F

from trellium.operators import joins, listing, scoring, split
from trellium.plans import predict, train


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_owner_filter_reaches_the_scan(spark, tmp_path):
    for name in ("jobs", "models"):
        spark.range(10).selectExpr(
            "cast(id as string) job_id", "'m' model_name", "'t' task_type", "'u' user_id",
            "current_timestamp() created_at", "'wide' uploader", "'p' path",
        ).withColumnRenamed("path", "model_path" if name == "models" else "other").write.parquet(str(tmp_path / name))
    jobs, models = (spark.read.parquet(str(tmp_path / n)) for n in ("jobs", "models"))
    plan = plan_of(listing.model_listing(jobs, models, "u"))
    assert "EqualTo(user_id,u)" in plan
    assert "uploader" not in plan.split("ReadSchema")[1]


def test_hash_split_does_not_shuffle(spark):
    assert "Exchange" not in plan_of(split.with_test_flag(spark.range(10)))


def test_first_rows_are_cut_before_the_shuffle(spark):
    df = scoring.sample_rows(spark.range(10).withColumn("k", F.col("id") % 2), ["k"], ["id"])
    below = plan_of(df).split("Exchange")[1]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_top_rows_are_no_sort(spark):
    assert "TakeOrderedAndProject" in plan_of(scoring.top_rows(spark.range(10), ["id"]))


def test_only_small_sides_are_broadcast(spark):
    small = spark.range(5).withColumnRenamed("id", "k")
    large = spark.range(100)
    marked = joins.broadcast_if_small(small, limit=10)
    unmarked = joins.broadcast_if_small(small, limit=3)
    assert unmarked is small
    assert "BroadcastHashJoin" in plan_of(large.join(marked, F.col("id") == F.col("k")))
    assert large.join(marked, F.col("id") == F.col("k")).count() == 5


def test_stratified_split_does_not_shuffle_the_table(spark):
    """Only digests counted per bin travel; the rows get their flag from a broadcast."""
    df = spark.range(100).withColumn("label", F.col("id") % 3)
    plan = plan_of(split.with_stratified_flag(df, "label", unique_keys=True))
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_hot_key_meets_a_table_in_shares(spark, rows):
    """Nine tenths of the rows have one key and are equal; same result as a plain join, and several tasks share them."""
    hot = spark.range(3000).selectExpr("if(id % 10 = 0, id, -1L) as k", "if(id % 10 = 0, id, -5L) as v")
    keyed = spark.range(-1, 3000).selectExpr("id as k", "id * 2 as w").filter("k % 20 != 10")
    for how in ("inner", "left"):
        shared = joins.join_hot(hot, keyed, "k", how, share_rows=300)
        assert rows(shared, "k", "v", "w") == rows(hot.join(keyed, "k", how), "k", "v", "w")
    # Tiny partitions would be merged back into one, and a tiny side broadcast.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shared = joins.join_hot(hot, keyed, "k", share_rows=300)
        assert shared.where("k = -1").rdd.glom().map(len).max() < 2000
        plan = plan_of(shared.groupBy("k").agg(F.count("*")))
        assert plan.index("partial_count") > plan.index("Exchange hashpartitioning(k")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def jobs_started(spark, action):
    """How many Spark jobs an action runs."""
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    action()
    return len(set(tracker.getJobIdsForGroup(None)) - before)


def test_jobs_grow_with_layouts_not_with_files(spark, tmp_path):
    """Scoring 40 and 90 files of one layout takes the same jobs; a second layout takes more.

    From 33 files on Spark lists them in jobs of its own, a few for any number.
    """
    layout = train.Layout(str(tmp_path))
    rows = spark.range(60).selectExpr("id", "double(id) a", "double(2 * id) price")
    rows.write.option("header", True).csv(str(tmp_path / "up"))
    train.train_job(spark, layout, "m", str(tmp_path / "up"), "price", "regression", train.TrainOptions("linear"))
    for i in range(90):
        (tmp_path / f"{i}.csv").write_text(f"id,a\n{i},{i}\n")
    (tmp_path / "other.csv").write_text("a,id,note\n1,1,x\n")

    def score(names, out):
        asked = spark.createDataFrame([(n, str(tmp_path / f"{n}.csv"), "m") for n in names], "predict_id string, csv_path string, model_id string")
        return jobs_started(spark, lambda: predict.predict_many(spark, layout, asked, str(tmp_path / out), str(tmp_path / f"{out}-results")).collect())

    few, many = score([str(i) for i in range(40)], "few"), score([str(i) for i in range(90)], "many")
    one, two = score(["0"], "one"), score(["0", "1", "other"], "two")
    assert few == many and one <= many and two > one
    got = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "many"))
    assert sorted((r.predict_id, round(r.price)) for r in got.collect()) == [(i, 2 * i) for i in range(90)]


def test_headers_as_the_reader_names_them(spark, tmp_path):
    from trellium.sources import csv as files

    for i, head in enumerate(["a,b", '"x, y",b', "a,,c", "a,a,b", "\ufeffa,b", " a ,b", 'say ""hi"",b', "A,a"]):
        path = tmp_path / f"{i}.csv"
        path.write_text(f"\n  \n{head}\n1,2,3\n", encoding="utf-8")
        line, folder = files.first_line(spark, str(path))
        assert not folder and files.header_fields(line) == spark.read.option("header", True).options(**files._QUOTING).csv(str(path)).columns, head
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "_SUCCESS").write_text("")
    (tmp_path / "d" / "part-0.csv").write_text("")
    (tmp_path / "d" / "part-1.csv").write_text("k,v\n")
    assert files.first_line(spark, str(tmp_path / "d")) == ("k,v", True)
    with pytest.raises(FileNotFoundError, match="PATH_NOT_FOUND"):
        files.first_line(spark, str(tmp_path / "none"))
    spark.range(3).selectExpr("id", "id v").coalesce(1).write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "z"))
    assert files.header_of(spark, str(tmp_path / "z")) == ["id", "v"]


def test_rows_of_a_hot_key_are_never_shuffled_by_the_bare_key(spark):
    """Only counts travel by the key alone; rows travel by key and share."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(2000).select((F.col("id") % 2).alias("k"), "id")
        plan = plan_of(joins.join_hot(rows, spark.range(2).select(F.col("id").alias("k")), "k", share_rows=300))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    by_key = [line for line in plan.split("\n") if "hashpartitioning(k#" in line and "__share" not in line]
    assert plan.count("BroadcastHashJoin") == 2 and len(by_key) == plan.count("partial_count")


def test_rows_stay_where_they_are_for_few_constants(spark):
    """Rows that are scored with constants are shuffled only if the constants are many."""
    rows = spark.range(4000).select((F.col("id") % 5).alias("model_id"), "id", F.lit(0.0).alias("prediction"))
    few = spark.range(4).select(F.col("id").alias("model_id"), (F.col("id") * 1.5).alias("prediction"))
    many = few.union(spark.range(10, joins.SMALL_ROWS + 20).select("id", F.lit(0.5)))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = [scoring.score_constants(rows, constants) for constants in (few, many)]
        assert "hashpartitioning" not in plan_of(scored[0]) and "SortMergeJoin" in plan_of(scored[1])
        for got in scored:
            assert got.columns == ["model_id", "id", "prediction"]
            assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == [(i % 5, i, None if i % 5 == 4 else i % 5 * 1.5) for i in range(4000)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_lines_of_many_jobs_are_joined_once(spark, tmp_path, monkeypatch):
    """Each job trains on rows that were written, so no pass over them joins again."""
    from trellium.plans import queries_streams

    spark.createDataFrame([(i, "F") for i in range(8)], "o_orderkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(
        [(i, 1, float(i), 0.1, 10.0 * i) for i in range(8)],
        "l_orderkey long, l_linenumber long, l_quantity double, l_discount double, l_extendedprice double",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    plans, whole = [], train.train_table
    monkeypatch.setattr(train, "train_table", lambda table, *more: plans.append(plan_of(table)) or whole(table, *more))
    rows = queries_streams.metadata_files(spark, str(tmp_path)).collect()
    assert {r.model_id for r in rows} == {"job-F", "by-hand"}
    assert len(plans) == 1 and "Join" not in plans[0]

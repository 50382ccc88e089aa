import pytest
from pyspark.sql import functions as F

from trellium.operators import listing, merge
from trellium.sources import folders, registry
from trellium.sources.catalog import Catalog


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "k int, name string, status string")


def test_keep_first_twice_is_once(spark, rows, target):
    source = spark.createDataFrame([(2, "x", "new"), (3, "z", "new"), (3, "y", "new")], target.schema)
    once = merge.merge_keep_first(target, source, "k", ["name"])
    assert rows(once) == [(1, "a", "old"), (2, "b", "old"), (3, "y", "new")]
    assert rows(merge.merge_keep_first(once, source, "k", ["name"])) == rows(once)


def test_update_touches_only_its_columns(spark, rows, target):
    source = spark.createDataFrame([(2, "x", None), (3, "y", "s1"), (3, "z", "s2")], target.schema)
    once = merge.merge_update(target, source, "k", ["status"], ["name"])
    assert rows(once) == [(1, "a", "old"), (2, "b", None), (3, "y", "s2")]
    assert rows(merge.merge_update(once, source, "k", ["status"], ["name"])) == rows(once)


def test_null_key_is_an_error(spark, target):
    source = spark.createDataFrame([(None, "x", "new")], target.schema)
    with pytest.raises(Exception, match="must not be null"):
        merge.merge_keep_first(target, source, "k").collect()


def test_update_where_key(spark, rows, target):
    keys = spark.createDataFrame([(2,), (2,), (9,)], "k int")
    got = merge.update_where_key(target, keys, "k", {"status": F.lit("completed")})
    assert rows(got) == [(1, "a", "old"), (2, "b", "completed")]


def test_versions_keep_old_readers(spark, rows, target, tmp_path):
    root = str(tmp_path / "t")
    assert folders.read_table(spark, root) is None
    folders.write_table(target, root)
    first = folders.read_table(spark, root)
    folders.write_table(first.filter("k = 1"), root)
    assert first.count() == 2 and folders.read_table(spark, root).count() == 1
    # A version whose write did not finish is not seen, and is written again.
    (tmp_path / "t" / "v=000000001" / "_SUCCESS").unlink()
    assert folders.versions(spark, root) == [0]
    folders.write_table(target, root)
    folders.drop_old_versions(spark, root, keep=1)
    assert folders.versions(spark, root) == [1] and folders.read_table(spark, root).count() == 2


def test_folder_follows_the_setting(spark):
    assert folders.new_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_catalog_and_metrics(spark, rows, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    assert catalog.read("metrics").count() == 0 and catalog.read("jobs").count() == 0
    jobs = spark.createDataFrame(
        [("j1", "n", "regression", "t", None, "queued", "me")],
        "job_id string, model_name string, task_type string, target_column string, uploader string, status string, user_id string",
    ).withColumn("created_at", F.current_timestamp())
    catalog.add_jobs(jobs)
    catalog.complete(jobs.select("job_id"))
    assert catalog.read("jobs").first().status == "completed"
    catalog.add_jobs(jobs)  # queued again
    assert catalog.read("jobs").first().status == "queued"
    values = spark.createDataFrame([("j1", "mse", 1.0)], "job_id string, metric_name string, metric_value double")
    values = values.withColumn("recorded_at", F.current_timestamp())
    for batch in ("b1", "b1", "b2"):
        catalog.add_metrics(values, batch)
    assert catalog.read("metrics").count() == 2


def test_registry_files_and_table(spark, tmp_path):
    (tmp_path / "m 1.pkl.meta").write_text('{"model_type": "spark_mllib", "feature_cols": ["ID", "Age"], "task_type": "regression"}')
    row = registry.read_metadata_files(spark, str(tmp_path)).first()
    assert (row.model_id, row.feature_cols, row.target_column) == ("m 1", ["ID", "Age"], None)
    root = str(tmp_path / "r")
    assert registry.lookup(spark, root, "m") is None
    for estimator in ("linear", "mean"):
        values = registry.registry_row(
            "m", spark_path="p", feature_cols=["a"], feature_types={"a": "int"}, task_type="regression",
            target_column="y", estimator=estimator,
        )
        registry.save_rows(spark.createDataFrame([values], registry.REGISTRY), root)
    found = registry.lookup(spark, root, "m")
    assert found["estimator"] == "mean" and found["feature_types"] == {"a": "int"}
    assert registry.read_registry(spark, root).count() == 1


def test_status_precedence(spark):
    jobs = spark.createDataFrame([(j, "me") for j in ("a", "b", "c", "d", "e")], "job_id string, user_id string")
    models = spark.createDataFrame([("a",)], "job_id string")
    paths = ["uploads/b/x.csv", "processed/b.parquet/p", "uploads/c/x.csv", "models/d.pkl.meta", "uploads/a/x.csv"]
    artifacts = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.job_id: (r.status, r.model_file) for r in listing.job_status(jobs, models, artifacts).collect()}
    assert got == {
        "a": ("completed", True), "b": ("training", False), "c": ("ingested", False),
        "d": ("completed", False), "e": ("queued", False),
    }
    assert listing.job_status(jobs, models, artifacts, "you").count() == 0


def test_requests_without_a_model(spark):
    from trellium.operators.scoring import match_models, unmatched

    requests = spark.createDataFrame([("p1", "m.pkl"), ("p2", "x.pkl.spark")], "predict_id string, model_id string")
    values = registry.registry_row(
        "m", spark_path="p", feature_cols=["a"], feature_types={}, task_type="regression", target_column="y", estimator="mean"
    )
    known = spark.createDataFrame([values], registry.REGISTRY)
    assert [(r.predict_id, r.model_id) for r in unmatched(requests, known).collect()] == [("p2", "x")]
    got = {r.predict_id: (r.task_type, r.error) for r in match_models(requests, known).collect()}
    assert got == {"p1": ("regression", None), "p2": ("classification", "No model found for ID x")}

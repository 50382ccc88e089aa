"""Models in spite of bad features."""

import datetime as dt

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trellium.functions.feature_lists import SchemaError
from trellium.operators import models, scoring
from trellium.operators.features import Preparation
from trellium.operators.tolerant import TolerantAssembler, TolerantModel
from trellium.plans import train
from trellium.sources.catalog import Catalog
from trellium.sources.registry import lookup

KINDS = "id long, n double, i int, b boolean, d date, t timestamp, s string, a array<int>, label double"


@pytest.fixture(scope="module")
def odd(spark):
    """Every type, and something missing in each column."""
    rows = []
    for k in range(60):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=k)
        n = None if k % 6 == 0 else float("nan") if k % 6 == 1 else float(k)
        rows.append((k, n, k % 5 or None, k % 2 == 0, day if k % 7 else None, dt.datetime(2024, 1, 1 + k % 9, 5), "xy"[k % 2] if k % 4 else None, [k], 2.0 * k))
    return spark.createDataFrame(rows, KINDS)


FEATURES = ["n", "i", "b", "d", "t", "s"]
META = {"target_column": "label", "feature_cols": FEATURES}


def test_cells(odd):
    model = TolerantAssembler(inputCols=FEATURES).fit(odd)
    cells = {r.id: r.c for r in model.transform(odd).select("id", vector_to_array("features").alias("c")).collect()}
    numbers = [float(k) for k in range(60) if k % 6 > 1]
    fill = sum(numbers) / len(numbers)
    assert cells[0][:2] == [pytest.approx(fill), 1.0] and cells[1][:2] == cells[0][:2] and cells[2][:2] == [2.0, 0.0]
    assert cells[5][2:4] == [pytest.approx(2.5), 1.0] and cells[6][2:4] == [1.0, 0.0]
    assert cells[6][4] == 1.0 and cells[7][4] == 0.0  # never missing, so there is no mark
    assert cells[1][5:7] == [19724.0, 0.0] and cells[7][6] == 1.0
    assert cells[10][7] == 19724.0
    assert cells[4][8:] == [0.0, 1.0] and cells[1][8:] == [pytest.approx(0.5), 0.0] and cells[2][8:] == [pytest.approx(0.25), 0.0]
    assert len(cells[0]) == 10


def test_saved_and_loaded(odd, tmp_path):
    fitted = models.fit(odd, FEATURES, "label", "regression", "linear", prep=Preparation(tolerant=True))
    fitted.model.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    assert isinstance(loaded.stages[0], TolerantModel)
    one, two = (sorted((r.id, r.label_predicted) for r in scoring.score(m, odd, META).collect()) for m in (fitted.model, loaded))
    assert one == two and all(p is not None for _, p in one)
    unseen = odd.withColumns({"s": F.lit("new"), "n": F.lit(None).cast("double"), "d": F.lit(None).cast("date")})
    assert scoring.score(loaded, unseen, META).where("label_predicted is null").count() == 0


def test_nothing_usable_is_an_error_and_then_a_constant(odd):
    with pytest.raises(SchemaError, match="'a'"):
        models.fit(odd, ["a"], "label", "regression", "linear", prep=Preparation(tolerant=True))
    fitted = models.fit_anyway(odd, ["a"], "label", "regression")
    assert fitted.estimator == "mean" and "array" in fitted.reason


def test_null_features_are_named_before_anything_is_fitted(odd):
    with pytest.raises(SchemaError, match=r"\{'n': 20, 'i': 12\}"):
        models.fit(odd, ["n", "i", "b"], "label", "regression", "linear")
    assert models.fit(odd, ["n", "i", "b"], "label", "regression", "linear", prep=Preparation(impute="mean")).reason is None


def test_the_chain_tells_why(odd):
    small = models.TreeParams(trees=2, depth=2)
    got = models.fit_anyway(odd, FEATURES, "label", "regression", "boosted", small)
    assert got.estimator == "boosted_regressor" and "encoding" in got.reason
    classes = odd.withColumn("label", F.expr("if(label > 60, 'up', 'down')"))
    got = models.fit_anyway(classes, ["n", "i"], "label", "classification", "boosted", small)
    assert got.estimator == "boosted_classifier" and "null" in got.reason
    got = models.fit_anyway(classes, ["n"], "label", "classification", "linear")
    assert (got.estimator, got.reason) == ("majority", "least squares fits numbers only")
    # Whatever fails for another cause ends in least squares or the constant.
    broken = models.TreeParams(trees=0)
    got = models.fit_anyway(odd, ["i", "b"], "label", "regression", "boosted", broken)
    assert got.estimator == "linear" and got.reason
    got = models.fit_anyway(classes, ["i", "b"], "label", "classification", "boosted", broken)
    assert got.estimator == "majority" and got.reason
    whole = odd.select("id", F.col("id").cast("double").alias("n"), "label")
    assert models.fit_anyway(whole, ["n"], "label", "regression", "linear").reason is None


def test_rows_without_an_estimate_and_splits_are_on_record(spark, tmp_path):
    layout = train.Layout(str(tmp_path))
    spark.range(2).selectExpr("id", "double(id) a", "double(3 * id + 1) price").write.option("header", True).csv(str(tmp_path / "two"))
    spark.range(300).selectExpr("id", "if(id % 3 = 0 and id > 250, null, double(id)) a", "double(3 * id + 1) price").write.option("header", True).csv(str(tmp_path / "many"))
    train.train_job(spark, layout, "two", str(tmp_path / "two"), "price", "regression", train.TrainOptions("linear"))
    for _ in range(2):
        train.train_job(spark, layout, "many", str(tmp_path / "many"), "price", "regression", train.TrainOptions("linear"))
    rows = Catalog(spark, layout.catalog).read("metrics").collect()
    assert {r.holdout for r in rows if r.job_id == "two"} == {False} and {r.split_digest for r in rows if r.job_id == "two"} == {None}
    assert {r.holdout for r in rows if r.job_id == "many"} == {True} and {r.n_unscored for r in rows} == {0}
    assert len({r.split_digest for r in rows if r.job_id == "many"}) == 1
    assert "'a'" in lookup(spark, layout.registry, "many")["reason"] and lookup(spark, layout.registry, "two")["reason"] in (None, "fewer than two rows")


def test_metrics_without_provenance_still_read(spark, tmp_path):
    old = spark.createDataFrame([("j", "mse", 1.0)], "job_id string, metric_name string, metric_value double").withColumn("recorded_at", F.current_timestamp())
    catalog = Catalog(spark, str(tmp_path))
    old.write.parquet(f"{tmp_path}/metrics/set-old")
    catalog.add_metrics(old)
    assert [(r.holdout, r.split_digest) for r in catalog.read("metrics").collect()] == [(None, None)] * 2

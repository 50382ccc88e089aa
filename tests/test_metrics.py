import pytest

from trellium.operators import metrics as met


def frame(spark, pairs, kind="double"):
    return spark.createDataFrame(pairs, f"g string, y {kind}, prediction {kind}")


def test_regression(spark):
    df = frame(spark, [("a", 1.0, 2.0), ("a", 3.0, 3.0), ("b", 5.0, 4.0), ("b", 5.0, 5.0)])
    row = met.regression_metrics(df, "y").first()
    assert row.mse == pytest.approx(0.5) and row.rmse == pytest.approx(0.5**0.5)
    assert row.r2 == pytest.approx(1 - 2 / 11) and row.n_samples == 4
    by = {r.g: r for r in met.regression_metrics(df, "y", by=["g"]).collect()}
    assert by["b"].r2 is None and by["a"].r2 == pytest.approx(0.5)


def test_empty_input_gives_nulls(spark):
    none = frame(spark, []).limit(0)
    row = met.regression_metrics(none, "y").first()
    assert (row.mse, row.rmse, row.r2, row.n_samples) == (None, None, None, 0)
    assert tuple(met.classification_metrics(none, "y").first()) == (None, 0)
    assert none.agg(met.mean_label("y").alias("m")).first().m == 0.0


def test_accuracy(spark):
    df = frame(spark, [("a", "x", "x"), ("a", "x", "y"), ("a", None, "y"), ("a", "y", "y")], "string")
    assert met.classification_metrics(df, "y").first().accuracy == 0.5


def test_majority_breaks_ties_downwards(spark, rows):
    df = frame(spark, [("a", "z", ""), ("a", "b", ""), ("b", "q", ""), ("b", None, ""), ("b", None, "")], "string")
    assert met.majority_label(df, "y").first().label == "b"
    assert rows(met.majority_label(df, "y", ["g"])) == [("a", "b", 1), ("b", "q", 1)]


def test_long_form(spark, rows):
    wide = spark.createDataFrame([("j", 1.5, 3)], "job_id string, mse double, n_samples long")
    assert rows(met.to_long(wide, ["mse", "n_samples"]), "metric_name", "metric_value") == [("mse", 1.5), ("n_samples", 3.0)]


def test_regression_metrics_over_scored_rows(spark):
    frame = spark.createDataFrame([(1.0, 1.0), (3.0, 2.0), (100.0, None), (None, 5.0)], "y double, prediction double")
    row = met.regression_metrics(frame, "y").first()
    assert (row.mse, row.n_samples, row.r2) == (0.5, 2, 0.5)
    assert met.unscored(frame, "y").first().n_unscored == 1

import pytest
from pyspark.sql import functions as F

from trellium.functions import text


@pytest.fixture
def value(spark):
    return lambda expr: spark.range(1).select(expr.alias("v")).first().v


def test_task_type(value):
    assert value(text.task_type(F.lit(""), F.lit("Regression"))) == "regression"
    assert value(text.task_type(F.lit("clustering"))) == "classification"
    assert value(text.task_type(F.lit(None).cast("string"))) == "classification"


def test_names(value):
    assert value(text.strip_upload_prefix(text.base_name(F.lit("/a/b/123_x_1.csv")))) == "x_1.csv"
    assert value(text.model_name(F.lit(" \t"), F.lit("Data.CSV"))) == "Data"
    assert value(text.model_name(F.lit(" n "), F.lit("Data.CSV"))) == "n"
    assert value(text.bare_model_id(F.lit("a.pkl.spark"))) == "a"
    assert value(text.bare_model_id(F.lit("a.pkl"))) == "a"
    assert value(text.artifact_key("uploads", F.lit("j"), F.lit("x.csv"))) == "uploads/j/x.csv"


@pytest.mark.parametrize(
    "path, kind, owner",
    [
        ("uploads/j1/a b.csv", "uploads", "j1"),
        ("s3a://bucket/processed/j1.parquet/part-0", "processed", "j1"),
        ("/data/processed/j.1.parquet", "processed", "j.1"),
        ("models/j1.pkl.meta", "models", "j1"),
        ("models/j1.pkl.spark/metadata/part-0", "", ""),
        ("a/models/uploads/j1/x.csv", "uploads", "j1"),
        ("uploads/j1", "", ""),
        ("predictions_output/p1.csv", "predictions_output", "p1"),
        ("predictions_output/predict_id=p1/part-0.csv", "predictions_output", "p1"),
        ("predictions_output/p1.csv/part-0", "predictions_output", "p1"),
        ("s3a://models/uploads", "", ""),
        ("elsewhere/j1", "", ""),
    ],
)
def test_artifact_paths(value, path, kind, owner):
    assert value(text.artifact_kind(F.lit(path))) == kind
    assert value(text.artifact_id(F.lit(path))) == owner


def test_times(value):
    ms, us = "2024-01-02T03:04:05.678Z", "2024-01-02T03:04:05.678901Z"
    assert value(text.parse_time(F.lit(ms)) < text.parse_time(F.lit(us)))
    assert value(text.iso_time(text.parse_time(F.lit(us)))) == us
    assert value(text.parse_time(F.lit("soon"))) is None
    assert value(text.iso_now()).endswith("Z")


def test_ids(value):
    assert value(text.job_id_or_new(F.lit("a"))) == "a"
    fresh = value(text.job_id_or_new(F.lit(""), F.lit("p"), F.lit("t")))
    assert fresh == value(text.stable_id(F.lit("p"), F.lit("t"))) and len(fresh) == 64


def test_decoded_path(value):
    assert value(text.plain_path(text.decoded_path(F.lit("file:/a%20b/c+d%25.csv")))) == "/a b/c+d%.csv"

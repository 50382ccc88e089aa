import pytest

from trellium.functions import feature_lists as fl
from trellium.operators.clean import fold_columns


def test_names_fold_and_clash():
    assert fl.folded_names([" ID ", "Age"]) == ["id", "age"]
    with pytest.raises(fl.SchemaError, match="id"):
        fl.folded_names(["ID", "id"])


def test_fold_columns_of_a_frame(spark):
    assert fold_columns(spark.range(1).toDF(" My Id")).columns == ["my id"]


def test_target_exact_first_then_folded():
    assert fl.require_target(["Price", "price"], "Price") == "Price"
    assert fl.require_target(["price"], " Price ") == "price"
    for bad in (None, "", "cost"):
        with pytest.raises(fl.SchemaError):
            fl.require_target(["price"], bad)


def test_training_and_reported_features_differ_on_a_column_named_label():
    columns = ["id", "label", "price", "prediction", "qty"]
    assert fl.training_features(columns, "price") == ["label", "qty"]
    assert fl.reported_features(columns) == ["price", "qty"]
    with pytest.raises(fl.SchemaError):
        fl.training_features(["id", "price"], "price")


def test_scoring_features():
    columns = ["id", "income_k", "label", "target"]
    assert fl.scoring_features(columns, ["Income_K"], "label") == ["income_k"]
    assert fl.scoring_features(columns, [], "label") == ["income_k", "target"]
    assert fl.scoring_features(columns, None, None) == ["income_k"]
    with pytest.raises(fl.SchemaError, match="sqft"):
        fl.scoring_features(columns, ["sqft"], "label")


def test_prediction_name():
    assert fl.prediction_name(["a"], None) == "prediction"
    assert fl.prediction_name(["a"], "Label") == "label"
    assert fl.prediction_name(["a", "label"], "label") == "label_predicted"

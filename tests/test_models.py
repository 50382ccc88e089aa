import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from trellium.functions.feature_lists import SchemaError
from trellium.operators import models, scoring
from trellium.operators.baselines import MajorityClassifier, MeanRegressor
from trellium.operators.features import Preparation

SMALL = models.TreeParams(trees=3, depth=3, rate=0.5)


def meta(*features):
    return {"target_column": "label", "feature_cols": list(features)}


@pytest.fixture(scope="module")
def table(spark):
    """Label 3a - 2b + 1, classes by a."""
    return spark.range(200).select(
        "id", (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).alias("b")
    ).withColumn("label", 3 * F.col("a") - 2 * F.col("b") + 1)


def test_constants(spark):
    df = spark.createDataFrame([(1.0, "x"), (4.0, "y"), (4.0, "y")], "label double, c string")
    assert MeanRegressor(labelCol="label").fit(df).transform(df).first().prediction == 3.0
    assert MeanRegressor(labelCol="label").fit(df.limit(0)).transform(df).first().prediction == 0.0
    assert MajorityClassifier(labelCol="c").fit(df).transform(df).first().prediction == "y"
    with pytest.raises(ValueError):
        MajorityClassifier(labelCol="c").fit(df.limit(0))


@pytest.mark.parametrize("value, kind", [("x'\"y", "string"), (True, "boolean"), (-7, "bigint"), (0.1, "double")])
def test_constants_keep_the_label_type_through_a_save(spark, tmp_path, value, kind):
    df = spark.createDataFrame([(value, 1)], f"label {kind}, a int")
    fitted = models.fit(df, ["a"], "label", "classification")
    assert fitted.estimator == "majority"
    fitted.model.write().overwrite().save(str(tmp_path / "m"))
    got = scoring.score(PipelineModel.load(str(tmp_path / "m")), df.select("a"), meta("a"))
    assert got.dtypes == [("a", "int"), ("label", kind)] and got.first().label == value


def test_least_squares_finds_the_line(table):
    fitted = models.fit(table, ["a", "b"], "label", "regression", "linear")
    ols = fitted.model.stages[-1]
    assert list(ols.coefficients) == pytest.approx([3, -2]) and ols.intercept == pytest.approx(1)


def test_singular_equations_are_still_solved(table):
    fitted = models.fit(table.withColumn("c", F.col("a") * 2), ["a", "c", "b"], "label", "regression", "linear")
    scored = scoring.score(fitted.model, table.withColumn("c", F.col("a") * 2), meta("a", "c", "b"))
    assert scored.agg(F.max(F.abs(F.col("label") - F.col("label_predicted")))).first()[0] < 1e-3


def test_boosted_regression_learns(table):
    fitted = models.fit(table, ["a", "b"], "label", "regression", "boosted", SMALL)
    assert fitted.estimator == "boosted_regressor"
    scored = scoring.score(fitted.model, table, meta("a", "b"))
    row = scored.agg(F.avg(F.pow(F.col("label") - F.col("label_predicted"), 2)).alias("mse"), F.var_pop("label").alias("v")).first()
    assert row.mse < 0.2 * row.v


@pytest.mark.parametrize(
    "label, name",
    [
        ("if(a > 9, 'high', 'low')", "boosted_classifier"),
        ("a > 9", "boosted_classifier"),
        ("case when a > 13 then 10 when a > 6 then 2 else -1 end", "boosted_one_vs_rest"),
    ],
)
def test_boosted_classes_keep_type_and_survive_a_save(table, tmp_path, label, name):
    df = table.withColumn("label", F.expr(label))
    fitted = models.fit(df, ["a", "b"], "label", "classification", "boosted", SMALL)
    assert fitted.estimator == name
    fitted.model.write().overwrite().save(str(tmp_path / "m"))
    model = PipelineModel.load(str(tmp_path / "m"))
    scored = scoring.score(model, df, meta("a", "b"))
    assert dict(scored.dtypes)["label_predicted"] == dict(df.dtypes)["label"]
    assert set(scored.columns) == {*df.columns, "label_predicted"}
    assert scored.filter("label = label_predicted").count() > 180
    # Neither a missing target nor a label never seen stops the scoring.
    assert scoring.score(model, df.drop("label"), meta("a", "b")).columns[-1] == "label"
    unseen = df.withColumn("label", F.lit("other"))
    assert scoring.score(model, unseen, meta("a", "b")).count() == 200


def test_rule_for_constants(table):
    assert models.fit(table.withColumn("label", F.lit(1.0)), ["a"], "label", "regression").estimator == "mean"
    assert models.fit(table.limit(1), ["a"], "label", "regression").estimator == "mean"
    assert models.fit(table.limit(0), ["a"], "label", "regression").estimator == "mean"
    assert models.fit(table, ["a"], "label", "classification", "constant").estimator == "majority"


def test_null_feature_is_an_error_unless_asked_otherwise(spark, table):
    df = table.withColumn("a", F.when(F.col("id") > 10, F.col("a")))
    with pytest.raises(Exception, match="(?i)null|NaN|invalid"):
        models.fit(df, ["a", "b"], "label", "regression", "linear")
    for prep in (Preparation(invalid="skip"), Preparation(impute="mean", scale=True), Preparation(impute="median")):
        fitted = models.fit(df, ["a", "b"], "label", "regression", "linear", prep=prep)
        scored = scoring.score(fitted.model, df, meta("a", "b"))
        assert set(scored.columns) == {*df.columns, "label_predicted"}


def test_text_feature_needs_encoding(table):
    df = table.withColumn("c", F.when(F.col("a") > 9, "p").otherwise("q"))
    with pytest.raises(SchemaError, match="c"):
        models.fit(df, ["c"], "label", "regression", "linear")
    fitted = models.fit(df, ["c", "b"], "label", "regression", "linear", prep=Preparation(encode=True))
    new = df.withColumn("c", F.lit("never seen"))
    assert scoring.score(fitted.model, new, meta("c", "b")).count() == 200


def test_scoring_replaces_an_incoming_prediction(table):
    fitted = models.fit(table, ["a", "b"], "label", "regression", "linear")
    given = table.withColumn("prediction", F.lit("old")).withColumn("features", F.lit("old")).drop("label")
    got = scoring.score(fitted.model, given, {"feature_cols": ["a", "b"], "target_column": None})
    assert dict(got.dtypes)["prediction"] == "double" and "features" not in got.columns
    with pytest.raises(SchemaError, match="b"):
        scoring.score(fitted.model, table.drop("b"), meta("a", "b"))


@pytest.mark.parametrize("how", ["hash", "stratified", "random"])
def test_every_split_trains(table, how):
    from trellium.plans.train import TrainOptions, train_table

    df = table.withColumn("label", F.expr("if(a > 9, 'high', 'low')"))
    got = train_table(df, "LABEL", "classification", TrainOptions("boosted", SMALL, split=how))
    assert got.holdout and got.n_train + got.n_test == 200 and got.metrics["accuracy"] > 0.9
    assert got.feature_types == {"a": "double", "b": "bigint"}

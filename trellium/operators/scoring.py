"""Scoring with saved models: one table, or many requests at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.ml import PipelineModel
from pyspark.ml.feature import ImputerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellium.functions import text
from trellium.functions.feature_lists import prediction_name, scoring_features
from trellium.operators.features import drop_stage_columns
from trellium.operators.joins import broadcast_if_small, join_hot

SAMPLE_ROWS = 5


def score(model: PipelineModel, df: DataFrame, metadata: Mapping, invalid: str = "error") -> DataFrame:
    """Input columns plus one prediction column. Lazy; the same call serves streams.

    An incoming ``features`` or ``prediction`` column gives way to the model's.
    A null feature is an error, unless the model was trained to accept it; with
    ``invalid="null"`` the row stays and its prediction is null.
    """
    target = metadata.get("target_column")
    features = scoring_features(df.columns, metadata.get("feature_cols"), target)
    ready = df.drop("features", "rawPrediction", "probability", "prediction")
    name = prediction_name(ready.columns, target)
    lenient = invalid == "null" and _rejects_nulls(model)
    if lenient:
        model = PipelineModel(stages=[_keeping_nulls(s) for s in model.stages])
    scored = drop_stage_columns(model.transform(ready)).drop("prediction__code", "prediction__text")
    if lenient:
        whole = reduce(and_, [F.col(f"`{c}`").isNotNull() for c in features])
        scored = scored.withColumn("prediction", F.when(whole, F.col("prediction")))
    return scored.withColumnRenamed("prediction", name) if name != "prediction" else scored


def _rejects_nulls(model: PipelineModel) -> bool:
    stages = model.stages
    strict = any(isinstance(s, VectorAssembler) and s.getHandleInvalid() == "error" for s in stages)
    return strict and not any(isinstance(s, ImputerModel) for s in stages)


def _keeping_nulls(stage):
    return stage.copy({stage.handleInvalid: "keep"}) if isinstance(stage, VectorAssembler) else stage


def match_models(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests with their model's metadata; ``error`` names what no model answers to.

    The registry holds one row per model; many requests may name the same one.
    """
    asked = requests.withColumn("model_id", text.bare_model_id("model_id"))
    found = registry.withColumnRenamed("task_type", "_task").withColumn("_found", F.lit(True))
    given = F.col("model_type") if "model_type" in requests.columns else F.lit(None).cast("string")
    joined = join_hot(asked, found.drop("model_type", "updated_at"), "model_id", "left")
    return joined.withColumns(
        {
            "task_type": text.task_type(F.col("_task"), given),
            "error": F.when(F.col("_found").isNull(), F.concat(F.lit("No model found for ID "), F.col("model_id"))),
        }
    ).drop("_task", "_found")


def unmatched(requests: DataFrame, registry: DataFrame) -> DataFrame:
    asked = requests.withColumn("model_id", text.bare_model_id("model_id"))
    return asked.join(registry.select("model_id"), "model_id", "left_anti")


def score_constants(rows: DataFrame, constants: DataFrame, key: str = "model_id") -> DataFrame:
    """Score rows of many constant models in one join: ``constants`` has ``key, prediction``, one row per key.

    Few constants are broadcast, so the rows are neither shuffled nor sorted by
    their model; with more than ``SMALL_ROWS`` hot models are dealt into shares.
    """
    ready, few = rows.drop("prediction"), broadcast_if_small(constants)
    return join_hot(ready, constants, key, "left") if few is constants else ready.join(few, key, "left")


def sample_rows(scored: DataFrame, by: Sequence[str], order_by: Sequence[str], n: int = SAMPLE_ROWS) -> DataFrame:
    """First ``n`` rows per group; every task keeps n per group before the shuffle."""
    order = Window.partitionBy(*by).orderBy(*order_by)
    return scored.withColumn("sample_no", F.row_number().over(order)).filter(F.col("sample_no") <= n)


def top_rows(scored: DataFrame, order_by: Sequence[str], n: int = SAMPLE_ROWS) -> DataFrame:
    """First ``n`` rows of a table: a top-k, not a sort."""
    return scored.orderBy(*order_by).limit(n)


def as_results(samples: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Numbered sample rows to one ordered JSON list per key."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))
    return (
        samples.select(key, "sample_no", row.alias("row"))
        .groupBy(key)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("sample_no", "row"))), lambda r: r["row"]
            ).alias("sample_predictions")
        )
    )


def summarise(
    scored: DataFrame,
    order_by: Sequence[str],
    key: str = "predict_id",
    mode: str = "spark",
    n: int = SAMPLE_ROWS,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Per request: ``n_rows, columns, prediction_mode, sample_predictions`` (JSON, in order)."""
    shown = [c for c in scored.columns if c != key]
    counts = scored.groupBy(key).agg(F.count("*").alias("n_rows"), *extra)
    samples = as_results(sample_rows(scored, [key], order_by, n), key, shown)
    return counts.join(samples, key, "left").withColumns(
        {"columns": F.array(*[F.lit(c) for c in shown]), "prediction_mode": F.lit(mode)}
    )

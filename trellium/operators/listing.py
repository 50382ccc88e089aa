"""Catalog queries: model listing and detail, job and prediction status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.functions import text
from trellium.operators.validate import owned_by


def model_listing(jobs: DataFrame, models: DataFrame, user_id: str | None = None) -> DataFrame:
    """Jobs that have a model, newest first. Owner and time come from ``jobs``."""
    mine = jobs if user_id is None else owned_by(jobs, user_id)
    return (
        mine.join(models.select("job_id", "model_path"), "job_id")
        .select("job_id", "model_name", "task_type", "user_id", "created_at", "model_path")
        .orderBy(F.desc("created_at"), "job_id")
    )


def model_detail(
    jobs: DataFrame,
    models: DataFrame,
    registry: DataFrame,
    job_id: str | None = None,
    user_id: str | None = None,
) -> DataFrame:
    """Listing rows with target and features from the registry; null and empty when unknown."""
    mine = jobs if user_id is None else owned_by(jobs, user_id)
    if job_id is not None:
        mine = mine.filter(F.col("job_id") == job_id)
    known = registry.select(F.col("model_id").alias("job_id"), "target_column", "feature_cols")
    return (
        mine.drop("target_column")
        .join(models.select("job_id", "model_path"), "job_id")
        .join(known, "job_id", "left")
        .select(
            "job_id",
            "model_name",
            "task_type",
            "created_at",
            "model_path",
            "target_column",
            F.coalesce("feature_cols", F.array().cast("array<string>")).alias("feature_cols"),
        )
    )


def progress(models: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``job_id, rank, has_model``: how far each job's traces go. Folds map-side."""
    # No filter on what was parsed: it would parse twice, and stray ids meet no job.
    found = artifacts.select(text.artifact("path").alias("a")).select(
        F.col("a.id").alias("job_id"),
        text.artifact_rank(F.col("a.kind")).alias("rank"),
        F.lit(False).alias("model"),
    )
    done = models.select("job_id", F.lit(max(text.STATUS_BY_RANK)).alias("rank"), F.lit(True).alias("model"))
    return done.unionByName(found).groupBy("job_id").agg(
        F.max("rank").alias("rank"), F.bool_or("model").alias("has_model")
    )


def job_status(jobs: DataFrame, models: DataFrame, artifacts: DataFrame, user_id: str | None = None) -> DataFrame:
    """Status of every job: a model row or model artifact means completed, then training, ingested, queued."""
    mine = jobs if user_id is None else owned_by(jobs, user_id)
    return (
        mine.select("job_id")
        .join(progress(models, artifacts), "job_id", "left")
        .select(
            "job_id",
            text.status_name("rank").alias("status"),
            F.coalesce("has_model", F.lit(False)).alias("model_file"),
        )
    )


def predict_status(requests: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``ready`` once the request's output exists, else ``pending``."""
    outputs = (
        artifacts.select(text.artifact("path").alias("a"))
        .filter(F.col("a.kind") == "predictions_output")
        .select(F.col("a.id").alias("predict_id"))
        .distinct()
        .withColumn("_out", F.lit(True))
    )
    return (
        requests.select("predict_id")
        .join(outputs, "predict_id", "left")
        .select("predict_id", F.when(F.col("_out"), "ready").otherwise("pending").alias("status"))
    )

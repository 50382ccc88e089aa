"""Upload requests checked in bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.functions import text

# Rejection reasons, in the order they are tested.
NO_FILE = "Missing CSV file."
NOT_CSV = "Only .csv files are supported."
NO_HEADER = "CSV header row is missing or could not be parsed."
NO_TARGET = "Missing target column."
NO_FEATURE = "CSV must contain at least one feature column besides the target column."


def with_verdict(requests: DataFrame) -> DataFrame:
    """Add ``reason`` (null when accepted) and the normalised request fields.

    ``requests`` has ``filename, model_name, target_column, task_type`` and
    ``columns``, the header of the file (null or empty when there is none).
    """
    target = text.none_if_blank("target_column")
    header = F.coalesce(F.col("columns"), F.array().cast("array<string>"))
    others = F.filter(header, lambda c: c != target)
    reason = (
        F.when(text.none_if_blank("filename").isNull(), NO_FILE)
        .when(~text.is_csv_name("filename"), NOT_CSV)
        .when(F.size(header) == 0, NO_HEADER)
        .when(target.isNull(), NO_TARGET)
        .when(
            ~F.array_contains(header, target),
            F.concat(F.lit("Target column '"), target, F.lit("' was not found in the CSV header.")),
        )
        .when(F.size(others) == 0, NO_FEATURE)
    )
    kind = F.when(F.lower("task_type") == "regression", "regression").otherwise("classification")
    return requests.withColumns(
        {
            "reason": reason,
            "model_name": text.model_name("model_name", "filename"),
            "target_column": target,
            "task_type": kind,
        }
    )


def split_verdict(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected requests."""
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(
        F.col("reason").isNotNull()
    )


def owned_by(df: DataFrame, user_id: str) -> DataFrame:
    return df.filter(F.col("user_id") == user_id)

"""Model registry: one metadata row per model."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellium.functions.text import base_name, decoded_path
from trellium.operators.merge import merge_replace, with_columns_if_absent
from trellium.sources.folders import read_table, write_file, write_table

METADATA = T.StructType(
    [
        T.StructField("model_type", T.StringType()),
        T.StructField("spark_path", T.StringType()),
        T.StructField("feature_cols", T.ArrayType(T.StringType())),
        T.StructField("task_type", T.StringType()),
        T.StructField("target_column", T.StringType()),
    ]
)

REGISTRY = T.StructType(
    [
        T.StructField("model_id", T.StringType(), False),
        *METADATA.fields,
        T.StructField("feature_types", T.MapType(T.StringType(), T.StringType())),
        T.StructField("estimator", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("reason", T.StringType()),
    ]
)


def read_metadata_files(spark: SparkSession, path: str) -> DataFrame:
    """Metadata JSON files as registry rows; the id is the file name up to ``.pkl``."""
    raw = spark.read.schema(METADATA).option("multiLine", True).json(path)
    return raw.select(
        F.regexp_replace(base_name(decoded_path("_metadata.file_path")), r"\.pkl\.meta$|\.meta$", "").alias("model_id"),
        *[F.col(f.name) for f in METADATA.fields],
    )


def write_metadata_file(spark: SparkSession, path: str, **fields: object) -> None:
    """The metadata of one model as a JSON file; ``fields`` are those of ``METADATA``."""
    write_file(spark, path, json.dumps({f.name: fields.get(f.name) for f in METADATA.fields}))


def with_metadata_files(registry: DataFrame, files: DataFrame) -> DataFrame:
    """The registry as the metadata files beside the models have it.

    A field that a file gives counts before the registry's; a model that only has a
    file is a row of its own. One row per model on either side.
    """
    given = files.select(F.col("model_id").alias("_id"), *[F.col(f.name).alias(f"_{f.name}") for f in METADATA.fields])
    both = registry.join(given, F.col("model_id") == F.col("_id"), "full_outer")
    names = {f.name for f in METADATA.fields}
    return both.select(
        F.coalesce("model_id", "_id").alias("model_id"),
        *[F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in registry.columns if c != "model_id"],
    )


def registry_row(
    model_id: str,
    *,
    spark_path: str,
    feature_cols: Sequence[str],
    feature_types: Mapping[str, str],
    task_type: str,
    target_column: str,
    estimator: str,
    reason: str | None = None,
) -> tuple:
    """Values of one row, in the order of ``REGISTRY``; ``reason`` says why it isn't the estimator asked for."""
    return (
        model_id,
        "spark_mllib",
        spark_path,
        list(feature_cols),
        task_type,
        target_column,
        dict(feature_types),
        estimator,
        datetime.now(timezone.utc),
        reason,
    )


def save_rows(rows: DataFrame, root: str) -> None:
    """Merge rows by model id into the registry table; a re-trained model replaces its row."""
    current = read_table(rows.sparkSession, root)
    write_table(rows if current is None else merge_replace(current, rows, "model_id"), root)


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    current = read_table(spark, root)
    if current is None:
        return spark.createDataFrame([], REGISTRY)
    return with_columns_if_absent(current, {f.name: f.dataType.simpleString() for f in REGISTRY.fields})


def lookup(spark: SparkSession, root: str, model_id: str) -> dict | None:
    """Metadata of one model; the filter is pushed to the scan and one row comes back."""
    rows = read_registry(spark, root).filter(F.col("model_id") == model_id).take(1)
    return rows[0].asDict(recursive=True) if rows else None

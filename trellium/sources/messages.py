"""Stage messages: schemas, scans and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellium.functions.rows import row_pick, unpack
from trellium.functions.text import iso_time, parse_time

_TEXTS = T.ArrayType(T.StringType())


def _schema(text: str, **others: T.DataType) -> T.StructType:
    fields = [T.StructField(n, T.StringType()) for n in text.split()]
    fields += [T.StructField(n, t) for n, t in others.items()]
    return T.StructType(fields)


# Field names of the stage messages.
SCHEMAS: dict[str, T.StructType] = {
    "upload_request": _schema(
        "job_id model_name csv_path s3_csv_key filename task_type model_type target_column timestamp"
    ),
    "dataset_uploaded": _schema(
        "job_id uploader csv_path s3_csv_key task_type model_type target_column timestamp raw_preview",
        row_count=T.LongType(),
        column_count=T.LongType(),
        columns=_TEXTS,
        preview=T.ArrayType(_TEXTS),
    ),
    "preprocess": _schema(
        "job_id processed_path s3_processed_path task_type model_type target_column timestamp",
        n_rows=T.LongType(),
        features=_TEXTS,
    ),
    "train": _schema(
        "job_id model_path s3_model_path model_type target_column training_mode timestamp",
        feature_cols=_TEXTS,
        metrics=T.MapType(T.StringType(), T.DoubleType()),
    ),
    "predict_request": _schema("predict_id csv_path s3_csv_key model_id model_type timestamp"),
    "predict": _schema(
        "model_id csv_path model_type timestamp output_csv",
        result=T.StructType(
            [
                T.StructField("n_rows", T.LongType()),
                T.StructField("columns", _TEXTS),
                T.StructField("prediction_mode", T.StringType()),
                T.StructField("sample_predictions", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
            ]
        ),
    ),
}


def read_messages(
    spark: SparkSession, kind: str, path: str, one_object_per_file: bool = True
) -> DataFrame:
    """Messages of a kind; absent fields are null.

    Hand-made messages are pretty-printed, one object per file. What
    ``write_messages`` writes holds one object per line and splits.
    """
    return (
        spark.read.schema(SCHEMAS[kind])
        .option("multiLine", one_object_per_file)
        .option("mode", "PERMISSIVE")
        .json(path)
    )


def to_messages(df: DataFrame, kind: str) -> DataFrame:
    """Project to the fields of a kind, null where the frame lacks one; times become ISO text."""
    have = dict(df.dtypes)

    def field(f: T.StructField) -> Column:
        if f.name not in have:
            return F.lit(None).cast(f.dataType)
        if have[f.name] == "timestamp":
            return iso_time(f.name)
        return F.col(f.name).cast(f.dataType)

    return df.select(*[field(f).alias(f.name) for f in SCHEMAS[kind].fields])


def write_messages(df: DataFrame, kind: str, path: str, mode: str = "append") -> None:
    """One JSON line per message; the next stage streams the folder."""
    to_messages(df, kind).write.mode(mode).json(path)


def latest_per_key(df: DataFrame, key: str = "job_id", time: str = "timestamp") -> DataFrame:
    """Newest message per key. Copies fold map-side, so a key sent often costs no more.

    Equal times are settled by the remaining fields, so the result repeats.
    """
    at = parse_time(time) if dict(df.dtypes)[time] == "string" else F.col(time)
    newest = row_pick(df, "max", [time], at).alias("m")
    return df.groupBy(F.col(key).alias("_key")).agg(newest).select(*unpack("m", df.columns))

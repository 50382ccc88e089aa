"""Scoring files as they arrive: of one known header as a plain stream, of any header by micro-batch."""

from __future__ import annotations

from collections.abc import Mapping
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from trellium.functions.feature_lists import SchemaError, folded_names, scoring_features
from trellium.operators.scoring import score
from trellium.sources.csv import cast_features, first_line, header_fields, read_scoring_csv
from trellium.streaming.messages import Step, batch_folder


def scoring_stream(
    spark: SparkSession, path: str, columns: list[str], feature_types: Mapping[str, str], max_files: int | None = None
) -> DataFrame:
    """New CSV files with the given header, features cast to the model's types."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.readStream.schema(schema).option("header", True).option("escape", '"').option("enforceSchema", False)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = reader.csv(path)
    return cast_features(raw.toDF(*folded_names(raw.columns)), feature_types)


def score_stream(
    stream: DataFrame,
    model: PipelineModel,
    metadata: Mapping,
    out: str,
    checkpoint: str,
    once: bool = True,
    interval: str = "10 seconds",
    file_format: str = "parquet",
    invalid: str = "null",
) -> StreamingQuery:
    """Append scored rows; the file sink's log keeps each micro-batch exactly once.

    A row that cannot be scored goes on with a null prediction, unless
    ``invalid="error"`` is to stop the stream.
    """
    writer = (
        score(model, stream, metadata, invalid)
        .writeStream.format(file_format)
        .option("header", True)
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def arriving_files(spark: SparkSession, path: str, max_files: int | None = None, pattern: str = "*.csv") -> DataFrame:
    """``path, length`` of files as they arrive, whatever their header; their content isn't read."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select("path", "length")


# First lines fetched side by side.
HEADER_THREADS = 16
QUARANTINE = "path string, reason string"


def route_step(model: PipelineModel, metadata: Mapping, feature_types: Mapping[str, str], out: str, quarantine: str, invalid: str = "null") -> Step:
    """Score a micro-batch of files, each by its own header.

    Files of one header, in whatever order its columns stand, are scored by one
    scan; the loop runs over headers. A file that lacks a feature, has no header or
    is gone goes to the quarantine with the reason, and the others go on. Output
    and quarantine lie under the batch's name, so a replay overwrites them.
    """

    def step(batch: DataFrame, batch_id: int | str) -> None:
        spark = batch.sparkSession

        def header(path: str) -> tuple[str, ...] | str:
            try:
                line, _ = first_line(spark, path)
                if line is None:
                    raise SchemaError("the file has no header")
                columns = folded_names(header_fields(line))
                if "cast_failures" in columns:
                    raise SchemaError("column name cast_failures is taken by the count of unreadable values")
                scoring_features(columns, metadata.get("feature_cols"), metadata.get("target_column"))
                return tuple(columns)
            except (SchemaError, OSError) as error:
                return str(error)

        paths = sorted(r.path for r in batch.select("path").distinct().collect())  # those of one micro-batch
        with ThreadPool(HEADER_THREADS) as pool:
            found = dict(zip(paths, pool.map(header, paths)))
        layouts: dict[tuple[str, ...], list[str]] = {}
        for path, columns in found.items():
            if isinstance(columns, tuple):
                layouts.setdefault(columns, []).append(path)
        for number, (columns, files) in enumerate(sorted(layouts.items())):
            scored = score(model, read_scoring_csv(spark, files, feature_types), metadata, invalid)
            scored.write.mode("overwrite").parquet(f"{batch_folder(out, batch_id)}/layout-{number:04d}")
        bad = [(path, reason) for path, reason in found.items() if isinstance(reason, str)]
        spark.createDataFrame(bad, QUARANTINE).write.mode("overwrite").json(batch_folder(quarantine, batch_id))

    return step


def read_routed(spark: SparkSession, out: str) -> DataFrame:
    """Scored rows of all batches and headers; a column that a file lacked is null."""
    return spark.read.option("mergeSchema", True).parquet(f"{out}/batch-*/layout-*")

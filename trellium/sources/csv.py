"""CSV and Parquet scans and writes."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellium.functions.feature_lists import SchemaError, fold, folded_names

Paths = str | Sequence[str]
# RFC 4180 quoting: a quote inside a field is doubled.
_QUOTING = {"quote": '"', "escape": '"'}


def _paths(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_training_csv(
    spark: SparkSession,
    paths: Paths,
    schema: T.StructType | None = None,
    sampling_ratio: float | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Training tables with a header. Pass ``schema`` on repeat reads to scan once.

    ``multi_line`` admits quoted line breaks, at the price of one task per file.
    """
    reader = spark.read.option("header", True).options(**_QUOTING).option("multiLine", multi_line)
    if schema is not None:
        return reader.schema(schema).csv(_paths(paths))
    reader = reader.option("inferSchema", True)
    if sampling_ratio is not None:
        reader = reader.option("samplingRatio", sampling_ratio)
    return reader.csv(_paths(paths))


def read_scoring_csv(
    spark: SparkSession,
    paths: Paths,
    feature_types: Mapping[str, str],
    multi_line: bool = False,
    keep_path: bool = False,
    keep_text: bool = False,
) -> DataFrame:
    """Scoring tables: every column by its header, features cast to the given types.

    A value that does not fit its type becomes null and is counted per row in
    ``cast_failures``. Columns that are no features stay text. ``keep_path`` adds
    ``__source_file`` (as Spark spells it), and ``__source_block`` and ``__source_row``, which order the rows
    of a file; ``keep_text`` adds each cast column's text as ``<name>__text``.
    """
    raw = (
        spark.read.option("header", True)
        .options(**_QUOTING)
        .option("multiLine", multi_line)
        .csv(_paths(paths))
    )
    raw = raw.toDF(*folded_names(raw.columns))
    if keep_path:
        raw = raw.withColumns(
            {
                "__source_file": F.col("_metadata.file_path"),
                "__source_block": F.col("_metadata.file_block_start"),
                "__source_row": F.monotonically_increasing_id(),
            }
        )
    return cast_features(raw, feature_types, keep_text)


# SQL types that a model reads as a number.
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def scoring_types(feature_types: Mapping[str, str]) -> dict[str, str]:
    """Types to cast to before scoring: a whole number in training may be a fraction now."""
    return {c: "double" if t.split("(")[0] in _NUMBERS else t for c, t in feature_types.items()}


def cast_features(df: DataFrame, feature_types: Mapping[str, str], keep_text: bool = False) -> DataFrame:
    """``try_cast`` the known feature columns and count what did not fit."""
    if "cast_failures" in df.columns:
        raise SchemaError("column name cast_failures is taken by the count of unreadable values")
    wanted = {fold(name): kind for name, kind in feature_types.items()}
    bad = F.lit(0)
    columns = []
    for name in df.columns:
        source = F.col(f"`{name}`")
        if name in wanted:
            value = source.try_cast(wanted[name])
            bad = bad + F.when(source.isNotNull() & value.isNull(), 1).otherwise(0)
            columns.append(value.alias(name))
            if keep_text:
                columns.append(source.alias(f"{name}__text"))
        else:
            columns.append(source)
    return df.select(*columns, bad.alias("cast_failures"))


def restore_text(df: DataFrame) -> DataFrame:
    """Put the text kept by ``keep_text`` back in place of the cast columns."""
    kept = {c.removesuffix("__text") for c in df.columns if c.endswith("__text")}
    return df.select(
        *[
            F.col(f"`{c}__text`").alias(c) if c in kept else F.col(f"`{c}`")
            for c in df.columns
            if not c.endswith("__text")
        ]
    )


def write_csv(df: DataFrame, path: str, header: bool = True, partition_by: Sequence[str] = ()) -> None:
    """Distributed CSV write; one part file per task and partition value."""
    writer = df.write.mode("overwrite").option("header", header).options(**_QUOTING)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


# Bytes of a header line at most.
HEADER_BYTES = 1 << 20


def first_line(spark: SparkSession, path: str) -> tuple[str | None, bool]:
    """First line with text of a file, or of a folder's first file that has one, and whether the path is a folder.

    The driver reads one buffer of the file; no job runs. None without such a line.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(conf)
    found = fs.globStatus(jpath)
    if not found:
        raise FileNotFoundError(f"[PATH_NOT_FOUND] Path does not exist: {path}")
    folder = len(found) == 1 and found[0].isDirectory()
    files = [s for status in found for s in (fs.listStatus(status.getPath()) if status.isDirectory() else [status])]
    shown = [s.getPath() for s in files if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    for file in sorted(shown, key=lambda f: f.toString()):
        stream = fs.open(file)
        try:
            codec = codecs.getCodec(file)
            reader = jvm.org.apache.hadoop.util.LineReader(codec.createInputStream(stream) if codec else stream, conf)
            line = jvm.org.apache.hadoop.io.Text()
            while reader.readLine(line, HEADER_BYTES, HEADER_BYTES) > 0:
                text = line.toString().removeprefix("\ufeff")
                if text.strip():
                    return text, folder
        finally:
            stream.close()
    return None, folder


def header_fields(line: str) -> list[str]:
    """Column names as Spark's reader gives them: empty and repeated ones are told apart by their place."""
    fields = next(csv.reader([line], doublequote=True), [])
    lower = [f.lower() for f in fields]
    return [
        f"_c{i}" if not f else f"{f}{i}" if lower.count(f.lower()) > 1 else f for i, f in enumerate(fields)
    ]


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Folded column names of a file or folder; only the first line is read."""
    line, _ = first_line(spark, path)
    return folded_names(header_fields(line)) if line else []


def read_parquet(spark: SparkSession, paths: Paths) -> DataFrame:
    return spark.read.parquet(*_paths(paths))


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_scoring_table(spark: SparkSession, path: str, feature_types: Mapping[str, str]) -> DataFrame:
    """CSV or Parquet by the path's ending, with the text of cast columns kept beside them."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        return cast_features(df.toDF(*folded_names(df.columns)), feature_types, keep_text=True)
    return read_scoring_csv(spark, path, feature_types, keep_text=True)

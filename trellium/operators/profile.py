"""CSV profiles of many files at once: counts, header, first rows, header vote.

A data set is a file, or a folder of part files. Files are read as lines and
split like any text, so one huge file is spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellium.functions.csv_text import csv_fields, header_names, looks_numeric
from trellium.functions.text import decoded_path, parent_folder
from trellium.operators.blocks import fold_blocks, scan_records, settle_blocks
from trellium.sources.csv import Paths, _paths
from trellium.sources.folders import work_table

# Rows shown, and rows the header vote looks at besides the first.
PREVIEW_ROWS = 10
VOTE_ROWS = 21
RECORD_PREVIEW_ROWS = 5
RAW_PREVIEW_LINES = 8


def dataset_of(path: Column, unit: str) -> Column:
    """The data set a file belongs to: itself, or its folder."""
    return path if unit == "file" else parent_folder(path)


def read_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """``file, block, whole_file, seq, value``: physical lines, in order by (file, block, seq)."""
    return spark.read.text(_paths(paths), recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        (F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")).alias("whole_file"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value"),
    )


def _with_dataset(df: DataFrame, unit: str) -> DataFrame:
    return df.withColumn("dataset", dataset_of(decoded_path("file"), unit))


def count_lines(blocks: DataFrame, unit: str = "file") -> DataFrame:
    """``dataset, n_lines`` from folded blocks; paths are taken apart once per file."""
    files = blocks.groupBy("file").agg(F.sum("n_lines").alias("n"))
    return _with_dataset(files, unit).groupBy("dataset").agg(F.sum("n").alias("n_lines"))


def list_files(spark: SparkSession, paths: Paths) -> DataFrame:
    """``file, n_bytes`` of every file; only file metadata is read. Spark lists no empty file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_paths(paths))
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("n_bytes"))


def list_datasets(spark: SparkSession, paths: Paths, unit: str = "file") -> DataFrame:
    """Data sets with their size: join from the requests' side to see those with nothing in them."""
    return _with_dataset(list_files(spark, paths), unit).groupBy("dataset").agg(
        F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_files")
    )


def _counts(blocks: DataFrame, unit: str) -> DataFrame:
    """``dataset, n_records, n_lines``; a file that stops inside quotes still holds that last record."""
    files = settle_blocks(blocks).groupBy("file").agg(
        F.sum("ends").alias("ends"), F.sum("n_lines").alias("n_lines"), F.max_by("leaves", "block").alias("leaves")
    )
    return _with_dataset(files, unit).groupBy("dataset").agg(
        F.sum(F.col("ends") + F.col("leaves")).alias("n_records"), F.sum("n_lines").alias("n_lines")
    )


def _heads(blocks: DataFrame, n: int, unit: str, headers_in_parts: bool) -> DataFrame:
    """``dataset, records, lines, readable`` from folded blocks.

    Narrow rows tell which blocks hold the first ``n`` records; only the lines of
    these are gathered, a few for each data set.
    """
    settled = settle_blocks(blocks)
    files = settled.groupBy("file").agg(
        (F.sum("ends") + F.max_by("leaves", "block")).alias("n"), F.max("block").alias("last")
    )
    opening = blocks.where("block = 0").select("file", F.xxhash64("first").alias("first"))
    by_dataset = Window.partitionBy("dataset").orderBy("file")
    ranked = _with_dataset(files.join(opening, "file"), unit).withColumn("nth", F.row_number().over(by_dataset)).withColumn(
        "header", F.first("first").over(by_dataset.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    skip = (F.col("nth") > 1) & (F.col("first") == F.col("header")) if headers_in_parts else F.lit(False)
    own = ranked.withColumn("skip", skip).withColumn("own", F.col("n") - F.col("skip").cast("int"))
    so_far = F.sum("own").over(by_dataset.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("own")
    wanted = own.withColumn("earlier", so_far).where(F.col("earlier") < n).select("dataset", "file", "last", "skip", "earlier")
    # Records that end before a block, in its file and in files before; a repeated header isn't one of them.
    near = settled.select("file", "block", "before").join(wanted, "file").where(F.col("earlier") + F.col("before") - F.col("skip").cast("int") < n)
    parts = near.join(blocks.select("file", "block", "head", "actions", "whole"), ["file", "block"])
    part = F.struct(
        "file", "block", "head", "actions", "whole", (F.col("block") == F.col("last")).alias("last"),
        (F.col("skip") & (F.col("block") == 0)).alias("skip"),
    )
    gathered = parts.groupBy("dataset").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return scan_records(gathered, n)


def first_records(lines: DataFrame, n: int, unit: str = "file", headers_in_parts: bool = False) -> DataFrame:
    """First ``n`` records per data set: ``dataset, records, lines, readable``.

    One scan. A record may be as long as ``blocks.RECORD_BYTES``; a data set whose
    first one isn't closed by then is not ``readable`` and has no records.
    """
    return _heads(work_table(fold_blocks(lines, n), "blocks"), n, unit, headers_in_parts)


def header_votes(heads: DataFrame) -> DataFrame:
    """``dataset, has_header``: is the first record unlike the ones below it?

    A column whose body is all numbers, or all of one length, votes for a header
    if the first record breaks the pattern and against one if it keeps it. Rows
    with another field count are passed over; one column alone has no vote.
    """
    rows = heads.select("dataset", F.posexplode(F.slice("records", 1, VOTE_ROWS + 1)).alias("row", "record"))
    cells = rows.withColumn("fields", csv_fields(F.col("record")))
    first = F.col("row") == 0
    width = F.max(F.when(first, F.size("fields"))).over(Window.partitionBy("dataset"))
    cells = (
        cells.withColumn("width", width)
        .filter((F.size("fields") == F.col("width")) & (F.col("width") > 1))
        .select("dataset", first.alias("first"), F.posexplode("fields").alias("column", "cell"))
    )
    kind = F.when(looks_numeric(F.col("cell")), F.lit(-1)).otherwise(F.length("cell"))
    cells = cells.withColumn("kind", kind)
    body = F.when(~F.col("first"), F.col("kind"))
    per_column = cells.groupBy("dataset", "column").agg(
        F.min(body).alias("low"),
        F.max(body).alias("high"),
        F.max(F.when(F.col("first"), F.col("kind"))).alias("top"),
        F.max(F.when(F.col("first"), F.length("cell"))).alias("top_length"),
    )
    alike = F.when(F.col("low") == -1, F.col("top") == -1).otherwise(F.col("top_length") == F.col("low"))
    vote = F.when(F.col("low").isNull() | (F.col("low") != F.col("high")), 0).when(alike, -1).otherwise(1)
    votes = per_column.groupBy("dataset").agg((F.sum(vote) > 0).alias("has_header"))
    return heads.select("dataset").join(votes, "dataset", "left").select(
        "dataset", F.coalesce("has_header", F.lit(False)).alias("has_header")
    )


def profile_files(
    spark: SparkSession, paths: Paths, unit: str = "file", headers_in_parts: bool = False
) -> DataFrame:
    """Per data set: ``row_count, column_count, columns, preview, has_header, header``.

    Rows are physical lines, less the header line if the vote found one; blank
    lines count, and a quoted line break makes two lines. ``columns`` and the
    preview follow the vote; ``header`` holds the names of the first record
    whatever the vote says. ``headers_in_parts``: each part file of a folder
    repeats the header, so one line per part is taken off. A data set whose first
    record is too long to be read is not ``readable`` and has no header. The input
    is read once.
    """
    blocks = work_table(fold_blocks(read_lines(spark, paths), VOTE_ROWS + 1), "blocks")
    counts = count_lines(blocks, unit)
    heads = work_table(_heads(blocks, VOTE_ROWS + 1, unit, headers_in_parts), "heads")
    fields = heads.select(
        "dataset",
        "readable",
        F.transform(F.slice("records", 1, PREVIEW_ROWS), csv_fields).alias("rows"),
        header_names(F.coalesce(F.get("records", F.lit(0)), F.lit(""))).alias("header"),
    )
    listed = list_datasets(spark, paths, unit)
    joined = (
        listed.join(counts, "dataset", "left").join(fields, "dataset", "left").join(header_votes(heads), "dataset", "left")
    )
    none = F.array().cast("array<string>")
    has = F.coalesce("has_header", F.lit(False))
    n_headers = F.col("n_files") if headers_in_parts else F.lit(1)
    n_lines = F.coalesce("n_lines", F.lit(0))
    rows = F.coalesce("rows", F.array().cast("array<array<string>>"))
    columns = F.when(has, F.coalesce(F.get(rows, F.lit(0)), none)).otherwise(none)
    return joined.select(
        "dataset",
        F.when(has, n_lines - n_headers).otherwise(n_lines).alias("row_count"),
        F.size(columns).cast("long").alias("column_count"),
        columns.alias("columns"),
        F.when(has, F.slice(rows, 2, PREVIEW_ROWS)).otherwise(rows).alias("preview"),
        has.alias("has_header"),
        F.coalesce("header", none).alias("header"),
        n_lines.alias("n_lines"),
        F.coalesce("readable", F.lit(True)).alias("readable"),
    )


def count_records(lines: DataFrame, unit: str = "file") -> DataFrame:
    """``dataset, n_records, n_lines``: records where quoted fields may hold line breaks.

    Each task folds the blocks it reads; only a row per block is shuffled.
    """
    return _counts(fold_blocks(lines), unit)


def profile_records(
    spark: SparkSession, paths: Paths, unit: str = "file", headers_in_parts: bool = False
) -> DataFrame:
    """Record-based profile: the first record is the header, 5 rows, first 8 lines as text."""
    n = max(RECORD_PREVIEW_ROWS + 1, RAW_PREVIEW_LINES)
    blocks = work_table(fold_blocks(read_lines(spark, paths), n), "blocks")
    heads = _heads(blocks, n, unit, headers_in_parts)
    fields = heads.select(
        "dataset",
        F.transform(F.slice("records", 1, RECORD_PREVIEW_ROWS + 1), csv_fields).alias("rows"),
        F.array_join(F.slice("lines", 1, RAW_PREVIEW_LINES), "\n").alias("raw_preview"),
    )
    joined = (
        list_datasets(spark, paths, unit)
        .join(_counts(blocks, unit), "dataset", "left")
        .join(fields, "dataset", "left")
    )
    none = F.array().cast("array<string>")
    columns = F.coalesce(F.get("rows", F.lit(0)), none)
    n_records = F.coalesce("n_records", F.lit(0))
    n_headers = F.col("n_files") if headers_in_parts else F.lit(1)
    return joined.select(
        "dataset",
        F.when(F.size(columns) > 0, n_records - n_headers).otherwise(n_records).alias("row_count"),
        F.size(columns).cast("long").alias("column_count"),
        columns.alias("columns"),
        F.slice(F.coalesce("rows", F.array().cast("array<array<string>>")), 2, RECORD_PREVIEW_ROWS).alias("preview"),
        F.coalesce("raw_preview", F.lit("")).alias("raw_preview"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        "n_files",
    )

"""Scoring requests: one at a time, or a table of them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellium.functions.feature_lists import SchemaError, folded_names, prediction_name, scoring_features
from trellium.functions.text import decoded_path, iso_now, plain_path
from trellium.operators.joins import broadcast_if_small
from trellium.operators.profile import dataset_of, list_files
from trellium.operators.scoring import as_results, match_models, sample_rows, score
from trellium.plans.train import Layout
from trellium.sources.csv import (
    first_line,
    header_fields,
    read_scoring_csv,
    read_scoring_table,
    restore_text,
    scoring_types,
    write_csv,
)
from trellium.sources.folders import delete_path
from trellium.sources.messages import write_messages
from trellium.sources.places import csv_places, resolve_all
from trellium.sources.registry import lookup, read_registry

# Requests served by one scan.
FILES_PER_SCAN = 1000
# First lines fetched side by side, by the driver: no job runs for a file.
HEADER_THREADS = 16


class NoModelError(LookupError):
    """No model answers to the id."""


def bare_id(model_id: str) -> str:
    return model_id.replace(".pkl.spark", "").replace(".pkl", "")


def predict_file(
    spark: SparkSession, layout: Layout, model_id: str, path: str, invalid: str = "error"
) -> DataFrame:
    """Scored rows of one table, lazily; ``cast_failures`` counts values that did not fit their type."""
    meta = lookup(spark, layout.registry, bare_id(model_id))
    if meta is None:
        raise NoModelError(f"No model found for ID {bare_id(model_id)}")
    model = PipelineModel.load(meta["spark_path"])
    rows = read_scoring_table(spark, path, scoring_types(meta["feature_types"] or {}))
    return restore_text(score(model, rows, meta, invalid))


def predict_to_csv(
    spark: SparkSession, layout: Layout, predict_id: str, model_id: str, path: str, invalid: str = "error"
) -> str:
    """Score a table and write it where the status query looks; no row passes the driver."""
    out = layout.output(predict_id)
    write_csv(predict_file(spark, layout, model_id, path, invalid).drop("cast_failures"), out)
    return out


def _chunks(rows: Iterator, size: int) -> Iterator[list]:
    while chunk := list(islice(rows, size)):
        yield chunk


# Reasons why a request is refused before anything is read.
NO_PATH = "Missing CSV file."
REPEATED_ID = "predict_id is used by several requests"

ERRORS = "predict_id string, model_id string, error string"
_PLACE = ["__source_file", "__source_block", "__source_row"]
_META = ["spark_path", "feature_cols", "feature_types", "target_column"]


def predict_many(
    spark: SparkSession, layout: Layout, requests: DataFrame, out: str, results: str | None = None
) -> DataFrame:
    """Score every request; returns ``predict_id, model_id, error`` of those that went wrong.

    ``requests``: ``predict_id, csv_path, model_id`` (and ``model_type``). Requests
    are grouped by model and by the header of their file, and each group is read
    in one scan and scored once, so the loop runs over models, not files. The
    result is CSV under ``out/predict_id=<id>``; a request is rewritten whole.
    Rows whose features are missing or unreadable stay, with no prediction. Each
    file is scanned and scored once: the scored rows are kept on the executors'
    disks until they are written and counted; what is lost is scored anew.
    ``results`` names a folder for result messages: row count, columns and the
    first rows of each request.
    """
    if results is not None:
        delete_path(spark, results)
    requests, refused = _checked(requests, layout.root)
    matched = match_models(requests, read_registry(spark, layout.registry))
    good = matched.filter(F.col("error").isNull())
    wanted = good.select("model_id", "predict_id", "csv_path", "task_type", *_META).orderBy("model_id", "predict_id")
    failed: list[tuple[str, str, str]] = []
    n_groups = 0
    for model_id, rows in groupby(wanted.toLocalIterator(), key=lambda r: r.model_id):
        for chunk in _chunks(rows, FILES_PER_SCAN):
            meta = {"model_id": model_id, "task_type": chunk[0].task_type, **{c: chunk[0][c] for c in _META}}
            model = PipelineModel.load(meta["spark_path"])
            groups = _by_layout(spark, meta, chunk, failed)
            for (unit, columns), paths in groups.items():
                served = set(paths)
                asked = [(r.predict_id, r.csv_path) for r in chunk if r.csv_path in served]
                rows_in = _tagged_rows(spark, meta, chunk, unit, paths)
                scored = restore_text(score(model, rows_in, meta, "null")).persist(StorageLevel.DISK_ONLY)
                try:
                    counts = _write_scored(meta, scored, columns, out, asked)
                    if results is not None:
                        messages = _result_messages(meta, scored, counts, out, asked)
                        write_messages(messages, "predict", f"{results}/group-{n_groups:06d}", "overwrite")
                finally:
                    scored.unpersist()
                failed += [
                    (p, model_id, f"{unscored} rows have missing or unreadable features") for p, (_, unscored) in sorted(counts.items()) if unscored
                ]
                n_groups += 1
    unknown = matched.filter(F.col("error").isNotNull()).select("predict_id", "model_id", "error")
    return unknown.unionByName(spark.createDataFrame(failed, ERRORS)).unionByName(refused)


def _checked(requests: DataFrame, root: str = "") -> tuple[DataFrame, DataFrame]:
    """Requests with the place of their file, and errors of the others.

    The place is ``csv_path`` or, where nothing is there, ``s3_csv_key`` under the
    project's root. A request without either is refused, and so are different
    requests of one id, as they would write over each other.
    """
    spark = requests.sparkSession
    keyed = requests if "s3_csv_key" in requests.columns else requests.withColumn("s3_csv_key", F.lit(None).cast("string"))
    both = keyed.where("trim(csv_path) <> '' and trim(s3_csv_key) <> ''").select("csv_path", "s3_csv_key").distinct()
    asked = both.collect()  # only these have two places to look at
    found = resolve_all(spark, [csv_places(root, r.csv_path, r.s3_csv_key, None) for r in asked])
    places = spark.createDataFrame([(r.csv_path, r.s3_csv_key, p) for r, p in zip(asked, found)], "csv_path string, s3_csv_key string, __place string")
    key = F.nullif(F.trim("s3_csv_key"), F.lit(""))
    whole = F.when(key.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), key).otherwise(F.concat(F.lit(f"{root.rstrip('/')}/"), key))
    given = F.coalesce("__place", F.nullif(F.trim("csv_path"), F.lit("")), whole)
    same = Window.partitionBy("predict_id")
    named = keyed.join(places, ["csv_path", "s3_csv_key"], "left").withColumn("csv_path", given).drop("__place")
    named = named.dropDuplicates(["predict_id", "csv_path", "model_id"]).withColumn(
        "__refused",
        F.when(F.col("csv_path").isNull(), F.lit(NO_PATH)).when(F.count("*").over(same) > 1, F.lit(REPEATED_ID)),
    )
    bad = named.filter(F.col("__refused").isNotNull())
    return named.filter(F.col("__refused").isNull()).drop("__refused"), bad.select("predict_id", "model_id", F.col("__refused").alias("error"))


def _by_layout(spark: SparkSession, meta: dict, chunk: list, failed: list) -> dict[tuple, list[str]]:
    """Paths of a chunk by (file or folder, header); requests whose file does not serve go to ``failed``."""
    requested: dict[str, list[str]] = {}
    for r in chunk:
        requested.setdefault(r.csv_path, []).append(r.predict_id)

    def layout_of(path: str) -> tuple | Exception:
        try:
            line, folder = first_line(spark, path)
            columns = folded_names(header_fields(line)) if line else []
            if taken := {"predict_id", "cast_failures"} & set(columns):
                raise SchemaError(f"column names taken by the output: {sorted(taken)}")
            scoring_features(columns, meta["feature_cols"], meta["target_column"])
            return "folder" if folder else "file", tuple(columns)
        except (SchemaError, AnalysisException, OSError) as error:  # a wrong or absent file is that request's fault
            return error

    paths = sorted(requested)
    with ThreadPool(HEADER_THREADS) as pool:
        layouts = pool.map(layout_of, paths)
    alike: dict[tuple, list[str]] = {}
    for layout, path in zip(layouts, paths):
        if isinstance(layout, Exception):
            failed += [(p, meta["model_id"], str(layout).split("\n")[0]) for p in requested[path]]
        else:
            alike.setdefault(layout, []).append(path)
    return alike


def _tagged_rows(spark: SparkSession, meta: dict, chunk: list, unit: str, paths: list[str]) -> DataFrame:
    """Rows of the paths with the ``predict_id`` that asked for them and their place in the source."""
    asked = spark.createDataFrame([(r.predict_id, r.csv_path) for r in chunk], "predict_id string, csv_path string")
    asked = asked.select("predict_id", plain_path("csv_path").alias("__path"))
    # Paths are matched once per file; rows then join on the file name as it is.
    files = list_files(spark, paths).select(
        "file", plain_path(dataset_of(decoded_path("file"), unit)).alias("__path")
    )
    owners = broadcast_if_small(files.join(asked, "__path").select(F.col("file").alias("__source_file"), "predict_id"))
    rows = read_scoring_csv(
        spark, paths, scoring_types(meta["feature_types"] or {}), keep_path=True, keep_text=True
    )
    return rows.drop("cast_failures").join(owners, "__source_file")


def _write_scored(meta: dict, scored: DataFrame, columns: tuple, out: str, asked: list[tuple]) -> dict[str, tuple[int, int]]:
    """Write a group's rows and count them: rows and rows without an estimate of each request.

    Each request's folder is its own, and one without rows has only a header.
    """
    unscored = F.col(f"`{prediction_name(columns, meta['target_column'])}`").isNull()
    rows = scored.drop(*_PLACE)
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("header", True)
        .option("escape", '"')
        .partitionBy("predict_id")
        .csv(out)
    )
    counted = scored.groupBy("predict_id").agg(F.count("*").alias("n"), F.count_if(unscored).alias("bad")).collect()
    counts = {r.predict_id: (r.n, r.bad) for r in counted}  # one row per request of the chunk
    for predict_id in sorted({p for p, _ in asked} - set(counts)):
        write_csv(spark_empty(rows.drop("predict_id")), f"{out}/predict_id={predict_id}")
    return counts


def spark_empty(df: DataFrame) -> DataFrame:
    """No rows of the frame's columns, in one part, so that a header is written."""
    return df.sparkSession.createDataFrame([], df.schema).coalesce(1)


def _result_messages(meta: dict, scored: DataFrame, counts: dict[str, tuple[int, int]], out: str, asked: list[tuple]) -> DataFrame:
    """One message per request, with its first rows; every task keeps a few of them before they are shuffled."""
    first = sample_rows(scored, ["predict_id"], _PLACE).drop(*_PLACE)
    shown = [c for c in first.columns if c not in ("predict_id", "sample_no")]
    as_map = F.transform("sample_predictions", lambda r: F.from_json(r, "map<string,string>"))
    known = [(p, path, counts.get(p, (0, 0))[0]) for p, path in asked]
    requests = scored.sparkSession.createDataFrame(known, "predict_id string, csv_path string, n_rows long")
    none = F.array().cast("array<map<string,string>>")
    result = F.struct(
        "n_rows",
        F.array(*[F.lit(c) for c in shown]).alias("columns"),
        F.lit("spark").alias("prediction_mode"),
        F.coalesce(as_map, none).alias("sample_predictions"),
    )
    return requests.join(as_results(first, "predict_id", shown), "predict_id", "left").select(
        F.lit(meta["model_id"]).alias("model_id"),
        F.lit(meta["task_type"]).alias("model_type"),
        "csv_path",
        iso_now().alias("timestamp"),
        F.concat(F.lit(f"{out}/predict_id="), "predict_id").alias("output_csv"),
        result.alias("result"),
    )

"""The stages as micro-batch steps: ingest, preprocess, train, predict.

Every stage takes the file of a message where it is, by path or by storage key
under the project's root, and with a ledger does the work of a message once.
"""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.functions import text
from trellium.functions.feature_lists import SchemaError, fold, training_features
from trellium.operators.models import first_line, session_gone
from trellium.operators.profile import profile_files
from trellium.operators.validate import split_verdict, with_verdict
from trellium.plans.predict import predict_many
from trellium.plans.train import Layout, TrainOptions, preprocess, record, save_model, train_table
from trellium.sources.catalog import Catalog
from trellium.sources.messages import SCHEMAS, latest_per_key, write_messages
from trellium.sources.places import csv_places, processed_places, resolve, resolve_all
from trellium.sources.folders import path_exists, scratch
from trellium.streaming.ledger import Entry, Ledger, digest_of, once
from trellium.streaming.messages import Step, batch_folder, batch_name


def _with_places(requests: DataFrame, root: str | None) -> DataFrame:
    """Requests whose ``csv_path`` is where the file is: the driver asks the file systems, some side by side."""
    asked = requests.select("job_id", "csv_path", "s3_csv_key").distinct().collect()
    found = resolve_all(requests.sparkSession, [csv_places(root or "", r.csv_path, r.s3_csv_key, r.job_id) for r in asked])
    known = [(r.csv_path, r.s3_csv_key, r.job_id, place) for r, place in zip(asked, found)]
    places = requests.sparkSession.createDataFrame(known, "p string, k string, j string, place string")
    same = (
        F.col("csv_path").eqNullSafe(F.col("p")) & F.col("s3_csv_key").eqNullSafe(F.col("k")) & F.col("job_id").eqNullSafe(F.col("j"))
    )
    return requests.join(F.broadcast(places), same, "left").withColumn("csv_path", F.col("place")).drop("p", "k", "j", "place")


def _profiles(requests: DataFrame, unit: str, headers_in_parts: bool) -> DataFrame:
    """Profiles of the files a batch names. Files that are not there have no row."""
    spark = requests.sparkSession
    asked = [r.csv_path for r in requests.select("csv_path").distinct().collect() if r.csv_path]
    with ThreadPool(8) as pool:
        there = pool.map(lambda p: path_exists(spark, p), asked)
    found = [p for p, known in zip(asked, there) if known]
    if not found:
        return spark.createDataFrame(
            [],
            "path string, row_count bigint, column_count bigint, columns array<string>, "
            "preview array<array<string>>, header array<string>",
        )
    profile = profile_files(spark, found, unit, headers_in_parts)
    return profile.select(
        text.plain_path("dataset").alias("path"), "row_count", "column_count", "columns", "preview", "header"
    )


def ingest_step(
    uploaded: str, rejected: str, unit: str = "file", headers_in_parts: bool = False, default_target: str | None = None,
    layout: Layout | None = None, ledger: Ledger | None = None,
) -> Step:
    """Upload requests in; ``dataset_uploaded`` messages and a table of rejects out.

    ``default_target`` serves old messages without a target column. With a
    ``layout``, storage keys lie under its root, and accepted jobs are merged into
    its catalog: new ones are queued, ones seen before are queued again with their
    new target. With a ``ledger``, a request that was accepted before in another
    batch does nothing.
    """

    def fresh(named: DataFrame, batch: str) -> DataFrame:
        """Requests without those that another batch has done."""
        if ledger is None:
            return named
        rows = [r.asDict() for r in named.collect()]  # one small row per request of the batch
        before = ledger.seen("ingest", [digest_of(r) for r in rows])
        keep = [r for r in rows if before.get(digest_of(r), (batch,))[0] == batch]
        return named.sparkSession.createDataFrame([tuple(r.values()) for r in keep], named.schema)

    def step(batch: DataFrame, batch_id: int | str) -> None:
        with scratch():
            ingest(batch, batch_id)

    def ingest(batch: DataFrame, batch_id: int | str) -> None:
        spark, name = batch.sparkSession, batch_name(batch_id)
        named = batch.withColumn("job_id", text.job_id_or_new("job_id", "csv_path", "filename", "timestamp"))
        asked = fresh(latest_per_key(named), name).persist()
        try:
            requests = _with_places(asked, layout.root if layout else None)
            if default_target is not None:
                requests = requests.withColumn(
                    "target_column", F.coalesce("target_column", F.lit(default_target))
                )
            requests = requests.persist()
            profiles = _profiles(requests, unit, headers_in_parts).withColumnRenamed("columns", "_columns")
            joined = requests.withColumn("path", text.plain_path("csv_path")).join(profiles, "path", "left")
            checked = with_verdict(joined.withColumn("columns", F.col("header"))).drop("columns").persist()
            accepted, refused = split_verdict(checked)
            messages = accepted.withColumnRenamed("_columns", "columns").withColumns(
                {
                    "uploader": F.lit("local"),
                    "model_type": F.col("task_type"),
                    "raw_preview": F.concat(F.lit("Job queued: "), F.col("job_id")),
                }
            )
            write_messages(messages, "dataset_uploaded", batch_folder(uploaded, batch_id), "overwrite")
            if layout is not None:
                queued = accepted.select(
                    "job_id", "model_name", "task_type", "target_column", F.lit("local").alias("uploader"),
                    F.lit("queued").alias("status"), F.lit(None).cast("string").alias("user_id"),
                    F.current_timestamp().alias("created_at"),
                )
                Catalog(spark, layout.catalog).add_jobs(queued)
            out = refused.select("job_id", "filename", "csv_path", "timestamp", "reason")
            out.write.mode("overwrite").json(batch_folder(rejected, batch_id))
            if ledger is not None:
                digests = {r["job_id"]: digest_of(r) for r in (row.asDict() for row in asked.collect())}
                good = {r.job_id: r.row_count for r in accepted.select("job_id", "row_count").collect()}
                bad = {r.job_id: r.reason for r in refused.select("job_id", "reason").collect()}
                ledger.record("ingest", name, [
                    Entry(job, d, {"job_id": job, "n_rows": good.get(job)} if job in good else None, bad.get(job)) for job, d in digests.items()
                ])
            checked.unpersist()
            requests.unpersist()
        finally:
            asked.unpersist()

    return step


REJECTS = "job_id string, reason string"
UNREADABLE = "the message could not be read or names no job"


def _readable(batch: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Newest message per key, and a reject for each message without a key."""
    broken = batch.filter(F.col(key).isNull()).select(
        F.lit(None).cast("string").alias(key),
        F.concat_ws(": ", F.lit(UNREADABLE), F.to_json(F.struct(*batch.columns))).alias("reason"),
    )
    return latest_per_key(batch.filter(F.col(key).isNotNull()), key), broken


def _write_rejects(bad: list[tuple[str, str]], broken: DataFrame, folder: str) -> None:
    frame = broken.sparkSession.createDataFrame(bad, REJECTS)
    frame.unionByName(broken).write.mode("overwrite").json(folder)


def _each(spark, messages: list[dict], key: str, work: Callable[[dict], dict], at_once: int) -> list[Entry]:
    """``work`` on every message, some side by side: the entry of each.

    Whatever is wrong with one table, the other jobs go on; only a session that
    is gone ends the batch, which is then repeated. A small table leaves most of
    a cluster idle, so several jobs share it. What is kept of a job is its message.
    """

    def attempt(message: dict) -> Entry:
        try:
            return Entry(message[key], digest_of(message), work(message))
        except Exception as error:
            if session_gone(spark):
                raise
            return Entry(message[key], digest_of(message), None, first_line(error))

    with ThreadPool(at_once) as pool:
        return pool.map(attempt, messages, chunksize=1)


def _run(
    batch: DataFrame, batch_id: int | str, stage: str, kind: str, key: str, done: str, rejected: str, ledger: Ledger | None,
    work: Callable[[dict], dict], at_once: int, after: Callable[[list[Entry]], None] = lambda _: None,
) -> None:
    """A stage whose messages are jobs of their own: work, ``after`` it once for the batch, then messages and rejects."""
    spark = batch.sparkSession
    newest, broken = _readable(batch, key)
    messages = [r.asDict(recursive=True) for r in newest.toLocalIterator()]
    entries = once(ledger, stage, batch_name(batch_id), messages, lambda fresh: _each(spark, fresh, key, work, at_once))
    good = [e.output for e in entries if e.reason is None]
    after(good)
    names = SCHEMAS[kind].fieldNames()
    out = spark.createDataFrame([tuple(m.get(n) for n in names) for m in good], SCHEMAS[kind])
    write_messages(out.withColumn("timestamp", F.coalesce("timestamp", text.iso_now())), kind, batch_folder(done, batch_id), "overwrite")
    _write_rejects([(e.key, e.reason) for e in entries if e.reason is not None], broken, batch_folder(rejected, batch_id))
    if ledger is not None:
        ledger.record(stage, batch_name(batch_id), entries)


def _task(message: dict, *names: str) -> str:
    given = next((message[n] for n in names if message.get(n) and message[n].strip()), "classification").strip().lower()
    return given if given in ("classification", "regression") else "classification"


def preprocess_step(layout: Layout, done: str, rejected: str, at_once: int = 4, ledger: Ledger | None = None) -> Step:
    """``dataset_uploaded`` messages in; cleaned tables and ``preprocess`` messages out.

    Each job is a Spark job of its own (every table has its own schema), written
    under the job's id, so a replay writes the same again.
    """

    def step(batch: DataFrame, batch_id: int | str) -> None:
        spark = batch.sparkSession

        def work(m: dict) -> dict:
            source = resolve(spark, csv_places(layout.root, m["csv_path"], m["s3_csv_key"], m["job_id"]))
            if source is None:
                raise SchemaError("Missing CSV file.")
            path = layout.processed(m["job_id"])
            table = preprocess(spark, source, m["target_column"], path)
            target, task = fold(m["target_column"]), _task(m, "task_type", "model_type")
            return {
                "job_id": m["job_id"], "processed_path": path, "s3_processed_path": f"processed/{m['job_id']}.parquet", "n_rows": table.count(),
                "features": training_features(table.columns, target), "task_type": task, "model_type": task, "target_column": target,
            }

        _run(batch, batch_id, "preprocess", "preprocess", "job_id", done, rejected, ledger, work, at_once)

    return step


def train_step(
    layout: Layout, done: str, rejected: str, options: TrainOptions = TrainOptions(), at_once: int = 4, ledger: Ledger | None = None
) -> Step:
    """``preprocess`` messages in; models, registry, catalog and ``train`` messages out."""

    def step(batch: DataFrame, batch_id: int | str) -> None:
        spark = batch.sparkSession
        trained = {}

        def work(m: dict) -> dict:
            if not m["target_column"]:
                raise SchemaError("target column is required")
            source = resolve(spark, processed_places(layout.root, m["processed_path"], m["s3_processed_path"], m["job_id"]))
            made = train_table(spark.read.parquet(source), m["target_column"], _task(m, "model_type"), options)
            made.job_id = m["job_id"]
            save_model(made, layout)
            made.fitted.model = None  # it is saved; a batch may hold many
            trained[made.job_id] = made
            return {
                "job_id": made.job_id, "model_path": layout.model(made.job_id), "s3_model_path": f"models/{made.job_id}.pkl.spark",
                "model_type": made.task, "target_column": made.target, "feature_cols": made.fitted.features, "metrics": made.metrics,
                "training_mode": "distributed_spark",
            }

        def after(sent: list[dict]) -> None:
            record(spark, [trained[m["job_id"]] for m in sent if m["job_id"] in trained], layout, f"batch-{batch_name(batch_id)}")

        _run(batch, batch_id, "train", "train", "job_id", done, rejected, ledger, work, at_once, after)

    return step


def predict_step(layout: Layout, out: str, done: str, rejected: str, ledger: Ledger | None = None) -> Step:
    """``predict_request`` messages in; scored CSV per request, ``predict`` messages and a table of errors out."""

    def step(batch: DataFrame, batch_id: int | str) -> None:
        spark = batch.sparkSession
        newest, broken = _readable(batch, "predict_id")
        rows = [r.asDict(recursive=True) for r in newest.toLocalIterator()]
        errors_of: dict[str, str] = {}
        held = []

        def work(fresh: list[dict]) -> list[Entry]:
            requests = spark.createDataFrame([tuple(m.values()) for m in fresh], newest.schema)
            errors = predict_many(spark, layout, requests, out, batch_folder(done, batch_id))
            held.append(errors)
            errors_of.update({r.predict_id: r.error for r in errors.collect()})
            served = {m["predict_id"]: {"predict_id": m["predict_id"], "output_csv": f"{out}/predict_id={m['predict_id']}"} for m in fresh}
            # Rows without an estimate are reported, but the request was served.
            refused = {i: e for i, e in errors_of.items() if not path_exists(spark, served[i]["output_csv"])} if ledger else errors_of
            return [Entry(m["predict_id"], digest_of(m), served[m["predict_id"]], refused.get(m["predict_id"])) for m in fresh]

        # A batch that is repeated is scored again, so that its messages are written whole.
        name = batch_name(batch_id)
        before = {} if ledger is None else ledger.seen("predict", map(digest_of, rows))
        fresh = [m for m in rows if before.get(digest_of(m), (name,))[0] == name]
        entries = work(fresh) if fresh else []
        found = held[0].select("predict_id", "error") if held else spark.createDataFrame([], "predict_id string, error string")
        errors = found.unionByName(broken.withColumnRenamed("reason", "error"), allowMissingColumns=True)
        errors.write.mode("overwrite").json(batch_folder(rejected, batch_id))
        if ledger is not None:
            ledger.record("predict", name, entries)

    return step

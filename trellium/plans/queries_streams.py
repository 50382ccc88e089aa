"""Registered queries: streams run to the end of their input, and whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.plans import predict, train
from trellium.plans.book import in_test, query, table
from trellium.plans.queries_catalog import _requests
from trellium.plans.queries_models import _LINES_SQL, _lines, id_lines
from trellium.plans.queries_tables import _order_files
from trellium.operators.listing import job_status, model_listing, predict_status
from trellium.sources import csv as files
from trellium.sources import messages as msg
from trellium.sources import registry
from trellium.sources.artifacts import ArtifactIndex
from trellium.sources.catalog import Catalog
from trellium.sources.folders import new_folder, work_table
from trellium.streaming import messages as stream
from trellium.streaming import scoring as stream_scoring
from trellium.streaming import stages, status
from trellium.streaming.ledger import Ledger


def _sent(spark: SparkSession, sf_dir: str) -> str:
    out = new_folder(spark, "requests")
    # Several files, so that a stream takes them in several micro-batches.
    sent = _requests(spark, sf_dir).repartitionByRange(6, "timestamp")
    msg.write_messages(sent, "upload_request", out)
    return out


@query("select user_id::varchar as job_id from events group by 1")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 M3: repeated messages dropped in the stream."""
    out = new_folder(spark, "deduped")
    incoming = stream.message_stream(spark, "upload_request", _sent(spark, sf_dir), max_files=2)
    once = stream.drop_repeats(incoming, delay="60 days")
    run = (
        once.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", new_folder(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(out).select("job_id")


@query(
    """
    select user_id::varchar as job_id,
           case when bool_or(event_type in ('purchase', 'error')) then 'completed'
                when bool_or(event_type = 'signup') then 'training'
                when bool_or(event_type = 'click') then 'ingested' else 'queued' end as status
    from events group by 1
    """
)
def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 M5 K6: latest status per job from a stream, read from the catalog's jobs; the event type stands for the stage."""
    out, catalog = new_folder(spark, "status"), new_folder(spark, "catalog")
    kind = F.col("task_type")
    rank = F.when(kind.isin("purchase", "error"), 3).when(kind == "signup", 2).when(kind == "click", 1).otherwise(0)
    incoming = stream.message_stream(spark, "upload_request", _sent(spark, sf_dir), max_files=2)
    run = stream.run_stage(
        incoming.select("job_id", rank.alias("rank")), status.status_step(out, catalog, parts=1), new_folder(spark, "checkpoint")
    )
    run.awaitTermination()
    status.settle(spark, out, catalog)
    return Catalog(spark, catalog).read("jobs").select("job_id", "status")


@query(
    """
    select 'job-' || o_orderstatus as job_id, 'accepted' as verdict, count(*) as row_count, 5::bigint as column_count
    from orders group by o_orderstatus
    union all
    select 'txt-' || o_orderstatus, 'Only .csv files are supported.', null, null from orders group by o_orderstatus
    union all
    select 'bad-' || o_orderstatus, 'Target column ''nosuch'' was not found in the CSV header.', null, null
    from orders group by o_orderstatus
    """
)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload requests in, profiles and rejects out; every message is sent twice."""
    root = _order_files(spark, sf_dir)
    kinds = table(spark, sf_dir, "orders").select("o_orderstatus").distinct()
    requests = kinds.select(
        F.explode(F.array(F.lit("job"), F.lit("txt"), F.lit("bad"))).alias("kind"), F.col("o_orderstatus").alias("s")
    ).select(
        F.concat_ws("-", "kind", "s").alias("job_id"),
        F.concat(F.lit(f"{root}/o_orderstatus="), "s").alias("csv_path"),
        F.when(F.col("kind") == "txt", "orders.txt").otherwise("orders.csv").alias("filename"),
        F.when(F.col("kind") == "bad", "nosuch").otherwise("o_totalprice").alias("target_column"),
        F.lit("regression").alias("task_type"),
        F.lit("2024-01-01T00:00:00.000Z").alias("timestamp"),
    )
    sent, uploaded, rejected = (new_folder(spark, n) for n in ("requests", "uploaded", "rejected"))
    msg.write_messages(requests.unionByName(requests), "upload_request", sent)
    incoming = stream.message_stream(spark, "upload_request", sent)
    step = stages.ingest_step(uploaded, rejected, "folder", headers_in_parts=True)
    stream.run_stage(incoming, step, new_folder(spark, "checkpoint")).awaitTermination()
    good = msg.read_messages(spark, "dataset_uploaded", f"{uploaded}/batch-*", one_object_per_file=False)
    bad = spark.read.schema("job_id string, reason string").json(f"{rejected}/batch-*")
    none = F.lit(None).cast("long")
    return msg.latest_per_key(good).select("job_id", F.lit("accepted").alias("verdict"), "row_count", "column_count").unionByName(
        bad.select("job_id", F.col("reason").alias("verdict"), none.alias("row_count"), none.alias("column_count")).distinct()
    )


@query(
    f"""
    with {_LINES_SQL}
    select l_orderkey || '|' || l_linenumber as id, quantity, discount,
           round(b0 + b1 * quantity + b2 * discount, 3) as label, null::varchar as reason
    from l, b
    union all select null, null, null, null, 'scoring table lacks feature columns: [''discount'']'
    """
)
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files of two column orders scored as they arrive, by a model fitted on the training share; a bad file is set aside."""
    lines = id_lines(spark, sf_dir)
    trained = train.train_table(lines, "label", "regression", train.TrainOptions(estimator="linear"))
    meta = {"target_column": "label", "feature_cols": trained.fitted.features}
    arriving, out, aside = (new_folder(spark, n) for n in ("arriving", "scored", "quarantine"))
    rows = lines.drop("label")
    one = F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(3)) == 0
    files.write_csv(rows.where(one).repartitionByRange(3, "id"), f"{arriving}/a")
    files.write_csv(rows.where(~one).select(F.col("discount").alias(" Discount"), "id", F.col("quantity").alias("QUANTITY")).repartitionByRange(3, "id"), f"{arriving}/b")
    files.write_csv(rows.limit(1).drop("discount").coalesce(1), f"{arriving}/c")
    incoming = stream_scoring.arriving_files(spark, arriving, max_files=3)
    step = stream_scoring.route_step(trained.fitted.model, meta, {"quantity": "double", "discount": "double"}, out, aside)
    stream.run_stage(incoming, step, new_folder(spark, "checkpoint")).awaitTermination()
    scored = stream_scoring.read_routed(spark, out).select(
        "id", "quantity", "discount", F.round("label", 3).alias("label"), F.lit(None).cast("string").alias("reason")
    )
    none = F.lit(None).cast("double")
    bad = spark.read.schema(stream_scoring.QUARANTINE).json(f"{aside}/batch-*")
    return scored.unionByName(bad.select(F.lit(None).cast("string").alias("id"), none.alias("quantity"), none.alias("discount"), none.alias("label"), "reason"))


_CHAIN_SQL = f"""
    r as (select o_orderstatus as st, l_orderkey || '|' || l_linenumber as id, l_quantity as quantity, l_discount as discount,
                 l_extendedprice * (1 - l_discount) / 1000 + l_quantity as label
          from lineitem join orders on l_orderkey = o_orderkey),
    l as (select *, {in_test('id')} as t from
            (select *, row_number() over (partition by st, id order by quantity, discount, label) as rn from r) where rn = 1),
    c as (select st, avg(quantity) as mx, avg(discount) as mz, avg(label) as my,
                 var_pop(quantity) as vx, var_pop(discount) as vz, covar_pop(quantity, discount) as vxz,
                 covar_pop(quantity, label) as vxy, covar_pop(discount, label) as vzy from l where not t group by st),
    w as (select st, (vxy * vz - vzy * vxz) / (vx * vz - vxz * vxz) as b1,
                 (vzy * vx - vxy * vxz) / (vx * vz - vxz * vxz) as b2, mx, mz, my from c),
    b as (select st, b1, b2, my - b1 * mx - b2 * mz as b0 from w)
"""


@query(
    f"""
    with {_CHAIN_SQL}
    select 'ingest' as stage, 'job-' || st as key, 'done' as status, null::varchar as reason, 1::bigint as n_entries, count(*) as n_rows, null::double as value
    from r group by st
    union all select 'ingest', 'job-gone', 'rejected', 'CSV header row is missing or could not be parsed.', 1, null, null
    union all select 'preprocess', 'job-' || st, 'done', null, 1, count(*), null from l group by st
    union all select 'train', 'job-' || st, 'done', null, 1, count(*) filter (t), null from l group by st
    union all select 'predict', 'pred-' || st, 'done', null, 1, count(*), round(avg(b0 + b1 * quantity + b2 * discount), 4) from r join b using (st) group by st
    union all select 'predict', 'pred-gone', 'rejected', 'No model found for ID job-gone', 1, null, null
    """
)
def stream_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload to prediction through four streams and one ledger.

    One job names its file, one only the storage key, one a path where nothing is
    beside the key, one a file that isn't there. Each stage then runs once more as
    a new stream, which brings every message again, and a batch is replayed.
    """
    root = new_folder(spark, "project")
    layout = train.Layout(root)
    ledger = Ledger(spark, root)
    state = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("st"))
    lines = _lines(spark, sf_dir).join(state, "l_orderkey").select(
        "st", F.concat_ws("|", "l_orderkey", "l_linenumber").alias("ID"), "quantity", "discount", F.col("label").alias("Label")
    )
    lines = work_table(lines, "lines")
    files.write_csv(lines, f"{root}/uploads", partition_by=["st"])
    files.write_csv(lines.drop("Label"), f"{root}/predictions", partition_by=["st"])
    sent = state.select("st").distinct().select(
        F.concat(F.lit("job-"), "st").alias("job_id"),
        F.when(F.col("st") == "F", F.concat(F.lit(f"{root}/uploads/st="), "st"))
        .when(F.col("st") == "P", F.concat(F.lit(f"{root}/nowhere/"), "st")).otherwise("").alias("csv_path"),
        F.concat(F.lit("uploads/st="), "st").alias("s3_csv_key"),
    )
    gone = spark.createDataFrame([("job-gone", f"{root}/nowhere/gone.csv", "uploads/gone")], sent.schema)
    requests = sent.unionByName(gone).withColumns(
        {
            "filename": F.lit("lines.csv"), "target_column": F.lit("Label"), "task_type": F.lit("regression"),
            "timestamp": F.lit("2024-01-01T00:00:00.000Z"),
        }
    )
    asked = requests.select(
        F.regexp_replace("job_id", "job", "pred").alias("predict_id"), F.lit("").alias("csv_path"),
        F.regexp_replace("s3_csv_key", "uploads", "predictions").alias("s3_csv_key"), F.concat("job_id", F.lit(".pkl")).alias("model_id"), "timestamp",
    )
    box = {n: f"{root}/box/{n}" for n in ("requests", "uploaded", "cleaned", "trained", "asked", "results", "rejected")}
    msg.write_messages(requests, "upload_request", box["requests"])
    msg.write_messages(asked, "predict_request", box["asked"])
    out = f"{root}/predictions_output"
    steps = (
        ("upload_request", box["requests"], stages.ingest_step(box["uploaded"], f"{box['rejected']}/1", "folder", True, layout=layout, ledger=ledger)),
        ("dataset_uploaded", f"{box['uploaded']}/batch-*", stages.preprocess_step(layout, box["cleaned"], f"{box['rejected']}/2", ledger=ledger)),
        ("preprocess", f"{box['cleaned']}/batch-*", stages.train_step(
            layout, box["trained"], f"{box['rejected']}/3", train.TrainOptions(estimator="linear"), ledger=ledger)),
        ("predict_request", box["asked"], stages.predict_step(layout, out, box["results"], f"{box['rejected']}/4", ledger=ledger)),
    )
    for kind, source, step in steps:
        for _ in range(2):
            incoming = stream.message_stream(spark, kind, source)
            stream.run_stage(incoming, step, new_folder(spark, "checkpoint")).awaitTermination()
        first = ledger.read().where((F.col("status") == "done")).orderBy(F.desc("recorded_at")).first().batch
        step(msg.read_messages(spark, kind, source, False), first)
    entries = ledger.read().groupBy("stage", "key", "status", "reason").agg(F.count("*").alias("n_entries"))
    cleaned = msg.read_messages(spark, "preprocess", f"{box['cleaned']}/batch-*", False).select(
        F.lit("preprocess").alias("stage"), F.col("job_id").alias("key"), "n_rows", F.lit(None).cast("double").alias("value"))
    taken = msg.read_messages(spark, "dataset_uploaded", f"{box['uploaded']}/batch-*", False).select(
        F.lit("ingest").alias("stage"), F.col("job_id").alias("key"), F.col("row_count").alias("n_rows"), F.lit(None).cast("double").alias("value"))
    trained = msg.read_messages(spark, "train", f"{box['trained']}/batch-*", False).select(
        F.lit("train").alias("stage"), F.col("job_id").alias("key"), F.col("metrics")["n_samples"].cast("long").alias("n_rows"),
        F.lit(None).cast("double").alias("value"))
    scored = files.read_training_csv(spark, out).groupBy("predict_id").agg(F.count("*").alias("n_rows"), F.round(F.avg("label"), 4).alias("value"))
    scored = scored.select(F.lit("predict").alias("stage"), F.col("predict_id").alias("key"), "n_rows", "value")
    outputs = taken.unionByName(cleaned).unionByName(trained).unionByName(scored)
    # A message that was sent on twice would stand here twice.
    return entries.join(outputs, ["stage", "key"], "left").select("stage", "key", "status", "reason", "n_entries", "n_rows", "value")


# One row per id, as cleaning leaves them, and the fit on their training side.
_CLEAN_SQL = f"""
    r as (select l_orderkey || '|' || l_linenumber as id, l_quantity as quantity, l_discount as discount,
                 l_extendedprice * (1 - l_discount) / 1000 + l_quantity as label from lineitem),
    l as (select *, {in_test('id')} as t from
            (select *, row_number() over (partition by id order by quantity, discount, label) as rn from r) where rn = 1),
    c as (select avg(quantity) as mx, avg(discount) as mz, avg(label) as my,
                 var_pop(quantity) as vx, var_pop(discount) as vz, covar_pop(quantity, discount) as vxz,
                 covar_pop(quantity, label) as vxy, covar_pop(discount, label) as vzy from l where not t),
    w as (select (vxy * vz - vzy * vxz) / (vx * vz - vxz * vxz) as b1,
                 (vzy * vx - vxy * vxz) / (vx * vz - vxz * vxz) as b2, mx, mz, my from c),
    b as (select b1, b2, my - b1 * mx - b2 * mz as b0 from w)
"""


def _train_lines(spark: SparkSession, sf_dir: str) -> train.Layout:
    """A project with one job, trained from CSV and on record."""
    layout = train.Layout(new_folder(spark, "project"))
    upload = f"{layout.root}/uploads/job-1/lines.csv"
    lines = id_lines(spark, sf_dir)
    files.write_csv(lines.toDF("ID", "Quantity", " Discount", "Label"), upload)
    job = spark.createDataFrame([("job-1", "lines")], "job_id string, model_name string")
    Catalog(spark, layout.catalog).add_jobs(
        job.withColumns(
            {
                "task_type": F.lit("regression"),
                "target_column": F.lit("Label"),
                "status": F.lit("queued"),
                "user_id": F.lit("me"),
                "created_at": F.current_timestamp(),
            }
        )
    )
    options = train.TrainOptions(estimator="linear")
    train.train_job(spark, layout, "job-1", upload, "Label", "regression", options)
    return layout


@query(
    f"""
    with {_CLEAN_SQL}, e as (select label as y, label - (b0 + b1 * quantity + b2 * discount) as e from l, b where t),
    m as (select avg(e * e) as mse, 1 - sum(e * e) / (var_pop(y) * count(*)) as r2, count(*) as n from e)
    select 'job-1' as job_id, 'completed' as status, 'mse' as metric_name, round(mse, 3) as metric_value from m
    union all select 'job-1', 'completed', 'rmse', round(sqrt(mse), 3) from m
    union all select 'job-1', 'completed', 'r2', round(r2, 3) from m
    union all select 'job-1', 'completed', 'n_samples', n::double from m
    """
)
def train_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload to model: scan, clean, split, fit, evaluate, save, record; then its metrics and status."""
    layout = _train_lines(spark, sf_dir)
    catalog = Catalog(spark, layout.catalog)
    listed = model_listing(catalog.read("jobs"), catalog.read("models"), "me").select("job_id")
    status_now = catalog.read("jobs").join(listed, "job_id").select("job_id", "status")
    return catalog.read("metrics").join(status_now, "job_id").select(
        "job_id", "status", "metric_name", F.round("metric_value", 3).alias("metric_value")
    )


@query(
    f"""
    with {_CLEAN_SQL},
    s as (select o_orderstatus as st, l_quantity as quantity, l_discount as discount
          from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus <> 'P')
    select 'pred-' || st as predict_id, count(*) as n_rows, round(avg(b0 + b1 * quantity + b2 * discount), 4) as mean_prediction, null::varchar as error
    from s, b group by st
    union all select 'pred-' || o_orderstatus, null, null, 'No model found for ID job-2' from orders where o_orderstatus = 'P' group by o_orderstatus
    """
)
def predict_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests on files of different column order, one scan per layout; no model, no rows."""
    layout = _train_lines(spark, sf_dir)
    status_of = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    lines = _lines(spark, sf_dir).join(status_of, "l_orderkey")
    requests = []
    for kind, columns in (("F", ["quantity", "discount"]), ("O", ["discount", "quantity"]), ("P", ["quantity"])):
        path = f"{layout.root}/predictions/pred-{kind}/in.csv"
        files.write_csv(lines.filter(F.col("o_orderstatus") == kind).select("l_linenumber", *columns), path)
        requests.append((f"pred-{kind}", path, "job-2.pkl" if kind == "P" else "job-1.pkl.spark"))
    asked = spark.createDataFrame(requests, "predict_id string, csv_path string, model_id string")
    out = f"{layout.root}/predictions_output"
    errors = predict.predict_many(spark, layout, asked, out)
    scored = files.read_training_csv(spark, out)
    got = scored.groupBy("predict_id").agg(
        F.count("*").alias("n_rows"), F.round(F.avg("label"), 4).alias("mean_prediction"), F.lit(None).cast("string").alias("error")
    )
    none = F.lit(None)
    return got.unionByName(
        errors.select("predict_id", none.cast("long").alias("n_rows"), none.cast("double").alias("mean_prediction"), "error")
    )


@query(
    f"""
    with {_CLEAN_SQL},
    s as (select o_orderstatus as st, l_orderkey || '|' || l_linenumber as id, l_quantity as quantity, l_discount as discount
          from lineitem join orders on l_orderkey = o_orderkey),
    n as (select st, count(*) as n_rows from s group by st),
    f as (select st, id, row_number() over (partition by st order by id, quantity, discount) - 1 as sample_no,
                 round(b0 + b1 * quantity + b2 * discount, 3) as prediction from s, b)
    select 'pred-' || st as predict_id, n_rows, case st when 'O' then 'id,discount,quantity,label' else 'id,quantity,discount,label' end as columns,
           sample_no, id, prediction
    from n join f using (st) where sample_no < 5
    union all select 'pred-none', 0, 'id,quantity,discount,label', null, null, null
    """
)
def result_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per request with its row count, columns and first rows, in the order of the file."""
    layout = _train_lines(spark, sf_dir)
    status_of = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    lines = id_lines(spark, sf_dir).withColumn("l_orderkey", F.split("id", r"\|")[0].cast("long")).join(status_of, "l_orderkey")
    requests = []
    for kind, columns in (("F", ["quantity", "discount"]), ("O", ["discount", "quantity"]), ("P", ["quantity", "discount"]), ("none", ["quantity", "discount"])):
        path = f"{layout.root}/predictions/pred-{kind}"
        rows = lines.filter(F.col("o_orderstatus") == kind).select("id", *columns).repartitionByRange(4, "id").sortWithinPartitions("id", "quantity", "discount")
        files.write_csv(rows if kind != "none" else predict.spark_empty(rows), path)
        requests.append((f"pred-{kind}", path, "job-1"))
    asked = spark.createDataFrame(requests, "predict_id string, csv_path string, model_id string")
    out, results = f"{layout.root}/predictions_output", f"{layout.root}/results"
    predict.predict_many(spark, layout, asked, out, results)
    sent = msg.read_messages(spark, "predict", f"{results}/group-*", False)
    rows = sent.select(
        F.regexp_extract("output_csv", "predict_id=(.*)$", 1).alias("predict_id"), F.col("result.n_rows").alias("n_rows"),
        F.array_join("result.columns", ",").alias("columns"), F.posexplode_outer("result.sample_predictions").alias("sample_no", "sample"),
    )
    return rows.select(
        "predict_id", "n_rows", "columns", F.col("sample_no").cast("long").alias("sample_no"), F.col("sample")["id"].alias("id"),
        F.round(F.col("sample")["label"].cast("double"), 3).alias("prediction"),
    )


@query(
    """
    with s as (select distinct o_orderstatus as st from orders)
    select 'job' as what, 'job-' || st as id, case st when 'F' then 'completed' when 'P' then 'training' else 'ingested' end as status from s
    union all select 'job', 'job-none', 'queued'
    union all select 'request', 'pred-' || st, case st when 'F' then 'ready' else 'pending' end from s
    union all select 'artifact', kind || '/' || id, null from (values ('uploads', 'job-F'), ('uploads', 'job-O'), ('uploads', 'job-P'),
        ('processed', 'job-F'), ('processed', 'job-P'), ('models', 'job-F'), ('predictions_output', 'pred-F')) a(kind, id)
        where exists (select 1 from s where st = right(id, 1))
    """
)
def artifact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses from the files that the stages themselves have written, listed step by step."""
    layout = train.Layout(new_folder(spark, "project"))
    index = ArtifactIndex(spark, layout.root)
    state = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("st"))
    lines = _lines(spark, sf_dir).join(state, "l_orderkey").select("st", F.concat_ws("|", "l_orderkey", "l_linenumber").alias("id"), "quantity", "discount", "label")
    kinds = sorted(r.st for r in state.select("st").distinct().collect())
    upload = {st: f"{layout.root}/uploads/job-{st}/lines.csv" for st in kinds}
    for st, path in upload.items():
        files.write_csv(lines.where(F.col("st") == st).drop("st"), path)
    index.refresh()
    for st in {"P", "F"} & set(kinds):
        train.preprocess(spark, upload[st], "label", layout.processed(f"job-{st}"))
        index.refresh()
    if "F" in kinds:
        train.train_job(spark, layout, "job-F", upload["F"], "label", "regression", train.TrainOptions(estimator="linear"))
        predict.predict_to_csv(spark, layout, "pred-F", "job-F", upload["F"])
    index.refresh()
    index.refresh()
    asked = spark.createDataFrame([(f"job-{st}", f"pred-{st}") for st in kinds], "job_id string, predict_id string")
    jobs = asked.select("job_id", F.lit("me").alias("user_id")).union(spark.createDataFrame([("job-none", "me")], "job_id string, user_id string"))
    artifacts = index.read()
    none = spark.createDataFrame([], "job_id string")
    return (
        job_status(jobs, none, artifacts).select(F.lit("job").alias("what"), F.col("job_id").alias("id"), "status")
        .unionByName(predict_status(asked, artifacts).select(F.lit("request").alias("what"), F.col("predict_id").alias("id"), "status"))
        .unionByName(artifacts.select(F.lit("artifact").alias("what"), F.concat_ws("/", "kind", "id").alias("id"), F.lit(None).cast("string").alias("status")))
    )


@query(
    """
    with s as (select o_orderstatus as st, count(*) as n from orders join lineitem on l_orderkey = o_orderkey group by 1)
    select 'job-' || st as model_id, 'quantity,discount' as feature_cols, 'regression' as task_type, 'label' as target_column,
           'mean' as estimator, true as in_models from s
    union all select 'by-hand', 'sqft', 'classification', 'grade', null, false
    """
)
def metadata_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata files beside the models, written by training, counting before the registry."""
    layout = train.Layout(new_folder(spark, "project"))
    state = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("st"))
    lines = _lines(spark, sf_dir).join(state, "l_orderkey").select("st", F.concat_ws("|", "l_orderkey", "l_linenumber").alias("id"), "quantity", "discount", "label")
    # Joined once: every pass of every job's training reads the rows that were written.
    lines = work_table(lines, "lines")
    done = []
    for st in sorted(r.st for r in state.join(lines.select("st").distinct(), "st").select("st").distinct().collect()):
        trained = train.train_table(lines.where(F.col("st") == st).drop("st"), "label", "regression", train.TrainOptions(estimator="constant"))
        trained.job_id = f"job-{st}"
        train.save_model(trained, layout)
        trained.target = "overtaken"
        done.append(trained)
    train.record(spark, done, layout)
    registry.write_metadata_file(spark, layout.metadata("by-hand"), model_type="spark_mllib", feature_cols=["sqft"], task_type="classification", target_column="grade")
    known = registry.with_metadata_files(registry.read_registry(spark, layout.registry), registry.read_metadata_files(spark, f"{layout.root}/models/*.meta"))
    return known.select(
        "model_id", F.array_join("feature_cols", ",").alias("feature_cols"), "task_type", "target_column", "estimator",
        F.coalesce(F.col("spark_path").contains("/models/"), F.lit(False)).alias("in_models"),
    )

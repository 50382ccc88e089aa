"""The four stages from upload to predictions, as streams over folders."""

import json

import pytest
from pyspark.sql import functions as F

from trellium.operators import models
from trellium.operators.listing import job_status, model_detail, model_listing, predict_status
from trellium.plans import predict, train
from trellium.sources import messages as msg
from trellium.sources import registry
from trellium.sources.catalog import Catalog
from trellium.streaming import messages as stream
from trellium.streaming import stages

HOUSES = [(i, 600 + 37 * i, i % 11, 2 * (600 + 37 * i) - 30 * (i % 11)) for i in range(1, 61)]


def write_csv(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([header, *[",".join(map(str, r)) for r in rows]]) + "\n")
    return str(path)


def send(folder, name, **fields):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.json").write_text(json.dumps(fields, indent=2))


@pytest.fixture
def project(tmp_path):
    uploads = tmp_path / "uploads"
    house = write_csv(uploads / "j1" / "my houses.csv", "ID,Sqft,Age,Price", HOUSES + HOUSES[:5])
    other = write_csv(uploads / "j2" / "credit.csv", "id,income,grade", [(i, i % 9, "ab"[i % 9 > 4]) for i in range(60)])
    common = {"model_type": "", "timestamp": "2024-01-01T00:00:00.000Z"}
    inbox = tmp_path / "requests"
    send(inbox, "a", job_id="j1", csv_path=house, filename="my houses.csv", target_column="Price", task_type="regression", **common)
    send(inbox, "b", job_id="j2", csv_path=other, filename="credit.csv", target_column="grade", task_type="classification", **common)
    send(inbox, "c", job_id="j3", csv_path=house, filename="houses.csv", target_column="cost", task_type="regression", **common)
    send(inbox, "d", job_id="j4", csv_path=str(uploads / "none.csv"), filename="none.csv", target_column="x", task_type="", **common)
    send(inbox, "e", job_id="j5", csv_path=house, filename="houses.csv", target_column="", task_type="", **common)
    (inbox / "broken.json").write_text('{"job_id": ')
    send(inbox, "f", csv_path=house, filename="houses.csv", target_column="nosuch")
    return tmp_path


def test_upload_to_predictions(spark, project):
    root = str(project)
    layout = train.Layout(root)
    box = {k: f"{root}/box/{k}" for k in ("uploaded", "refused", "done", "refused2", "trained", "refused3", "results", "errors")}

    ingest = stages.ingest_step(box["uploaded"], box["refused"])
    requests = stream.message_stream(spark, "upload_request", f"{root}/requests", one_object_per_file=True)
    stream.run_stage(requests, ingest, f"{root}/check/ingest").awaitTermination()
    uploaded = msg.read_messages(spark, "dataset_uploaded", f"{box['uploaded']}/batch-*", False)
    sent = {r.job_id: r for r in uploaded.collect()}
    assert set(sent) == {"j1", "j2"}
    assert (sent["j1"].row_count, sent["j1"].columns) == (65, ["ID", "Sqft", "Age", "Price"])
    assert len(sent["j1"].preview) == 9
    refused = spark.read.json(f"{box['refused']}/batch-*")
    reasons = {r.job_id: r.reason for r in refused.collect()}
    assert {"j3", "j4", "j5"} < set(reasons) and len(reasons) == 5  # a broken and a nameless message got ids
    assert "Missing CSV file." in reasons.values() and reasons["j5"] == "Missing target column."

    catalog = Catalog(spark, layout.catalog)
    catalog.add_jobs(
        uploaded.select("job_id", F.col("job_id").alias("model_name"), "task_type", "target_column", F.lit("queued").alias("status"),
                        F.lit("me").alias("user_id"), F.current_timestamp().alias("created_at"))
    )

    clean = stages.preprocess_step(layout, box["done"], box["refused2"])
    stream.run_stage(
        stream.message_stream(spark, "dataset_uploaded", f"{box['uploaded']}/batch-*"), clean, f"{root}/check/clean"
    ).awaitTermination()
    done = {r.job_id: r for r in msg.read_messages(spark, "preprocess", f"{box['done']}/batch-*", False).collect()}
    assert done["j1"].n_rows == 60 and done["j1"].features == ["sqft", "age"] and done["j1"].target_column == "price"

    trees = models.TreeParams(trees=3, depth=3, rate=0.5)
    fit = stages.train_step(layout, box["trained"], box["refused3"], train.TrainOptions("boosted", trees))
    incoming = stream.message_stream(spark, "preprocess", f"{box['done']}/batch-*")
    stream.run_stage(incoming, fit, f"{root}/check/train").awaitTermination()
    # The same batch of the same stream once more, as after a lost driver.
    name = next(p.name for p in (project / "box" / "trained").iterdir()).removeprefix("batch-")
    fit(msg.read_messages(spark, "preprocess", f"{box['done']}/batch-*", False), name)
    trained = {r.job_id: r for r in msg.read_messages(spark, "train", f"{box['trained']}/batch-*", False).collect()}
    assert set(trained["j1"].metrics) == {"mse", "rmse", "r2", "n_samples"} and trained["j1"].metrics["r2"] > 0.5
    assert trained["j2"].metrics["accuracy"] == 1.0
    assert catalog.read("models").count() == 2 and catalog.read("metrics").count() == 6
    assert {r.status for r in catalog.read("jobs").collect()} == {"completed"}
    assert model_listing(catalog.read("jobs"), catalog.read("models"), "me").count() == 2
    none = spark.createDataFrame([], "path string")
    assert {r.status for r in job_status(catalog.read("jobs"), catalog.read("models"), none, "me").collect()} == {"completed"}
    detail = model_detail(catalog.read("jobs"), catalog.read("models"), registry.read_registry(spark, layout.registry), "j2", "me").first()
    assert (detail.target_column, detail.feature_cols) == ("grade", ["income"])

    scoring = project / "predictions"
    asked = [
        ("p1", write_csv(scoring / "p1" / "in.csv", "id,sqft,age", [(1, 800, 3), (2, 900, "x")][:1]), "j1.pkl"),
        ("p2", write_csv(scoring / "p2" / "in +1%.csv", "AGE, Sqft,id,note", [(3, 800, 1, "a b"), (4, 950.5, 2, "c")]), "j1"),
        ("p3", write_csv(scoring / "p3" / "in.csv", "income,grade", [(1, "b"), (8, "a"), (3, "z")]), "j2.pkl.spark"),
        ("p4", write_csv(scoring / "p4" / "in.csv", "id", [(1,)]), "j9"),
        ("p5", write_csv(scoring / "p5" / "in.csv", "id,sqft", [(1, 2)]), "j1"),
        ("p6", write_csv(scoring / "p6" / "in.csv", "id,sqft,age", [(1, 800, 3), (2, "many", 3), (3, "", 3)]), "j1"),
        ("p7", str(scoring / "p7" / "none.csv"), "j1"),
        ("p8", write_csv(scoring / "p8" / "in.csv", "id,sqft,age", []), "j1"),
        ("p9", "", "j1"),
    ]
    for name, path, model in asked:
        send(project / "asked", name, predict_id=name, csv_path=path, model_id=model, model_type="regression", timestamp="2024-01-01T00:00:00Z")
    # By storage key, and two requests of one id.
    send(project / "asked", "q1", predict_id="q1", csv_path="", s3_csv_key=asked[0][1], model_id="j1", timestamp="2024-01-01T00:00:00Z")
    out = f"{root}/predictions_output"
    step = stages.predict_step(layout, out, box["results"], box["errors"])
    incoming = stream.message_stream(spark, "predict_request", f"{root}/asked", one_object_per_file=True)
    stream.run_stage(incoming, step, f"{root}/check/predict").awaitTermination()
    errors = {r.predict_id: r.error for r in spark.read.json(f"{box['errors']}/batch-*").collect()}
    assert set(errors) == {"p4", "p5", "p6", "p7", "p9"}
    assert errors["p9"] == "Missing CSV file."
    assert errors["p4"] == "No model found for ID j9" and "age" in errors["p5"]
    assert errors["p6"] == "2 rows have missing or unreadable features" and "PATH_NOT_FOUND" in errors["p7"]

    sent = msg.read_messages(spark, "predict", f"{box['results']}/batch-*/group-*", False).collect()
    results = {r.output_csv.rsplit("=", 1)[1]: r for r in sent}
    assert set(results) == {"p1", "p2", "p3", "p6", "p8", "q1"}
    assert results["p8"].result.n_rows == 0 and results["p8"].result.sample_predictions == []
    assert results["q1"].csv_path == asked[0][1] and results["q1"].result.n_rows == 1
    assert results["p2"].result.n_rows == 2 and results["p2"].result.columns == ["age", "sqft", "id", "note", "price"]
    assert [m["note"] for m in results["p2"].result.sample_predictions] == ["a b", "c"]
    assert results["p3"].model_type == "classification" and results["p6"].result.n_rows == 3

    def scored(name):
        return spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/predict_id={name}")

    assert scored("p1").columns == scored("p8").columns == ["id", "sqft", "age", "price"] and scored("p8").count() == 0
    assert scored("p1").first().price == scored("p2").filter("age = 3").first().price
    assert [r.price is None for r in scored("p6").orderBy("id").collect()] == [False, True, True]
    assert [r.sqft for r in scored("p6").orderBy("id").collect()] == ["800", "many", None]
    assert scored("p2").count() == 2 and "note" in scored("p2").columns
    assert [r.grade_predicted for r in scored("p3").orderBy("income").collect()] == ["a", "a", "b"]

    artifacts = spark.createDataFrame([(p,) for p in scored("p1").inputFiles() + scored("p2").inputFiles()], "path string")
    ids = spark.createDataFrame([("p1",), ("p2",), ("p4",)], "predict_id string")
    assert {r.predict_id: r.status for r in predict_status(ids, artifacts).collect()} == {"p1": "ready", "p2": "ready", "p4": "pending"}


def test_a_bad_job_stops_no_other(spark, tmp_path):
    """A missing file, a date column, a null feature and a corrupt message beside a good job; two streams side by side."""
    layout = train.Layout(str(tmp_path))
    good = write_csv(tmp_path / "u" / "good.csv", "id,sqft,age,price", [(i, 600 + i, i % 7, 3 * i) for i in range(40)])
    dated = write_csv(tmp_path / "u" / "dated.csv", "id,day,price", [(i, f"2024-01-{1 + i % 28:02d}", i) for i in range(40)])
    holes = write_csv(tmp_path / "u" / "holes.csv", "id,sqft,price", [(i, "" if i % 5 == 0 else i, i) for i in range(40)])
    inbox = tmp_path / "in"
    for job, path in (("good", good), ("gone", str(tmp_path / "u" / "gone.csv")), ("dated", dated), ("holes", holes)):
        send(inbox, job, job_id=job, csv_path=path, target_column="price", task_type="regression", timestamp="2024-01-01T00:00:00Z")
    (inbox / "broken.json").write_text('{"job_id": ')
    box = {k: str(tmp_path / "box" / k) for k in ("done", "bad", "trained", "bad2", "bad3")}
    clean = stages.preprocess_step(layout, box["done"], box["bad"])
    incoming = stream.message_stream(spark, "dataset_uploaded", str(inbox), one_object_per_file=True)
    stream.run_stage(incoming, clean, str(tmp_path / "check" / "clean")).awaitTermination()
    reasons = {r.job_id: r.reason for r in spark.read.json(f"{box['bad']}/batch-*").collect()}
    assert set(reasons) == {"gone", None} and "PATH_NOT_FOUND" in reasons["gone"]
    fit = stages.train_step(layout, box["trained"], box["bad2"], train.TrainOptions("linear", fallback=False))
    for check in ("a", "b"):  # a second stream with a checkpoint of its own removes nothing
        incoming = stream.message_stream(spark, "preprocess", f"{box['done']}/batch-*")
        stream.run_stage(incoming, fit, str(tmp_path / "check" / check)).awaitTermination()
    assert len(list((tmp_path / "box" / "trained").iterdir())) == 2
    reasons = {r.job_id: r.reason for r in spark.read.json(f"{box['bad2']}/batch-*").collect()}
    assert set(reasons) == {"dated", "holes"} and "date" in reasons["dated"]
    jobs = {r.job_id: r.status for r in Catalog(spark, layout.catalog).read("jobs").collect()}
    assert jobs == {"good": "completed"}
    assert Catalog(spark, layout.catalog).read("metrics").select("metric_name").distinct().count() == 4
    # By default they get a model all the same, and the registry tells why it is another.
    fit = stages.train_step(layout, box["trained"], box["bad3"], train.TrainOptions("linear"))
    incoming = stream.message_stream(spark, "preprocess", f"{box['done']}/batch-*")
    stream.run_stage(incoming, fit, str(tmp_path / "check" / "c")).awaitTermination()
    assert spark.read.schema("job_id string").json(f"{box['bad3']}/batch-*").count() == 0
    known = {r.model_id: r for r in registry.read_registry(spark, layout.registry).collect()}
    assert known["good"].reason is None and "date" in known["dated"].reason and "sqft" in known["holes"].reason
    assert {known[j].estimator for j in ("good", "dated", "holes")} == {"linear"}
    score_me = write_csv(tmp_path / "new.csv", "id,sqft", [(1, 7), (2, "")])
    assert all(r.price is not None for r in predict.predict_file(spark, layout, "holes", score_me).collect())
    score_me = write_csv(tmp_path / "days.csv", "id,day", [(1, "2024-02-03"), (2, "soon")])
    assert all(r.price is not None for r in predict.predict_file(spark, layout, "dated", score_me).collect())


def test_requests_of_one_id_are_refused(spark):
    asked = [("p", "a.csv", "m"), ("p", "b.csv", "m"), ("q", "c.csv", "m"), ("q", "c.csv", "m"), ("r", None, "m")]
    frame = spark.createDataFrame(asked, "predict_id string, csv_path string, model_id string")
    good, refused = predict._checked(frame)
    assert [r.predict_id for r in good.collect()] == ["q"]
    assert sorted({(r.predict_id, r.error) for r in refused.collect()}) == [("p", predict.REPEATED_ID), ("r", predict.NO_PATH)]


def test_late_and_unreadable_messages_come_out(spark, tmp_path):
    """One file per batch: an unreadable time first, then messages weeks apart in any order."""
    times = ["soon", "2024-03-01T00:00:00Z", "2024-01-01T00:00:00Z", "2023-01-01T00:00:00Z", None, "2024-03-01T00:00:00Z"]
    for i, at in enumerate(times):
        send(tmp_path / "in", str(i), job_id=f"j{min(i, 4)}", timestamp=at)
    incoming = stream.message_stream(spark, "upload_request", str(tmp_path / "in"), max_files=1, one_object_per_file=True)
    stream.drop_repeats(incoming).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "check")
    ).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.job_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"j{i}" for i in range(5)]


def test_one_request(spark, project):
    layout = train.Layout(str(project))
    trained = train.train_job(
        spark, layout, "j1", f"{project}/uploads/j1/my houses.csv", "Price", "regression", train.TrainOptions("linear")
    )
    assert trained.metrics["r2"] == pytest.approx(1.0) and trained.holdout
    path = write_csv(project / "in.csv", "id,sqft,age", [(1, 800, 3), (2, "many", 3)])
    rows = predict.predict_file(spark, layout, "j1.pkl.spark", path)
    with pytest.raises(Exception, match="null"):
        rows.collect()
    rows = predict.predict_file(spark, layout, "j1.pkl.spark", path, invalid="null")
    got = {r.id: (r.sqft, r.price is None, r.cast_failures) for r in rows.collect()}
    assert got == {"1": ("800", False, 0), "2": ("many", True, 1)}
    good = write_csv(project / "good.csv", "id,sqft,age", [(1, 800, 3)])
    out = predict.predict_to_csv(spark, layout, "p", "j1", good)
    assert spark.read.option("header", True).csv(out).first().price.startswith("15")
    with pytest.raises(predict.NoModelError):
        predict.predict_file(spark, layout, "nope", good)


def test_status_over_batches(spark, tmp_path):
    from trellium.streaming.status import read_status, status_step

    step = status_step(str(tmp_path / "s"))
    for batch, rows in enumerate([[("a", 1), ("b", 0)], [("a", 3), ("a", 2)], [("a", 1)]]):
        frame = spark.createDataFrame(rows, "job_id string, rank int")
        step(frame, batch)
        step(frame, batch)
    assert {r.job_id: r.status for r in read_status(spark, str(tmp_path / "s")).collect()} == {"a": "completed", "b": "queued"}


def test_repeats_within_the_watermark(spark, tmp_path):
    for i, (job, at) in enumerate([("a", 1), ("b", 1), ("a", 2), ("a", 3), ("c", 3), ("b", 4)]):
        send(tmp_path / "in", str(i), job_id=job, timestamp=f"2024-01-01T0{at}:00:00.000Z")
    send(tmp_path / "in", "x", job_id="d", timestamp="soon")
    incoming = stream.message_stream(spark, "upload_request", str(tmp_path / "in"), max_files=7, one_object_per_file=True)
    run = (
        stream.drop_repeats(incoming).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    assert sorted(r.job_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c", "d"]


def test_times_are_written_as_iso_text(spark, tmp_path):
    df = spark.sql("select 'j' job_id, timestamp '2024-01-02 03:04:05.5' timestamp")
    msg.write_messages(df, "upload_request", str(tmp_path / "m"))
    assert msg.read_messages(spark, "upload_request", str(tmp_path / "m"), False).first().timestamp == "2024-01-02T03:04:05.500000Z"


def test_stream_goes_on_past_unreadable_rows(spark, tmp_path):
    from trellium.streaming.scoring import score_stream, scoring_stream

    table = spark.range(50).selectExpr("id", "cast(id as double) a", "cast(2 * id as double) label")
    fitted = models.fit(table, ["a"], "label", "regression", "linear")
    write_csv(tmp_path / "in" / "1.csv", "id,a", [(1, 4), (2, "x")])
    incoming = scoring_stream(spark, str(tmp_path / "in"), ["id", "a"], {"a": "double"})
    meta = {"target_column": "label", "feature_cols": ["a"]}
    score_stream(incoming, fitted.model, meta, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r.id: r.label for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["1"] == pytest.approx(8) and got["2"] is None


def test_running_status_in_update_mode(spark, tmp_path):
    from trellium.streaming.status import running_status

    for i, (job, kind) in enumerate([("a", "1"), ("a", "3"), ("b", "1")]):
        send(tmp_path / "in", str(i), job_id=job, task_type=kind)
    incoming = stream.message_stream(spark, "upload_request", str(tmp_path / "in"), one_object_per_file=True)
    ranked = incoming.select("job_id", F.col("task_type").cast("int").alias("rank"))
    run = running_status(ranked).writeStream.format("memory").queryName("st").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {(r.job_id, r.status) for r in spark.table("st").collect()} == {("a", "completed"), ("b", "ingested")}


def test_files_of_any_header_are_routed(spark, tmp_path):
    """Two orders, an extra column, a file without a feature, an empty one, unreadable values; a batch replayed."""
    from trellium.streaming.scoring import arriving_files, read_routed, route_step

    table = spark.range(50).selectExpr("id", "cast(id as double) a", "cast(id % 7 as double) b", "cast(2 * id + id % 7 as double) label")
    fitted = models.fit(table, ["a", "b"], "label", "regression", "linear")
    meta = {"target_column": "label", "feature_cols": ["a", "b"]}
    write_csv(tmp_path / "in" / "1.csv", "id,a,b", [(1, 4, 1), (2, "x", 1)])
    write_csv(tmp_path / "in" / "2.csv", "B, A ,id,note", [(2, 5, 3, "n")])
    write_csv(tmp_path / "in" / "3.csv", "id,a", [(9, 9)])
    (tmp_path / "in" / "4.csv").write_text("")
    write_csv(tmp_path / "in" / "sub" / "5.csv", "id,a,b", [(5, 1, 0)])
    step = route_step(fitted.model, meta, {"a": "double", "b": "double"}, str(tmp_path / "out"), str(tmp_path / "aside"))
    stream.run_stage(arriving_files(spark, str(tmp_path / "in"), 2), step, str(tmp_path / "check")).awaitTermination()
    step(spark.createDataFrame([(str(tmp_path / "in" / "1.csv"), 1)], "path string, length long"), "again")
    step(spark.createDataFrame([(str(tmp_path / "in" / "1.csv"), 1), ("/no/such.csv", 1)], "path string, length long"), "again")
    rows = [(r.id, r.note, None if r.label is None else round(r.label)) for r in read_routed(spark, str(tmp_path / "out")).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, [("1", None, 9), ("2", None, None), ("3", "n", 12), ("5", None, 2), ("1", None, 9), ("2", None, None)]))
    aside = {r.path.rsplit("/", 1)[1]: r.reason for r in spark.read.schema("path string, reason string").json(str(tmp_path / "aside" / "batch-*")).collect()}
    assert set(aside) <= {"3.csv", "4.csv", "such.csv"} and "['b']" in aside["3.csv"] and "PATH_NOT_FOUND" in aside["such.csv"]

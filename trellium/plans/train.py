"""From an uploaded CSV to a saved, scored and listed model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellium.functions.feature_lists import fold, training_features
from trellium.operators.clean import clean
from trellium.operators.features import Preparation, feature_types
from trellium.operators.metrics import map_to_long, metrics_for, metrics_map, unscored_count
from trellium.operators.models import Facts, Fitted, TreeParams, fit, fit_anyway
from trellium.operators.scoring import score
from trellium.operators.split import train_test, with_random_flag, with_stratified_flag, with_test_flag
from trellium.sources.catalog import Catalog
from trellium.sources.csv import read_parquet, read_training_csv, write_parquet
from trellium.sources.registry import REGISTRY, registry_row, save_rows, write_metadata_file


@dataclass(frozen=True)
class Layout:
    """Where a project keeps its artifacts."""

    root: str

    def processed(self, job_id: str) -> str:
        return f"{self.root}/processed/{job_id}.parquet"

    def model(self, job_id: str) -> str:
        return f"{self.root}/models/{job_id}.pkl.spark"

    def metadata(self, job_id: str) -> str:
        return f"{self.root}/models/{job_id}.pkl.meta"

    def output(self, predict_id: str) -> str:
        return f"{self.root}/predictions_output/{predict_id}.csv"

    @property
    def registry(self) -> str:
        return f"{self.root}/registry"

    @property
    def catalog(self) -> str:
        return f"{self.root}/catalog"


@dataclass(frozen=True)
class TrainOptions:
    """``partitions`` deals the rows of a boosted fit out anew, the same at any size; without it they stay as read.

    ``fallback`` gives a model in spite of features that the estimator can't take,
    and the registry the reason; without it they are errors.
    """

    estimator: str = "boosted"
    params: TreeParams = TreeParams()
    prep: Preparation = Preparation()
    split: str = "hash"  # hash, stratified (exact share of each label) or random (Spark's own)
    key: tuple[str, ...] = ()
    partitions: int | None = None
    fallback: bool = True


@dataclass
class Trained:
    job_id: str
    fitted: Fitted
    target: str
    task: str
    holdout: bool
    n_train: int
    n_test: int
    metrics: dict[str, float | None]
    feature_types: dict[str, str]
    n_unscored: int = 0
    split_digest: str | None = None


def preprocess(
    spark: SparkSession, csv_path: str, target: str, out_path: str, schema: T.StructType | None = None
) -> DataFrame:
    """Clean a CSV to Parquet: one lazy plan from the scan to the write."""
    write_parquet(clean(read_training_csv(spark, csv_path, schema), target), out_path)
    return read_parquet(spark, out_path)


def train_table(table: DataFrame, target: str, task: str, options: TrainOptions = TrainOptions()) -> Trained:
    """Split, fit and evaluate a cleaned table. Only the needed columns are read."""
    target = fold(target)
    features = training_features(table.columns, target)
    key = list(options.key) or (["id"] if "id" in table.columns else [])
    needed = table.select(*dict.fromkeys([*key, *features, target]))
    if options.split == "random":
        flagged = with_random_flag(needed)
    elif options.split == "stratified" and task == "classification":
        flagged = with_stratified_flag(needed, target, key or None)
    else:
        flagged = with_test_flag(needed, key or None)
    # Trees read their input several times; least squares and constants once.
    keep = options.estimator == "boosted"
    if keep:
        if options.partitions:
            flagged = flagged.repartition(options.partitions, *[F.col(f"`{c}`") for c in key])
        flagged = flagged.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        split = train_test(flagged, target, features, key or None)
        facts = Facts(split.n_train, bool(split.varies), split.missing)
        fitting = fit_anyway if options.fallback else fit
        fitted = fitting(split.train, features, target, task, options.estimator, options.params, options.prep, facts)
        name = f"{target}_predicted"
        # Rows that the model can't take count as unscored; metrics are of the others.
        scored = score(fitted.model, split.test, {"target_column": target, "feature_cols": features}, "null")
        row = metrics_for(task, scored, target, name, extra=[unscored_count(target, name).alias("n_unscored")]).first()
    finally:
        if keep:
            flagged.unpersist()
    return Trained(
        "",
        fitted,
        target,
        task,
        split.holdout,
        split.n_train,
        split.n_test,
        metrics_map({k: v for k, v in row.asDict().items() if k != "n_unscored"}),
        feature_types(table, features),
        row.n_unscored,
        split.digest,
    )


def save_model(trained: Trained, layout: Layout) -> str:
    """Save the model, then its metadata file beside it: a job whose file is there has its model."""
    path = layout.model(trained.job_id)
    model = trained.fitted.model
    model.write().overwrite().save(path)
    write_metadata_file(
        SparkSession.active(), layout.metadata(trained.job_id), model_type="spark_mllib", spark_path=path,
        feature_cols=trained.fitted.features, task_type=trained.task, target_column=trained.target,
    )
    return path


def record(spark: SparkSession, done: list[Trained], layout: Layout, batch: str | None = None) -> None:
    """Bring registry and catalog up to date for a batch of trained jobs, one merge per table.

    Models are saved before. Recording a named batch again changes nothing but times.
    """
    if not done:
        return
    rows = [
        registry_row(
            t.job_id,
            spark_path=layout.model(t.job_id),
            feature_cols=t.fitted.features,
            feature_types=t.feature_types,
            task_type=t.task,
            target_column=t.target,
            estimator=t.fitted.estimator,
            reason=t.fitted.reason,
        )
        for t in done
    ]
    save_rows(spark.createDataFrame(rows, REGISTRY), layout.registry)
    catalog = Catalog(spark, layout.catalog)
    jobs = spark.createDataFrame([(t.job_id, t.job_id, t.task, t.target) for t in done], "job_id string, model_name string, task_type string, target_column string")
    catalog.ensure_jobs(
        jobs.withColumns({
            "uploader": F.lit("local"), "status": F.lit("training"), "user_id": F.lit(None).cast("string"), "created_at": F.current_timestamp()
        })
    )
    keys = spark.createDataFrame(
        [(t.job_id, layout.model(t.job_id)) for t in done], "job_id string, model_path string"
    )
    catalog.add_models(keys.withColumns({"user_id": F.lit(None).cast("string"), "created_at": F.current_timestamp()}))
    catalog.complete(keys)
    measured = spark.createDataFrame(
        [(t.job_id, t.metrics, t.holdout, t.n_unscored, t.split_digest) for t in done],
        "job_id string, metrics map<string,double>, holdout boolean, n_unscored long, split_digest string",
    )
    catalog.add_metrics(map_to_long(measured), batch)


def train_job(
    spark: SparkSession,
    layout: Layout,
    job_id: str,
    csv_path: str,
    target: str,
    task: str = "classification",
    options: TrainOptions = TrainOptions(),
    schema: T.StructType | None = None,
) -> Trained:
    table = preprocess(spark, csv_path, target, layout.processed(job_id), schema)
    trained = train_table(table, target, task, options)
    trained.job_id = job_id
    save_model(trained, layout)
    record(spark, [trained], layout)
    return trained

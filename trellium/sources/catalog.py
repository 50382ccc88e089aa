"""Catalog tables: jobs, models, metrics. Keys are kept by the merges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellium.operators.merge import merge_keep_first, merge_update, update_where_key, with_columns_if_absent
from trellium.sources.folders import drop_old_versions, path_exists, read_table, write_table


def _table(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "t": T.TimestampType(), "b": T.BooleanType(), "l": T.LongType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (p.split(":") for p in spec.split())])


# The catalog schema.
SCHEMAS = {
    "jobs": _table(
        "job_id:s model_name:s task_type:s target_column:s uploader:s status:s user_id:s created_at:t"
    ),
    "models": _table("job_id:s model_path:s user_id:s created_at:t"),
    # The last three say what the value was measured on; they are null in rows written without them.
    "metrics": _table("job_id:s metric_name:s metric_value:d recorded_at:t holdout:b n_unscored:l split_digest:s"),
}


# Versions of a table that stay for readers that began before a write.
KEPT_VERSIONS = 5


class Catalog:
    """Three Parquet tables under one root; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        if name == "metrics":
            if not path_exists(self.spark, self._path(name)):
                return self.spark.createDataFrame([], SCHEMAS[name])
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self._path(name)}/set-*")
        current = read_table(self.spark, self._path(name))
        return self.spark.createDataFrame([], SCHEMAS[name]) if current is None else current

    def add_jobs(self, jobs: DataFrame) -> None:
        """Insert jobs; a job seen before goes back to its new status and target."""
        merged = merge_update(
            self.read("jobs"), jobs, "job_id", ["status", "target_column"], ["created_at"]
        )
        self._write(merged, "jobs")

    def write_jobs(self, jobs: DataFrame) -> None:
        """The next version of the jobs, as a merge of them gave it."""
        self._write(jobs, "jobs")

    def ensure_jobs(self, jobs: DataFrame) -> None:
        """Insert the jobs that aren't there; the others stay as they are."""
        self._write(merge_keep_first(self.read("jobs"), jobs, "job_id", ["created_at"]), "jobs")

    def _write(self, rows: DataFrame, name: str) -> None:
        """Next version of a table; versions that a running reader can hardly hold any more are deleted."""
        write_table(rows, self._path(name))
        drop_old_versions(self.spark, self._path(name), KEPT_VERSIONS)

    def add_models(self, models: DataFrame) -> None:
        self._write(merge_keep_first(self.read("models"), models, "job_id", ["created_at"]), "models")

    def complete(self, keys: DataFrame) -> None:
        jobs = update_where_key(self.read("jobs"), keys, "job_id", {"status": F.lit("completed")})
        self._write(jobs, "jobs")

    def add_metrics(self, metrics: DataFrame, batch: str | None = None) -> None:
        """Append; the table has no key. Writing a named batch again replaces it."""
        name = batch or uuid.uuid4().hex
        whole = with_columns_if_absent(metrics, {f.name: f.dataType.simpleString() for f in SCHEMAS["metrics"].fields})
        rows = whole.select(*SCHEMAS["metrics"].fieldNames())
        rows.write.mode("overwrite").parquet(f"{self._path('metrics')}/set-{name}")


def read_jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Catalog table from a database the user names."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()

"""Latest status per job from a stream of stage messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.functions.text import STATUS_BY_RANK, status_name
from trellium.operators.merge import merge_update
from trellium.sources.catalog import Catalog
from trellium.sources.keyed_log import PARTS, KeyedLog
from trellium.streaming.messages import Step, batch_name

STATUS = "job_id string, rank int"


def status_log(spark: SparkSession, root: str) -> KeyedLog:
    return KeyedLog(spark, root, STATUS, ["job_id"], ["rank"])


def status_step(root: str, catalog: str | None = None, parts: int = PARTS) -> Step:
    """Write the highest rank per job of each micro-batch as a part of a log.

    No streaming state: the maximum of the parts is the maximum of the whole, a
    job may pause as long as it likes, and a replayed batch overwrites its part.
    After more than ``parts`` parts they are folded into one version, and with a
    ``catalog`` the jobs there are brought up to date. ``messages`` have ``job_id, rank``.
    """

    def step(batch: DataFrame, batch_id: int | str) -> None:
        spark = batch.sparkSession
        log = status_log(spark, root)
        log.write(batch.groupBy("job_id").agg(F.max("rank").cast("int").alias("rank")), batch_name(batch_id))
        if log.fold(parts) and catalog is not None:
            settle(spark, root, catalog)

    return step


def settle(spark: SparkSession, root: str, catalog: str) -> None:
    """Bring the catalog's jobs up to the log: unknown jobs are added, and no status goes back."""
    tables = Catalog(spark, catalog)
    jobs = tables.read("jobs")
    rank = F.lit(-1)
    for value, name in STATUS_BY_RANK.items():
        rank = F.when(F.col("status") == name, value).otherwise(rank)
    known = jobs.select("job_id", rank.alias("_known"))
    newest = status_log(spark, root).read().where("job_id is not null").join(known, "job_id", "left")
    ahead = newest.where(F.col("_known").isNull() | (F.col("rank") > F.col("_known")))
    source = ahead.select("job_id", status_name("rank").alias("status"), F.current_timestamp().alias("created_at"))
    tables.write_jobs(merge_update(jobs, source, "job_id", ["status"], ["created_at"]))


def read_status(spark: SparkSession, root: str) -> DataFrame:
    """``job_id, status`` as the log has it now."""
    return status_log(spark, root).read().select("job_id", status_name("rank").alias("status"))


def running_status(stream: DataFrame) -> DataFrame:
    """The same as a streaming aggregate, for update-mode sinks; one small state row per job."""
    return stream.groupBy("job_id").agg(status_name(F.max("rank")).alias("status"))

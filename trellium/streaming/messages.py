"""Message streams, replays and stage steps."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trellium.functions.text import parse_time
from trellium.sources.messages import SCHEMAS

Step = Callable[[DataFrame, int | str], None]


def message_stream(
    spark: SparkSession,
    kind: str,
    path: str,
    max_files: int | None = None,
    one_object_per_file: bool = False,
) -> DataFrame:
    """Messages of a kind as their files arrive; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(SCHEMAS[kind]).option("multiLine", one_object_per_file)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def kafka_stream(spark: SparkSession, kind: str, servers: str, topic: str, **options: str) -> DataFrame:
    """The same messages from a topic; needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), SCHEMAS[kind]).alias("m")).select("m.*")


def drop_repeats(
    stream: DataFrame, key: str = "job_id", time: str = "timestamp", delay: str = "1 day"
) -> DataFrame:
    """One message per key while its repeats arrive within ``delay``; state older than that is freed.

    The watermark follows the time of arrival, so no message is too late: one
    that was sent long ago or has no readable time comes out like any other. A
    message without a readable time counts as sent now.
    """
    if dict(stream.dtypes)[time] == "string":
        stream = stream.withColumn(time, F.coalesce(parse_time(time), F.current_timestamp()))
    elif dict(stream.dtypes)[time] == "timestamp_ntz":
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    arrived = stream.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", delay)
    return arrived.dropDuplicatesWithinWatermark([key]).drop("__arrived")


def run_stage(
    stream: DataFrame, step: Step, checkpoint: str, once: bool = True, interval: str = "10 seconds"
) -> StreamingQuery:
    """Run a step per micro-batch. A batch counts as done only after its step returned,
    so a lost driver repeats it; steps overwrite what they write under the batch's
    name: the stream's, which comes from its checkpoint folder, and a number. Two
    streams, or one started anew with another checkpoint, share no name.
    """
    name = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]
    writer = stream.writeStream.foreachBatch(lambda batch, number: step(batch, f"{name}-{number:09d}")).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def batch_name(batch_id: int | str) -> str:
    return batch_id if isinstance(batch_id, str) else f"{batch_id:09d}"


def batch_folder(root: str, batch_id: int | str) -> str:
    return f"{root}/batch-{batch_name(batch_id)}"

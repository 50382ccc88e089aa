"""What a project's storage holds for each job and request, kept as a table that grows with the new files only."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.functions import text
from trellium.sources.folders import path_exists
from trellium.sources.keyed_log import KeyedLog

SCHEMA = "kind string, id string, path string, modified timestamp"
# Folders of a project that hold artifacts.
FOLDERS = ("uploads", "processed", "models", "predictions_output")
# A file may become visible somewhat later than its time says.
LATE = timedelta(minutes=10)


class ArtifactIndex:
    """One row per artifact, of a job or a request: its kind, id, newest file and time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = KeyedLog(spark, f"{self.root}/artifact_index", SCHEMA, ["kind", "id"], ["modified"])

    def read(self) -> DataFrame:
        return self.log.read()

    def refresh(self) -> None:
        """Add what was written since the last refresh. File contents aren't read, and what is known stays."""
        folders = [f for f in (f"{self.root}/{name}" for name in FOLDERS) if path_exists(self.spark, f)]
        if not folders:
            return
        reader = self.spark.read.format("binaryFile").option("recursiveFileLookup", True)
        last = self.read().agg(F.max("modified")).first()[0]
        if last is not None:
            # The session's clock, as the option is read by it.
            since = self.spark.range(1).select(F.date_format(F.lit(last - LATE), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
            reader = reader.option("modifiedAfter", since)
        files = reader.load(folders).select(
            text.decoded_path("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified")
        )
        found = files.select(text.artifact("path").alias("a"), "path", "modified").where(F.col("a.id") != "")
        newest = found.groupBy(F.col("a.kind").alias("kind"), F.col("a.id").alias("id")).agg(
            F.max(F.struct("modified", "path")).alias("m")
        )
        rows = newest.select("kind", "id", F.col("m.path").alias("path"), F.col("m.modified").alias("modified"))
        fresh = rows.join(self.read().select("kind", "id", F.col("modified").alias("known")), ["kind", "id"], "left")
        self.log.write(fresh.where("known is null or modified > known").drop("known"), uuid.uuid4().hex)
        self.log.fold()

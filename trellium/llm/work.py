"""Work tables in the shared folder.

Those of a ``work`` block are deleted when it ends. Those that a returned frame
still reads stay until ``release``, or until the Python process ends.
"""

from __future__ import annotations

import atexit
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from trellium.sources.folders import new_folder


def delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


class Work:
    """A folder under the one that ``spark.checkpoint.dir`` names."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = new_folder(spark, label)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back: its lineage is cut, and every executor reaches it."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.path}/{name}")


@contextmanager
def work(spark: SparkSession, label: str) -> Iterator[Work]:
    folder = Work(spark, label)
    try:
        yield folder
    finally:
        delete(spark, folder.path)


_lasting: list[Work] = []


def lasting(spark: SparkSession, label: str) -> Work:
    """A folder for tables that a returned frame reads."""
    folder = Work(spark, label)
    _lasting.append(folder)
    return folder


def release() -> None:
    """Delete the lasting folders; for times when no frame reads them any more."""
    while _lasting:
        folder = _lasting.pop()
        if folder.spark.sparkContext._jsc is not None:
            delete(folder.spark, folder.path)


atexit.register(release)

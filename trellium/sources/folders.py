"""Shared work folder, and tables kept as numbered versions."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_base: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """Folder all executors can reach: what ``spark.checkpoint.dir`` names.

    Only a local session may go without the setting; it gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_base:
        _local_base[app] = tempfile.mkdtemp(prefix="trellium-")
    return _local_base[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """Path nobody used before, under the shared folder; not created yet."""
    return f"{shared_base(spark)}/{label}-{uuid.uuid4().hex}"


_scratch = threading.local()
_at_exit: list[tuple[SparkSession, str]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Work tables that ``work_table`` makes inside are deleted at the end; frames that read them are then of no use."""
    outer, _scratch.held = getattr(_scratch, "held", None), []
    try:
        yield
    finally:
        for spark, path in _scratch.held:
            delete_path(spark, path)
        _scratch.held = outer


def work_table(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, and safe when an executor is lost.

    It stays for frames that read it until the end of the ``scratch`` block, or of
    the Python process.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    held = getattr(_scratch, "held", None)
    (_at_exit if held is None else held).append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete_rest() -> None:
    for spark, path in _at_exit:
        if spark.sparkContext._jsc is not None:
            delete_path(spark, path)


atexit.register(_delete_rest)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give ``DataFrame.checkpoint`` its folder where the session has none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_base(spark)}/checkpoints")


def _hadoop_path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = _hadoop_path(spark, path)
    return fs.exists(jpath)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder with all that is in it; nothing happens if there is none."""
    jpath, fs = _hadoop_path(spark, path)
    fs.delete(jpath, True)


def write_file(spark: SparkSession, path: str, content: str) -> None:
    """Write a small text file in place of any there."""
    jpath, fs = _hadoop_path(spark, path)
    stream = fs.create(jpath, True)
    try:
        stream.write(bytearray(content.encode()))
    finally:
        stream.close()


def is_folder(spark: SparkSession, path: str) -> bool:
    jpath, fs = _hadoop_path(spark, path)
    return fs.getFileStatus(jpath).isDirectory()


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions under ``root``, oldest first."""
    jpath, fs = _hadoop_path(spark, root)
    if not fs.exists(jpath):
        return []
    found = []
    for status in fs.listStatus(jpath):
        child = status.getPath()
        name = child.getName()
        if name.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(child, "_SUCCESS")):
            found.append(int(name[2:]))
    return sorted(found)


def complete_children(spark: SparkSession, root: str, prefix: str) -> list[str]:
    """Names of the folders under ``root`` that begin with ``prefix`` and were written to the end, in order."""
    jpath, fs = _hadoop_path(spark, root)
    if not fs.exists(jpath):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(jpath)]
    path = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(n for n in names if n.startswith(prefix) and fs.exists(path(path(jpath, n), "_SUCCESS")))


def read_table(spark: SparkSession, root: str) -> DataFrame | None:
    """Newest complete version, or None before the first write."""
    found = versions(spark, root)
    return spark.read.parquet(f"{root}/v={found[-1]:09d}") if found else None


def write_table(df: DataFrame, root: str) -> int:
    """Write the next version. A reader sees it once its ``_SUCCESS`` file is there.

    One writer per table. Old versions stay, so a merge can read the table it
    replaces and a running reader keeps its files.
    """
    found = versions(df.sparkSession, root)
    number = found[-1] + 1 if found else 0
    df.write.mode("overwrite").parquet(f"{root}/v={number:09d}")
    return number


def drop_old_versions(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete all but the newest versions; for times when no reader holds an old one."""
    jpath, fs = _hadoop_path(spark, root)
    for number in versions(spark, root)[: -max(keep, 1)]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(jpath, f"v={number:09d}"), True)

"""Folders that driver and executors share, and tables that are written there."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


_scratch: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the session's spark.checkpoint.dir, deleted when the application ends.

    Without that setting a local session gets a folder of its machine; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "textmill-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/textmill-{uuid.uuid4().hex}"
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    if _scratch:
        _scratch[-1].append(folder)
    return folder


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The shared folders that are made inside are deleted at its end."""
    _scratch.append([])
    try:
        yield
    finally:
        for folder in _scratch.pop():
            removed(spark, folder)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str = "table", folder: str | None = None) -> DataFrame:
    """Writes a frame as Parquet in a shared folder, a new one if none is given, and reads it back.

    This cuts lineage, and the table survives lost executors. The shuffle files of the write are deleted at its end: nothing reads them again.
    """
    spark = df.sparkSession
    path, before = f"{folder or shared_folder(spark)}/{name}", spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that shared_folder gave."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def put(spark: SparkSession, file: str, text: str) -> None:
    """Writes a small file of a folder that executors share."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: other ones if the table was written anew."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)

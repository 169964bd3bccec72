"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="manchete-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's `spark.checkpoint.dir`, or else the context's checkpoint folder.
    A session on this machine alone (`local[...]`) that names neither gets a temporary
    folder, which goes away with the process; any other master is refused, because its
    executors would write to their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = folder.get() if folder.isDefined() else None
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a shared folder: the master is {master}")
    return _local_folder()


_opened: list[list[str]] = []


def working_folder(spark: SparkSession) -> str:
    """A new path below the shared folder."""
    path = f"{shared_folder(spark)}/manchete-{uuid.uuid4().hex}"
    for paths in _opened[-1:]:
        paths.append(path)
    return path


@contextlib.contextmanager
def job_folders(spark: SparkSession) -> Iterator[None]:
    """Remove the working folders made inside, when the job has ended."""
    _opened.append([])
    try:
        yield
    finally:
        for path in _opened.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write a table once and go on from the written copy, which outlives lost executors."""
    path = working_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

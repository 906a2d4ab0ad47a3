"""Shared storage: where a job keeps the tables that cut its lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Folders of the jobs that are running, innermost last.
_WORK: list[str] = []


@contextmanager
def work_folder(spark: SparkSession, parent: str | None = None) -> Iterator[str]:
    """A folder of its own for a job's intermediate tables, removed when the job ends.

    It lies below ``parent``, or below the shared folder that the session names.
    What was written to it must not be read afterwards.
    """
    path = f"{(parent or shared_dir(spark)).rstrip('/')}/work-{uuid.uuid4().hex}"
    _WORK.append(path)
    try:
        yield path
    finally:
        _WORK.remove(path)
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as the session names it.

    Within :func:`work_folder` that folder, else ``spark.checkpoint.dir`` decides.  Only a local session without that setting
    (tests, a laptop) gets a temporary folder; a cluster session must name one.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # Model training checkpoints there as well.
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="gapwise-"))
    if _WORK:
        return _WORK[-1]
    if configured is None:
        return context.getCheckpointDir()
    return f"{configured.rstrip('/')}/{context.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it.

    Later stages neither repeat the work nor depend on executors that may be
    lost, and, unlike a cached or checkpointed frame, read only the columns
    they need.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Binary files that tasks write: temporary names, a manifest of what was written, then a commit.

A task writes under a name of its own attempt and returns a manifest row per file; Spark keeps the rows of the attempts
that count.  Committing renames exactly those files.  It may run again at any point: a file that already
has its final name is left.  Readers go by the committed manifest, so they never see a part of a run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from gapwise.llm.common import discard, keep_table

TEMPORARY, MANIFEST = "_temporary", "_manifest"


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, in any store that Arrow knows."""
    return fs.FileSystem.from_uri(uri)


class FileWriter:
    """Numbered files of one task attempt."""

    def __init__(self, folder: str, suffix: str):
        self.fs, self.root = locate(folder)
        context = TaskContext.get()
        self.partition, self.suffix, self.count = context.partitionId(), suffix, 0
        self.attempt = context.taskAttemptId()
        self.fs.create_dir(f"{self.root}/{TEMPORARY}", recursive=True)

    def next(self) -> tuple[str, str, int]:
        """Temporary and final name, and the number of the file within its task."""
        number = self.count
        self.count += 1
        name = f"part-{self.partition:06d}-{number:05d}{self.suffix}"
        return f"{TEMPORARY}/{name}.attempt-{self.attempt}", name, number

    def open(self, temporary: str) -> pa.NativeFile:
        return self.fs.open_output_stream(f"{self.root}/{temporary}", compression=None)


def commit(written: DataFrame, folder: str) -> DataFrame:
    """Run the writing job, rename its files and store the manifest; returns the manifest.

    ``written`` has ``temporary`` and ``name`` for each file, and any further columns.
    """
    spark = written.sparkSession
    rows, path = keep_table(written, "written")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            store, root = locate(folder)
            for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("name").to_pylist()):
                if store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                    store.move(f"{root}/{temporary}", f"{root}/{name}")
            yield batch

    rows.mapInArrow(rename, rows.schema).write.parquet(f"{folder}/{MANIFEST}")
    discard(spark, [path, f"{folder}/{TEMPORARY}"])
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{MANIFEST}")


def each_file(files: DataFrame, read: Callable[[fs.FileSystem, str, dict], Iterator[pa.RecordBatch]], folder: str, schema: str) -> DataFrame:
    """What ``read`` yields for each manifest row; files are dealt to as many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            store, root = locate(folder)
            for row in batch.to_pylist():
                yield from read(store, f"{root}/{row['name']}", row)

    return files.repartition(max(1, files.count())).mapInArrow(run, schema)

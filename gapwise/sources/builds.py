"""Builds of a set of tables in one folder, of which readers see a whole one or the one before.

A build is written to a folder of its own.  When all of its tables are there, a numbered manifest is put beside it by
one rename; readers take the manifest with the greatest number.  A build that fails or is killed leaves no
manifest, so nothing of it is ever read.  The build before the current one stays for readers that have begun.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

from gapwise.storage import remove

MANIFEST = re.compile(r"manifest-(\d{8})\.json")
#: Builds that stay: the current one and those before it.
KEPT = 2


@dataclass(frozen=True)
class Build:
    """A published build: its folder's name, the buckets of its tables, and their names."""

    name: str
    buckets: int
    tables: tuple[str, ...]


class Unpublished(FileNotFoundError):
    """The folder holds no finished build."""


def new_build() -> str:
    return f"build-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests in the folder, ascending."""
    return [int(found[1]) for found in map(MANIFEST.fullmatch, names(spark, path)) if found]


def _manifest(number: int) -> str:
    return f"manifest-{number:08d}.json"


def put_once(spark: SparkSession, path: str, name: str, told: object) -> None:
    """Write ``told`` as a JSON file that appears whole, by one rename; an error if there is one of that name."""
    hidden, fs = _folder(spark, f"{path}/_{name}-{uuid.uuid4().hex}")
    stream = fs.create(hidden, False)
    try:
        stream.write(bytearray(json.dumps(told).encode()))
    finally:
        stream.close()
    final, _ = _folder(spark, f"{path}/{name}")
    if fs.exists(final) or not fs.rename(hidden, final):
        fs.delete(hidden, False)
        raise FileExistsError(f"{path} already has {name}")


def get(spark: SparkSession, path: str, name: str) -> dict:
    """What a JSON file tells."""
    target, fs = _folder(spark, f"{path}/{name}")
    stream = fs.open(target)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, ascending; none if there is no folder."""
    target, fs = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def _read(spark: SparkSession, path: str, number: int) -> Build:
    told = get(spark, path, _manifest(number))
    return Build(told["name"], told["buckets"], tuple(told["tables"]))


def current(spark: SparkSession, path: str) -> Build:
    numbers = _numbers(spark, path)
    if not numbers:
        raise Unpublished(f"no finished build in {path}")
    return _read(spark, path, numbers[-1])


def publish(spark: SparkSession, path: str, build: Build) -> None:
    """Make ``build`` the current one, then delete builds that nobody should be reading any more.

    If another build was published meanwhile under the same number, this one is refused.
    """
    numbers = _numbers(spark, path)
    number = numbers[-1] + 1 if numbers else 1
    put_once(spark, path, _manifest(number), asdict(build))
    for old in numbers[: 1 - KEPT]:
        remove(spark, f"{path}/{_read(spark, path, old).name}")
        remove(spark, f"{path}/{_manifest(old)}")

"""What the operators share: the word pattern, salted joins, files and intermediate tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.storage import new_path

#: Space and the five control characters TAB to CR divide words; everything else belongs to one.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Tasks that the rows of one key may be spread over.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; -1 for a missing id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(divisor)), F.lit(-1))


def words(text: Column) -> Column:
    """The words of a text in order; none for a missing text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def keep_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; the scan of it, and its path for ``discard``.

    Later stages read it again after an executor is lost, and never repeat the work.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete intermediate tables that nothing will read again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def attach(df: DataFrame, values: DataFrame, key: str, salt_by: Column, salts: int = SALTS) -> DataFrame:
    """Left join of ``df`` with ``values`` (one row per key), safe where one key has most of the rows.

    The rows of a key are spread over up to ``salts`` tasks by ``salt_by``.  ``values`` is
    repeated only for the (key, salt) pairs that occur, so at most ``salts`` times per key and never
    more often than the key has rows.  ``df`` and ``values`` are read twice and once.  Missing keys
    match nothing.
    """
    salt = "__salt"
    salted = df.withColumn(salt, F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    spread = salted.select(key, salt).where(F.col(key).isNotNull()).distinct().join(values, key)
    return salted.join(spread, [key, salt], "left").drop(salt)

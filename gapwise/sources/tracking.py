"""The event log: one row per (user, service, status, time)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.catalog import TIMESTAMP_CANDIDATES

TRACKING_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("process_type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("process_name", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)


def read_tracking(
    spark: SparkSession,
    path: str,
    candidates: Sequence[str] = TIMESTAMP_CANDIDATES,
    multi_line: bool = True,
) -> DataFrame:
    """CSV event log with a header, quoted fields that may span lines, and ``"`` escapes.

    Columns are found by their names, whatever their order; absent ones are NULL (see
    :func:`conform_tracking`).  Every field is read as text, so there is no
    inference pass.  A multi-line CSV file cannot be split, so each file is one
    task: pass ``multi_line=False`` for logs without embedded line breaks.
    """
    log = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(path)
    )
    return conform_tracking(log, candidates)


def pick_timestamp(
    df: DataFrame,
    candidates: Sequence[str] = TIMESTAMP_CANDIDATES,
    name: str = "created_at",
) -> DataFrame:
    """First available timestamp column, renamed to ``name``; the other candidates are dropped."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None:
        return df.withColumn(name, F.lit(None).cast("timestamp_ntz"))
    rest = [c for c in candidates if c != found and c in df.columns]
    return df.drop(*rest).withColumnRenamed(found, name)


def conform_tracking(
    df: DataFrame, candidates: Sequence[str] = TIMESTAMP_CANDIDATES
) -> DataFrame:
    """Any event log in the fixed tracking schema; absent columns and unreadable values become NULL.

    A time with a zone offset is that instant, seen in the session's time zone; one without is
    taken as it stands there.
    """
    timed = pick_timestamp(df, candidates)

    def conformed(field: T.StructField) -> Column:
        value = F.col(field.name) if field.name in timed.columns else F.lit(None)
        if field.name in timed.columns and isinstance(field.dataType, T.TimestampNTZType):
            if isinstance(timed.schema[field.name].dataType, T.StringType):
                value = value.try_cast("timestamp")
        return value.try_cast(field.dataType).alias(field.name)

    return timed.select(*map(conformed, TRACKING_SCHEMA))


# Size of a row group of landed events, before compression.
ROW_GROUP_BYTES = 32 << 20


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Landed events; the schema is known, so no file has to be opened to plan."""
    return spark.read.schema(TRACKING_SCHEMA).parquet(path)


def land_events(events: DataFrame, path: str) -> None:
    """Store normalised events as Parquet, sorted so that status and service filters skip data.

    After this the completed-use filter reaches the scan: ``status`` and
    ``process_type`` hold their normalised values, and each task's rows are sorted
    by them, which gives tight row-group statistics without a shuffle.  Row groups are small enough
    for a large file to be read by several tasks.
    """
    (
        events.sortWithinPartitions("status", "process_type")
        .write.mode("overwrite")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .parquet(path)
    )

"""The three stored tables and the explorer exports."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.operators.insights import user_cells
from gapwise.sources import builds
from gapwise.storage import remove

USER_CLUSTERS_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("Name", T.StringType()),
        T.StructField("cluster_id", T.IntegerType()),
        T.StructField("active_service", T.StringType()),
        T.StructField("cross_recommend_1", T.StringType()),
        T.StructField("rec1_score", T.DoubleType()),
        T.StructField("rec1_source", T.StringType()),
        T.StructField("cross_recommend_2", T.StringType()),
        T.StructField("rec2_score", T.DoubleType()),
        T.StructField("rec2_source", T.StringType()),
        T.StructField("user_display_name", T.StringType()),
        T.StructField("active_service_name", T.StringType()),
        T.StructField("rec1_name", T.StringType()),
        T.StructField("rec2_name", T.StringType()),
        T.StructField("segment_name", T.StringType()),
        T.StructField("last_active_at", T.TimestampNTZType()),
        T.StructField("process_name", T.StringType()),
    ]
)

USER_ACTIVITY_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("process_type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("process_name", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

USER_SERVICE_STATS_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("process_type", T.StringType()),
        T.StructField("interaction_count", T.LongType()),
    ]
)

MART_SCHEMAS = {
    "user_clusters": USER_CLUSTERS_SCHEMA,
    "user_activity": USER_ACTIVITY_SCHEMA,
    "user_service_stats": USER_SERVICE_STATS_SCHEMA,
}

# Users counted by cluster, services, source and NULLs, stored with every build.
CELLS = "user_cells"
CELLS_SCHEMA = (
    "cluster_id int, active_service string, cross_recommend_1 string, rec1_source string, "
    "null_rec1_score boolean, null_rec2 boolean, users bigint, with_id bigint"
)

# Layout: all tables have the same buckets by user.  Within a bucket rows are sorted by these columns; browsing
# a cluster reads its partition alone.
_SORT_KEYS = {
    "user_clusters": ("user_id",),
    "user_activity": ("user_id", "created_at", "event_id"),
    "user_service_stats": ("user_id", "process_type"),
}
_PARTITION_BY = {"user_clusters": ("cluster_id",)}

# The events of a bucket are written by so many tasks, told apart by these columns, as one user may have a large
# share of them.  The other tables have at most a row per user and service.
_SPREAD = {"user_activity": 32}
_SPREAD_BY = ("created_at", "event_id", "process_type", "process_name")


def write_marts(marts: Mapping[str, DataFrame], path: str, buckets: int | None = None) -> None:
    """Write the tables below ``path`` as a new build, which replaces the one before when it is complete.

    Readers see the old build or the new one, never part of it; a write that fails leaves the old one.
    Beside the users lie their cells, for the reports.  Every table is computed once, and dealt so that a task writes its buckets alone.  ``buckets`` is the
    session's number of shuffle partitions by default.
    """
    spark = next(iter(marts.values())).sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    build = builds.Build(builds.new_build(), n, tuple(marts))
    folder = f"{path}/{build.name}"
    try:
        for name, df in marts.items():
            _write_mart(df, name, f"{folder}/{name}", n)
        if "user_clusters" in marts:
            stored = spark.read.schema(USER_CLUSTERS_SCHEMA).parquet(f"{folder}/user_clusters")
            user_cells(stored).coalesce(1).write.parquet(f"{folder}/{CELLS}")  # few rows, whatever the users
    except BaseException:
        remove(spark, folder)
        raise
    builds.publish(spark, path, build)


def _write_mart(df: DataFrame, name: str, path: str, buckets: int) -> None:
    spark, table = df.sparkSession, f"gapwise_{uuid.uuid4().hex}"
    bucket = F.pmod(F.hash("user_id"), F.lit(buckets))  # as Spark numbers buckets
    spread = min(_SPREAD.get(name, 1), buckets)
    if spread > 1:
        row = F.xxhash64(*[F.col(c) for c in _SPREAD_BY if c in df.columns])
        bucket = F.pmod(bucket + F.pmod(row, F.lit(spread)).cast("int") * (buckets // spread), F.lit(buckets))
    writer = (
        df.repartitionById(buckets, bucket)
        .write.format("parquet")
        .partitionBy(*_PARTITION_BY.get(name, ()))
        .bucketBy(buckets, "user_id")
        .sortBy(*[key for key in _SORT_KEYS[name] if key in df.columns])
    )
    try:
        writer.option("path", path).saveAsTable(table)  # the catalogue's entry is only for writing
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _bucketed(spark: SparkSession, path: str, name: str, build: builds.Build) -> DataFrame:
    """The stored table with its buckets, by an entry in the session's catalogue that points at the files."""
    table = f"gapwise_{build.name.removeprefix('build-')}_{name}"
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in MART_SCHEMAS[name])
        parts = _PARTITION_BY.get(name)
        place = f"{path}/{build.name}/{name}".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet"
            + (f" PARTITIONED BY ({', '.join(parts)})" if parts else "")
            + f" CLUSTERED BY (user_id) INTO {build.buckets} BUCKETS LOCATION '{place}'"
        )
        if parts:
            spark.catalog.recoverPartitions(table)
    return spark.table(table)


def _stored(spark: SparkSession, path: str, name: str) -> builds.Build:
    build = builds.current(spark, path)
    if name not in build.tables:
        raise builds.Unpublished(f"the build in {path} has no table {name}")
    return build


def read_mart(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table of the current build.

    Tables with few rows a user are read by bucket, so they are joined and grouped by user where they are.  The
    activity is read in even splits: a user with most of the events would otherwise be one task.
    """
    build, schema = _stored(spark, path, name), MART_SCHEMAS[name]
    if name in _SPREAD:
        return spark.read.schema(schema).parquet(f"{path}/{build.name}/{name}")
    return _bucketed(spark, path, name, build).select(*schema.names)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The current build's users counted by all that the reports ask for."""
    return spark.read.schema(CELLS_SCHEMA).parquet(f"{path}/{_stored(spark, path, 'user_clusters').name}/{CELLS}")


def read_user(spark: SparkSession, path: str, name: str, user_id: str) -> DataFrame:
    """One user's rows of a stored table, from the files of one bucket."""
    table = _bucketed(spark, path, name, _stored(spark, path, name))
    return table.filter(F.col("user_id") == user_id.strip()).select(*MART_SCHEMAS[name].names)


def read_marts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Scans of the stored tables, by name."""
    return {name: read_mart(spark, path, name) for name in MART_SCHEMAS}


# Times keep their microseconds in text exports.
TEXT_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; text keeps its outer spaces."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("timestampNTZFormat", TEXT_TIME_FORMAT)
        .csv(path)
    )


def export_json(df: DataFrame, path: str) -> None:
    """JSON Lines, one record per row: a single array would need a single writer."""
    (
        df.write.mode("overwrite")
        .option("ignoreNullFields", False)
        .option("timestampNTZFormat", TEXT_TIME_FORMAT)
        .json(path)
    )

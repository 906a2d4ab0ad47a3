"""Names of users, services and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.catalog import Catalog
from gapwise.functions.text import short_id, strip, valid_name
from gapwise.operators.events import COMPLETED

ACTIVITY_KEYS = ("user_id", "process_type", "created_at")


def restore_names(user_clusters: DataFrame, names: DataFrame) -> DataFrame:
    """Users' own valid names, else the reference name for the same id.

    Ids of users are trimmed when events are normalised, so only those of the
    reference are trimmed here, and users keep their place by id.  Both
    tables grow with the users, so this is a shuffle join; the reference is
    first reduced to one row per id (the greatest name).
    """
    reference = (
        names.select(strip(F.col("user_id")).alias("user_id"), valid_name(F.col("Name")).alias("n"))
        .filter(F.col("n").isNotNull())
        .groupBy("user_id")
        .agg(F.max("n").alias("reference_name"))
    )
    own = F.col("Name") if "Name" in user_clusters.columns else F.lit(None).cast("string")
    return (
        user_clusters.withColumn("Name", own)
        .join(reference, "user_id", "left")
        .withColumn("Name", F.coalesce(valid_name(F.col("Name")), "reference_name"))
        .drop("reference_name")
    )


def attach_activity_names(activity: DataFrame, events: DataFrame) -> DataFrame:
    """Activity rows with the title of the completed event of the same user, service and time.

    Missing titles are taken from the first such event: by event id, those without
    one last and by title; NULL keys match NULL keys.  Equal rows become one
    and keep their least event id.

    Only rows without a title look one up.  They are one per key by then, as are the events,
    so a user whose events have no time meets its titles in as many rows as it has
    services.
    """
    rows = _merged(activity.withColumn("process_type", F.upper("process_type")))
    first = F.struct(F.col("event_id").isNull(), F.col("event_id"), F.col("process_name").isNull(), F.col("process_name"))
    titles = (
        events.filter(F.col("status") == COMPLETED)
        .groupBy(*ACTIVITY_KEYS)
        .agg(F.min(first).getField("process_name").alias("raw_name"))
        .filter(F.col("raw_name").isNotNull())
        .select(*[F.col(key).alias(f"raw_{key}") for key in ACTIVITY_KEYS], "raw_name")
    )
    same = [F.col(key).eqNullSafe(F.col(f"raw_{key}")) for key in ACTIVITY_KEYS]
    found = (
        rows.filter(F.col("process_name").isNull())
        .join(titles, same, "left")
        .withColumn("process_name", F.col("raw_name"))
        .select(*rows.columns)
    )
    return _merged(rows.filter(F.col("process_name").isNotNull()).unionByName(found))


def _merged(activity: DataFrame) -> DataFrame:
    columns = ("user_id", "process_type", "status", "created_at", "process_name")
    return activity.groupBy(*columns).agg(F.min("event_id").alias("event_id"))


def label_join(
    df: DataFrame,
    cat: Catalog,
    service_col: str | None = None,
    cluster_col: str | None = None,
    missing: str | None = None,
) -> DataFrame:
    """``<service_col>_label`` and ``segment_label`` for the given columns."""
    labels = {}
    if service_col is not None:
        labels[f"{service_col}_label"] = cat.service_label(F.col(service_col), missing)
    if cluster_col is not None:
        labels["segment_label"] = cat.segment_label(F.col(cluster_col))
    return df.withColumns(labels)


def user_directory(user_clusters: DataFrame) -> DataFrame:
    """Every user with its name, or a short form of the id."""
    name = F.when(F.lower(strip(F.col("Name"))) != "nan", valid_name(F.col("Name")))
    return user_clusters.select(
        "user_id",
        F.coalesce(name, short_id(F.col("user_id"))).alias("user_label"),
        name.isNotNull().alias("has_name"),
    )


def segment_directory(user_clusters: DataFrame, cat: Catalog) -> DataFrame:
    """Configured segments and segments found in the data, with their users."""
    found = user_clusters.filter(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(
        F.count("*").alias("users")
    )
    configured = cat.dim_segment(user_clusters.sparkSession)
    return (
        configured.join(found, "cluster_id", "full_outer")
        .select(
            "cluster_id",
            cat.segment_label(F.col("cluster_id")).alias("label"),
            "description",
            F.coalesce("users", F.lit(0)).alias("users"),
        )
        .orderBy("cluster_id")
    )

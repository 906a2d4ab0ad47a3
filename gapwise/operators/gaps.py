"""Services a user has, and has not, adopted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.catalog import Catalog
from gapwise.operators.affinity import service_profiles, used_services


def adopted_services(
    affinity_df: DataFrame, thresholds: DataFrame | None = None, cat: Catalog | None = None
) -> DataFrame:
    """Pairs of user and service that count as adopted.

    Any use counts, or, with thresholds, use above the service's threshold.  The
    thresholds have one row per service; a catalogue limits them to core
    services and so makes them safe to broadcast.  Without one Spark decides
    the join from their measured size.
    """
    if thresholds is None:
        return used_services(affinity_df)
    if cat is not None:
        thresholds = F.broadcast(thresholds.filter(cat.is_core(F.col("process_type"))))
    return (
        affinity_df.join(thresholds, "process_type")
        .filter(F.col("interaction_count") > F.col("gap_threshold"))
        .select("user_id", "process_type")
    )


def gap_candidates(scored: DataFrame, adopted: DataFrame) -> DataFrame:
    """Scored services without the adopted ones."""
    return scored.join(adopted, ["user_id", "process_type"], "left_anti")


def missing_users(affinity_df: DataFrame, recs: DataFrame, cat: Catalog) -> DataFrame:
    """``recs`` completed with a row, with empty slots, for every user that has none."""
    users = service_profiles(affinity_df, cat).select("user_id", "active_service")
    absent = users.join(recs, "user_id", "left_anti")
    return recs.unionByName(absent, allowMissingColumns=True)


def profile_gaps(users: DataFrame, affinity_df: DataFrame, cat: Catalog) -> DataFrame:
    """Each user's core services, in catalogue order, as used or as a gap."""
    core_uses = affinity_df.filter(cat.is_core(F.col("process_type")))
    used = core_uses.groupBy("user_id").agg(F.collect_set("process_type").alias("used"))
    rows = (
        users.select("user_id")
        .join(used, "user_id", "left")
        .select("user_id", "used", F.posexplode(cat.core_array()).alias("position", "process_type"))
    )
    is_used = F.coalesce(F.array_contains("used", F.col("process_type")), F.lit(False))
    return rows.select("user_id", "position", "process_type", (~is_used).alias("is_gap"))

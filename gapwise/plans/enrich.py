"""The repair pass over stored tables: fill, names, labels, activity titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.catalog import Catalog
from gapwise.functions.text import display_name
from gapwise.operators.events import latest_activity_hint
from gapwise.operators.fill import enrich_recs
from gapwise.operators.naming import attach_activity_names, restore_names

# Label of no service, name of a user without an id.
NO_SERVICE = "—"
UNKNOWN_USER = "Unknown user"


def enrich_user_clusters(
    user_clusters: DataFrame,
    stats: DataFrame,
    events: DataFrame | None,
    names: DataFrame | None,
    cat: Catalog,
) -> DataFrame:
    """Stored users with empty slots filled and every name and label renewed."""
    rows = enrich_recs(user_clusters, stats, cat)
    if names is not None:
        rows = restore_names(rows, names)
    if events is not None:
        rows = rows.join(latest_activity_hint(events), "user_id", "left")
    else:
        rows = rows.withColumn("hint", F.lit(None).cast("string"))
    labels = {
        "user_display_name": display_name(F.col("hint"), F.col("user_id"), UNKNOWN_USER),
        "active_service_name": cat.service_label(F.col("active_service"), NO_SERVICE),
        "rec1_name": cat.service_label(F.col("cross_recommend_1"), NO_SERVICE),
        "rec2_name": cat.service_label(F.col("cross_recommend_2"), NO_SERVICE),
        "segment_name": cat.segment_label(F.col("cluster_id")),
    }
    return rows.withColumns(labels).select(*user_clusters.columns)


def enrich_marts(
    marts: dict[str, DataFrame],
    events: DataFrame,
    names: DataFrame | None,
    cat: Catalog,
) -> dict[str, DataFrame]:
    """The repaired tables; write them to a new folder, not over the ones being read."""
    stats = marts["user_service_stats"]
    return {
        "user_clusters": enrich_user_clusters(marts["user_clusters"], stats, events, names, cat),
        "user_activity": attach_activity_names(marts["user_activity"], events),
        "user_service_stats": stats,
    }

"""Platform-wide reports and the user explorer, over the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.catalog import Catalog
from gapwise.functions.scores import percent, score_text
from gapwise.functions.text import blank_to_null, short_id, valid_name

# Length of the top-users report, mark for "none", label of an unknown service.
TOP_USERS = 20
NONE_MARK = "—"
UNKNOWN_SERVICE = "Unknown"


def _is_covered() -> Column:
    return F.coalesce(F.trim("cross_recommend_1") != "", F.lit(False))


# -- counts over all users -------------------------------------------------------
#
# Cells are the users counted by all that the reports ask for: as many rows as there are combinations of cluster,
# services and source, whatever the number of users.  Every report takes the stored cells, or users, which
# it counts first.

CELL_KEYS = ("cluster_id", "active_service", "cross_recommend_1", "rec1_source")


def user_cells(user_clusters: DataFrame) -> DataFrame:
    """Users per cell, and how many of them have an id; one aggregate, combined before the shuffle."""
    return user_clusters.groupBy(
        *CELL_KEYS,
        F.col("rec1_score").isNull().alias("null_rec1_score"),
        F.col("cross_recommend_2").isNull().alias("null_rec2"),
    ).agg(F.count("*").alias("users"), F.count("user_id").alias("with_id"))


def _cells(df: DataFrame, *needed: str) -> DataFrame:
    """``df`` if it is cells, else its users counted by ``needed``."""
    if "users" in df.columns:
        return df
    return df.groupBy(*needed).agg(F.count("*").alias("users"), F.count("user_id").alias("with_id"))


def cluster_dist(users: DataFrame) -> DataFrame:
    return _cells(users, "cluster_id").groupBy("cluster_id").agg(F.sum("users").alias("users")).orderBy("cluster_id")


def service_by_cluster(users: DataFrame) -> DataFrame:
    """Users per cluster and active service; users without an active service are not counted."""
    keys = ("cluster_id", "active_service")
    known = _cells(users, *keys).filter(F.col("active_service").isNotNull())
    return known.groupBy(*keys).agg(F.sum("users").alias("users"))


def rec_frequency(users: DataFrame) -> DataFrame:
    """Users per first recommendation, most frequent first."""
    return (
        _cells(users, "cross_recommend_1")
        .filter(F.col("cross_recommend_1").isNotNull())
        .groupBy(F.col("cross_recommend_1").alias("service"))
        .agg(F.sum("users").alias("users"))
        .orderBy(F.col("users").desc(), "service")
    )


def _covered() -> Column:
    return F.coalesce(F.sum(F.when(_is_covered(), F.col("users"))), F.lit(0).cast("long"))


def rec_coverage_pct(users: DataFrame) -> DataFrame:
    """Users with a first recommendation in percent, half to even; 0 for an empty table."""
    covered = percent(_covered(), F.sum("users"))
    return _cells(users, "cross_recommend_1").agg(F.coalesce(covered, F.lit(0).cast("long")).alias("coverage_pct"))


def platform_kpis(users: DataFrame, activity: DataFrame) -> DataFrame:
    """Users, clusters, stored events and coverage in one row."""
    clusters = _cells(users, "cluster_id", "cross_recommend_1").groupBy("cluster_id").agg(
        F.sum("users").alias("users"), _covered().alias("covered")
    )
    zero = F.lit(0).cast("long")
    by_users = clusters.agg(
        F.coalesce(F.sum("users"), zero).alias("users"),
        F.count("*").alias("clusters"),
        F.coalesce(F.sum("covered"), zero).alias("covered"),
        zero.alias("events"),
    )
    by_events = activity.agg(
        zero.alias("users"), zero.alias("clusters"), zero.alias("covered"), F.count("*").alias("events")
    )
    return (
        by_users.unionByName(by_events)
        .agg(*[F.sum(name).alias(name) for name in ("users", "clusters", "covered", "events")])
        .select(
            F.col("users").alias("total_users"),
            "clusters",
            F.col("events").alias("total_events"),
            F.coalesce(percent(F.col("covered"), F.col("users")), zero).alias("coverage_pct"),
        )
    )


def cluster_summary(users: DataFrame, cat: Catalog) -> DataFrame:
    """Per cluster: users, segment, most frequent active service and first recommendation."""
    cells = (
        _cells(users, "cluster_id", "active_service", "cross_recommend_1")
        .filter(F.col("cluster_id").isNotNull())
        .groupBy("cluster_id", "active_service", "cross_recommend_1")
        .agg(F.sum("users").alias("rows"), F.sum("with_id").alias("users"))
    )

    def value(kind: str, col: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(col).alias("value"), "rows", "users")

    values = (
        cells.select(
            "cluster_id",
            F.inline(F.array(value("active", "active_service"), value("rec", "cross_recommend_1"))),
        )
        .groupBy("cluster_id", "kind", "value")
        .agg(F.sum("rows").alias("rows"), F.sum("users").alias("users"))
    )

    def most_frequent(kind: str) -> Column:
        order = F.struct(-F.col("rows"), cat.priority_of(F.col("value")), F.col("value"))
        counted = (F.col("kind") == kind) & F.col("value").isNotNull()
        return F.coalesce(F.min_by("value", F.when(counted, order)), F.lit(NONE_MARK))

    return values.groupBy("cluster_id").agg(
        F.coalesce(cat.known_segment(F.col("cluster_id")), F.lit(NONE_MARK)).alias("segment"),
        F.sum(F.when(F.col("kind") == "active", F.col("users"))).alias("users"),
        most_frequent("active").alias("top_active_service"),
        most_frequent("rec").alias("top_recommendation"),
    )


def rec_sources(users: DataFrame) -> DataFrame:
    """Users per source of the first recommendation, most frequent first."""
    return (
        _cells(users, "rec1_source")
        .groupBy("rec1_source")
        .agg(F.sum("users").alias("users"))
        .orderBy(F.col("users").desc(), "rec1_source")
    )


def top_users(user_clusters: DataFrame, stats: DataFrame, cat: Catalog, n: int = TOP_USERS) -> DataFrame:
    """The users with most actions, decorated.  Counts are summed before the join."""
    totals = stats.groupBy("user_id").agg(F.sum("interaction_count").alias("total_actions"))
    users = user_clusters.select("user_id", "Name", "cluster_id", "active_service")
    top = users.join(totals, "user_id").orderBy(F.col("total_actions").desc(), "user_id").limit(n)
    return top.select(
        "user_id",
        F.coalesce(valid_name(F.col("Name")), short_id(F.col("user_id"))).alias("user_label"),
        "cluster_id",
        cat.segment_label(F.col("cluster_id")).alias("segment"),
        "active_service",
        cat.service_label(F.col("active_service"), UNKNOWN_SERVICE).alias("service"),
        "total_actions",
    )


def users_by_cluster(user_clusters: DataFrame, cluster_id: int) -> DataFrame:
    """Ids and names in a cluster, by id; only that cluster's files are read."""
    rows = user_clusters.filter(F.col("cluster_id") == cluster_id)
    return rows.select("user_id", "Name").orderBy("user_id")


def sample_users(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` users in a seeded pseudo-random order: a reproducible top-k, without a global sort."""
    place = F.md5(F.concat_ws(":", "user_id", F.lit(str(seed))).cast("binary"))
    return df.orderBy(place, "user_id").limit(n)


def searched_name(users: DataFrame) -> list[str]:
    """The column of names that a search looks into, beside the ids, if there is one."""
    return [c for c in ("Name", "user_display_name") if c in users.columns][:1]


def explorer_filter(
    user_clusters: DataFrame,
    clusters: Sequence[int] | None = None,
    services: Sequence[str] = (),
    search: str = "",
    regex: bool = False,
) -> DataFrame:
    """Users in the clusters and services, with the text in their id or name.

    Clusters default to all; no services means no service filter, and users
    without a service always pass it.
    The text matches literally and in any case, or as a pattern with ``regex``.
    """
    rows = user_clusters
    if clusters is not None:
        rows = rows.filter(F.col("cluster_id").isin(list(clusters)))
    if services:
        service = F.col("active_service")
        rows = rows.filter(service.isin(list(services)) | service.isNull())
    text = search.strip()
    if text:

        def matches(col: str) -> Column:
            if regex:
                return F.col(col).rlike("(?i)" + text)
            return F.contains(F.lower(col), F.lit(text.lower()))

        found = matches("user_id")
        for name in searched_name(rows):
            found = found | F.coalesce(matches(name), F.lit(False))
        rows = rows.filter(found)
    return rows


def explorer_view(user_clusters: DataFrame, cat: Catalog, raw: bool = False) -> DataFrame:
    """Readable table of users; ``raw`` gives the stored columns."""
    if raw:
        return user_clusters

    def rec(slot: int, rank: str) -> list[Column]:
        label = F.coalesce(
            blank_to_null(F.col(f"rec{slot}_name")),
            cat.service_label(F.col(f"cross_recommend_{slot}")),
            F.lit(""),
        )
        source = F.initcap(F.coalesce(F.col(f"rec{slot}_source"), F.lit("")))
        return [
            label.alias(f"{rank} Recommendation"),
            score_text(F.col(f"rec{slot}_score")).alias(f"{rank} Fit Score"),
            source.alias(f"{rank} Source"),
        ]

    return user_clusters.select(
        F.coalesce(valid_name(F.col("Name")), short_id(F.col("user_id"))).alias("User"),
        F.col("user_id").alias("User ID"),
        F.coalesce("segment_name", cat.segment_label(F.col("cluster_id"))).alias("Segment"),
        F.col("cluster_id").alias("Cluster"),
        F.coalesce(
            "active_service_name", cat.service_label(F.col("active_service"), UNKNOWN_SERVICE)
        ).alias("Active Service"),
        *rec(1, "Primary"),
        *rec(2, "Secondary"),
        F.col("last_active_at").alias("Last Active"),
    )

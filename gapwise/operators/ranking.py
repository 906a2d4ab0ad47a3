"""Rankings of services and of users' scored services.

Ties are always broken the same way: by priority, then by service code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.catalog import Catalog, string_array
from gapwise.operators.affinity import service_profiles

MODEL_SLOTS = 2


def active_service(affinity_df: DataFrame, cat: Catalog) -> DataFrame:
    """Each user's most used service; unknown services lose ties to known ones."""
    return service_profiles(affinity_df, cat).select("user_id", "active_service")


def global_rank(affinity_df: DataFrame, cat: Catalog) -> DataFrame:
    """Services by total use.  The window sees one row per service, after the aggregate."""
    totals = affinity_df.groupBy("process_type").agg(F.sum("interaction_count").alias("total"))
    order = Window.orderBy(
        F.col("total").desc(), cat.priority_of(F.col("process_type")), "process_type"
    )
    return totals.withColumn("global_rank", F.row_number().over(order))


def peer_rank(affinity_df: DataFrame, active: DataFrame, cat: Catalog) -> DataFrame:
    """For each active service, all services its users use, by total use."""
    totals = (
        affinity_df.join(active, "user_id")
        .groupBy("active_service", "process_type")
        .agg(F.sum("interaction_count").alias("peer_total"))
    )
    order = Window.partitionBy("active_service").orderBy(
        F.col("peer_total").desc(), cat.priority_of(F.col("process_type")), "process_type"
    )
    return totals.withColumn("peer_rank", F.row_number().over(order))


def rank_lists(uses: DataFrame, cat: Catalog) -> DataFrame:
    """The peer and global rankings as arrays, ready to be attached to users.

    ``uses`` is the affinity table with each user's active service.

    One row per core service (its peers' ranking) plus one, with key ``''``, for
    users whose active service is not in the catalogue.  Rows and array entries
    are limited to core services, so the table has at most ``n + 1`` rows of at
    most ``2 n`` codes for a catalogue of ``n`` core services, whatever the data.
    """
    totals = (
        uses.filter(cat.is_core(F.col("process_type")))
        .groupBy(_list_key(cat).alias("list_key"), "process_type")
        .agg(F.sum("interaction_count").alias("total"))
        # At most n * (n + 1) rows, gathered so that the steps below move nothing.
        .repartition(1)
    )
    services = totals.groupBy("process_type").agg(
        F.sum("total").alias("total"),
        F.expr("map_from_entries(collect_list(struct(list_key, total)))").alias("by_key"),
    )
    order = cat.priority_of(F.col("process_type")).alias("priority")
    listed = (
        services.select("process_type", "total", "by_key", order)
        .agg(F.expr("collect_list(struct(total, priority, process_type, by_key))").alias("services"))
        .select("services", F.explode(string_array((*cat.core, ""))).alias("list_key"))
    )

    def ranked(total: str, condition: str) -> Column:
        present = f"filter(services, s -> {condition})"
        keyed = f"transform({present}, s -> struct(-{total}, s.priority, s.process_type))"
        return F.expr(f"sort_array({keyed}).process_type")

    by_everyone = ranked("s.total", "true")
    by_peers = ranked("s.by_key[list_key]", "list_key <> '' AND map_contains_key(s.by_key, list_key)")
    return listed.select(
        "list_key",
        F.when(F.size(by_peers) > 0, by_peers).otherwise(by_everyone).alias("peers"),
        by_everyone.alias("globals"),
    )


def _list_key(cat: Catalog) -> Column:
    """Whose peer list a user takes: the active service's, or the one with an empty key."""
    active = F.col("active_service")
    return F.when(cat.is_core(active), active).otherwise(F.lit(""))


def attach_rank_lists(users: DataFrame, lists: DataFrame, cat: Catalog) -> DataFrame:
    """``peers`` and ``globals`` for every user, by active service.

    ``lists`` comes from :func:`rank_lists`, whose size the catalogue bounds; that
    is what makes the broadcast safe, and it keeps the few distinct join keys
    from concentrating all users in as many tasks.
    """
    return (
        users.withColumn("list_key", _list_key(cat))
        .join(F.broadcast(lists), "list_key", "left")
        .drop("list_key")
    )


def topn_per_user(scored_gaps: DataFrame, cat: Catalog, n: int = MODEL_SLOTS) -> DataFrame:
    """Each user's ``n`` best scored services; the scan keeps only ``n`` per user before shuffling."""
    order = Window.partitionBy("user_id").orderBy(
        F.col("score").desc_nulls_last(),
        cat.priority_of(F.col("process_type")),
        "process_type",
    )
    return scored_gaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def spread_ranks(active: DataFrame, ranked: DataFrame) -> DataFrame:
    """Ranked rows as columns; users without any keep NULL slots.  One aggregate, one join."""
    slots = ranked.groupBy("user_id").agg(
        *[
            F.max(F.when(F.col("rank") == slot, F.col(source))).alias(name)
            for slot in (1, 2)
            for source, name in (
                ("process_type", f"cross_recommend_{slot}"),
                ("score", f"rec{slot}_score"),
            )
        ]
    )
    return active.join(slots, "user_id", "left").select(
        "user_id",
        "active_service",
        "cross_recommend_1",
        "rec1_score",
        "cross_recommend_2",
        "rec2_score",
    )

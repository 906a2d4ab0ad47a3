"""Filling the two recommendation slots of every user.

A user's row carries its own services (``usage``, least used first) and, by a
join with a table the size of the catalogue, the rankings of its peers and of
everyone.  Filling is then array algebra within the row: candidates minus used
minus chosen, first element wins.  No shuffle, window or Python is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.catalog import Catalog
from gapwise.functions.text import blank_to_null
from gapwise.operators.affinity import profile_uses, service_profiles
from gapwise.operators.ranking import attach_rank_lists, rank_lists

# Score of each slot by source.
MODEL_SCORES = (88.0, 58.0)
FALLBACK_SCORES = (72.0, 58.0)
USAGE_SCORES = (65.0, 52.0)
LAST_RESORT_SCORE = 50.0
SERVE_TIME_SCORE = 65.0

# How far down the peer ranking a pick still counts as a peer pick.
MIN_PEER_PREFIX = 3
ENRICH_PEER_PREFIXES = (3, 5)

SLOT_COLUMNS = (
    "cross_recommend_1",
    "rec1_score",
    "rec1_source",
    "cross_recommend_2",
    "rec2_score",
    "rec2_source",
)


def assign_segment(df: DataFrame, cat: Catalog) -> DataFrame:
    """Cluster of the active service; the default cluster for services without one."""
    return df.withColumn("cluster_id", cat.cluster_of(F.col("active_service")))


# -- expressions within a user's row ----------------------------------------


def _used() -> Column:
    """The user's services, least used first; empty for a user without any."""
    return F.coalesce(F.col("usage.process_type"), F.array().cast("array<string>"))


def _open(candidates: Column, *excluded: Column) -> Column:
    """Candidates, best first, that are neither used nor in ``excluded``."""
    return F.array_except(F.array_except(candidates, _used()), F.array(*excluded))


def _peer_or_global(service: Column, prefix: int) -> Column:
    top = F.slice("peers", 1, prefix)
    return F.when(F.array_contains(top, service), F.lit("peer")).otherwise(F.lit("global"))


def _growth() -> Column:
    """Services to grow: least used first, without the active one unless it is the only one."""
    others = F.array_except(_used(), F.array("active_service"))
    return F.when(F.size(others) > 0, others).otherwise(_used())


def _is_full_profile(cat: Catalog) -> Column:
    return F.size(_used()) >= len(cat.core)


def _with_growth(df: DataFrame, cat: Catalog) -> DataFrame:
    """Both slots from usage growth where slot 1 is still empty and the profile is full."""
    grow = F.col("cross_recommend_1").isNull() & _is_full_profile(cat)
    changes = {}
    for slot, score in zip((1, 2), USAGE_SCORES):
        service = F.get(_growth(), slot - 1)
        names = (f"cross_recommend_{slot}", f"rec{slot}_score", f"rec{slot}_source")
        grown = (
            service,
            F.when(service.isNotNull(), F.lit(score)),
            F.when(service.isNotNull(), F.lit("usage")),
        )
        for name, value in zip(names, grown):
            changes[name] = F.when(grow, value).otherwise(F.col(name))
    return df.withColumns(changes)


# -- operators ----------------------------------------------------------------


def usage_growth(affinity_df: DataFrame, cat: Catalog) -> DataFrame:
    """For users of every core service, their two least used services to grow."""
    full = service_profiles(affinity_df, cat).filter(_is_full_profile(cat))
    return full.select(
        "user_id",
        "active_service",
        F.get(_growth(), 0).alias("growth_1"),
        F.get(_growth(), 1).alias("growth_2"),
    )


def fill_profiles(users: DataFrame, lists: DataFrame, cat: Catalog) -> DataFrame:
    """Fill rule of the batch build, for rows with ``usage`` and the two model slots."""
    model1, model2 = (blank_to_null(F.col(f"cross_recommend_{slot}")) for slot in (1, 2))
    prefix = max(MIN_PEER_PREFIX, len(cat.core) - 1)
    open_services = _open(F.concat("peers", "globals"), F.col("model1"), F.col("model2"))
    second = F.when(F.col("model1").isNull(), F.get("open", 1)).otherwise(F.get("open", 0))

    rows = (
        attach_rank_lists(users, lists, cat)
        .withColumns({"model1": model1, "model2": model2})
        .withColumn("open", open_services)
        .withColumns(
            {
                "cross_recommend_1": F.coalesce("model1", F.get("open", 0)),
                "cross_recommend_2": F.coalesce("model2", second),
            }
        )
    )
    sourced = {}
    for slot, model_score, score in zip((1, 2), MODEL_SCORES, FALLBACK_SCORES):
        pick, model = F.col(f"cross_recommend_{slot}"), F.col(f"model{slot}")
        sourced[f"rec{slot}_score"] = F.when(model.isNotNull(), F.lit(model_score)).when(
            pick.isNotNull(), F.lit(score)
        )
        sourced[f"rec{slot}_source"] = F.when(model.isNotNull(), F.lit("als")).when(
            pick.isNotNull(), _peer_or_global(pick, prefix)
        )
    filled = _with_growth(rows.withColumns(sourced), cat)
    return filled.drop("peers", "globals", "model1", "model2", "open")


def fill_gaps(recs: DataFrame, affinity_df: DataFrame, cat: Catalog) -> DataFrame:
    """Model slots first, then peers, then everyone, then usage growth for full profiles.

    ``recs`` has a row per user with ``cross_recommend_1/2``; users of the
    affinity table without a row get empty slots and are filled too.
    """
    profiles = service_profiles(affinity_df, cat)
    slots = recs.select("user_id", "cross_recommend_1", "cross_recommend_2")
    users = profiles.join(slots, "user_id", "left")
    filled = fill_profiles(users, rank_lists(profile_uses(profiles), cat), cat)
    return assign_segment(filled, cat).select(
        "user_id", "cluster_id", "active_service", *SLOT_COLUMNS
    )


def _with_usage(user_clusters: DataFrame, stats: DataFrame, cat: Catalog) -> DataFrame:
    """Stored users with their usage and the rank lists, by the active service that is stored."""
    usage = service_profiles(stats, cat).select("user_id", "usage")
    stored = user_clusters.select("user_id", "active_service")
    lists = rank_lists(stats.join(stored, "user_id", "left"), cat)
    return attach_rank_lists(user_clusters.join(usage, "user_id", "left"), lists, cat)


def enrich_recs(user_clusters: DataFrame, stats: DataFrame, cat: Catalog) -> DataFrame:
    """Repair pass over stored users: fill what is empty, keep what is there.

    Slot 1 comes from the peers only, slot 2 from peers, then everyone; full
    profiles grow; and a slot 2 that is still empty takes the most used service
    that is neither slot 1 nor the active one, used or not.  A service never
    fills both slots of a user.
    """
    rows = _with_usage(user_clusters, stats, cat)
    had1, had2 = F.col("had1"), F.col("had2")
    first_pick = F.get(_open(F.col("peers"), had2), 0)
    second_pick = F.get(_open(F.concat("peers", "globals"), F.col("cross_recommend_1")), 0)

    rows = (
        rows.withColumns(
            {f"had{slot}": blank_to_null(F.col(f"cross_recommend_{slot}")) for slot in (1, 2)}
        )
        .withColumn("cross_recommend_1", F.coalesce(had1, first_pick))
        .withColumn("cross_recommend_2", F.coalesce(had2, second_pick))
    )
    sourced = {}
    for slot, score, prefix in zip((1, 2), FALLBACK_SCORES, ENRICH_PEER_PREFIXES):
        pick, had = F.col(f"cross_recommend_{slot}"), F.col(f"had{slot}")
        picked = had.isNull() & pick.isNotNull()
        sourced[f"rec{slot}_score"] = F.when(picked, F.lit(score)).otherwise(
            F.col(f"rec{slot}_score")
        )
        sourced[f"rec{slot}_source"] = F.when(picked, _peer_or_global(pick, prefix)).otherwise(
            F.col(f"rec{slot}_source")
        )
    rows = _with_growth(rows.withColumns(sourced), cat)

    taken = F.array("cross_recommend_1", "active_service")
    resort = F.get(F.array_except("globals", taken), 0)
    is_resort = F.col("cross_recommend_2").isNull() & resort.isNotNull()
    rows = rows.withColumns(
        {
            "cross_recommend_2": F.coalesce("cross_recommend_2", resort),
            "rec2_score": F.when(is_resort, F.lit(LAST_RESORT_SCORE)).otherwise(
                F.col("rec2_score")
            ),
            "rec2_source": F.when(is_resort, F.lit("global")).otherwise(F.col("rec2_source")),
        }
    )
    return rows.select(*user_clusters.columns)


def serve_time_fill(user_clusters: DataFrame, stats: DataFrame, cat: Catalog) -> DataFrame:
    """Slot 1 for stored users that have none but do have gaps.

    The most used service overall that the user has not used, then the remaining
    gaps in catalogue order.  The stored name of the slot is cleared with it.
    """
    rows = _with_usage(user_clusters, stats, cat)
    missing = blank_to_null(F.col("cross_recommend_1")).isNull()
    pick = F.get(_open(F.concat("globals", cat.core_array())), 0)
    has_gap = F.size(F.array_except(cat.core_array(), _used())) > 0
    fill = missing & has_gap
    changes = {
        "cross_recommend_1": pick,
        "rec1_score": F.lit(SERVE_TIME_SCORE),
        "rec1_source": F.lit("global"),
        "rec1_name": F.lit(None).cast("string"),
    }
    return rows.withColumns(
        {
            name: F.when(fill, value).otherwise(F.col(name))
            for name, value in changes.items()
            if name in user_clusters.columns
        }
    ).select(*user_clusters.columns)

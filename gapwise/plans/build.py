"""The batch build: event log in, three stored tables out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.catalog import Catalog
from gapwise.functions.text import clean_title_short, display_name
from gapwise.operators.affinity import (
    gap_thresholds,
    profile_affinity,
    profile_matrix,
    profile_uses,
    user_rollup,
)
from gapwise.operators.events import completed_core, user_activity
from gapwise.operators.fill import assign_segment, fill_profiles
from gapwise.operators.model import AlsParams
from gapwise.operators.naming import restore_names
from gapwise.operators.ranking import rank_lists
from gapwise.operators.usage_factors import fit_usage_factors, usage_scores
from gapwise.sources.marts import USER_CLUSTERS_SCHEMA
from gapwise.storage import materialize

# Given the stored rollup, a column over its rows: an array of scores that follows the core services, NULL
# where there is none.
Scorer = Callable[[DataFrame], Column]


def event_rollup(events: DataFrame, cat: Catalog) -> DataFrame:
    """All events as a stored row per user; runs the job that stores it."""
    columns = tuple(c for c in cat.settings.pass_through_columns if c in events.columns)
    return materialize(user_rollup(events, cat, columns), "user-rollup")


def als_scores(rollup: DataFrame, cat: Catalog, params: AlsParams = AlsParams()) -> Column:
    """Model scores of every user for every service, in the user's row; fits the model when called.

    The fit never gathers the users of a service and is the same for any number of them.
    """
    return usage_scores(fit_usage_factors(profile_matrix(rollup, cat), cat, params))


def model_slots(users: DataFrame, scores: Column | None, cat: Catalog) -> DataFrame:
    """The two best scored services that each user has not adopted, all within the user's row.

    ``scores`` follows the core services; ties go to priority, then code.
    """
    if scores is None:
        empty = F.lit(None).cast("string")
        return users.withColumns({"cross_recommend_1": empty, "cross_recommend_2": empty})
    entries = [
        F.when(
            F.get("scores", i).isNotNull(),
            F.struct(
                (-F.get("scores", i)).alias("negated"),
                cat.priority_of(F.lit(code)).alias("priority"),
                F.lit(code).alias("process_type"),
            ),
        )
        for i, code in enumerate(cat.core)
    ]
    scored = users.withColumn("scores", scores)
    ranked = F.sort_array(F.array_compact(F.array(*entries))).getField("process_type")
    adopted = F.col("usage.process_type")
    if cat.settings.use_percentile_gaps:
        scored = _with_adopted(scored, cat)
        adopted = F.col("adopted")
    gaps = F.array_except(ranked, adopted)
    return scored.withColumns(
        {"cross_recommend_1": F.get(gaps, 0), "cross_recommend_2": F.get(gaps, 1)}
    ).drop("scores", "adopted")


def _with_adopted(users: DataFrame, cat: Catalog) -> DataFrame:
    """Services used more than the percentile threshold; one threshold per core service."""
    thresholds = (
        gap_thresholds(profile_affinity(users), cat.settings.gap_usage_percentile / 100.0)
        .filter(cat.is_core(F.col("process_type")))
        .agg(F.map_from_entries(F.collect_list(F.struct("process_type", "gap_threshold"))))
    )
    above = F.filter(
        "usage",
        lambda u: u.getField("interaction_count")
        > F.try_element_at("thresholds", u.getField("process_type")),
    )
    return (
        users.withColumn("thresholds", thresholds.scalar())
        .withColumn("adopted", above.getField("process_type"))
        .drop("thresholds")
    )


def assemble_user_clusters(
    rollup: DataFrame,
    names: DataFrame | None,
    cat: Catalog,
    scores: Column | None = None,
) -> DataFrame:
    """The recommendation table from the stored rollup: slots, segment, names and labels."""
    slots = model_slots(rollup, scores, cat)
    filled = assign_segment(fill_profiles(slots, rank_lists(profile_uses(rollup), cat), cat), cat)
    if names is None:
        named = filled.withColumn("Name", F.lit(None).cast("string"))
    else:
        named = restore_names(filled, names)

    source = cat.settings.display_name_from
    title = (
        clean_title_short(F.col(source)) if source in named.columns else F.lit(None).cast("string")
    )
    labelled = named.withColumns(
        {
            "user_display_name": display_name(title, F.col("user_id")),
            "active_service_name": cat.service_label(F.col("active_service")),
            "rec1_name": cat.service_label(F.col("cross_recommend_1")),
            "rec2_name": cat.service_label(F.col("cross_recommend_2")),
            "segment_name": cat.segment_label(F.col("cluster_id")),
        }
    )
    fixed = [
        (F.col(f.name) if f.name in labelled.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in USER_CLUSTERS_SCHEMA
    ]
    extra = [
        c
        for c in cat.settings.pass_through_columns
        if c in labelled.columns and c not in USER_CLUSTERS_SCHEMA.names
    ]
    return labelled.select(*fixed, *extra)


def build_user_clusters(
    events: DataFrame,
    names: DataFrame | None,
    cat: Catalog,
    scorer: Scorer | None = None,
) -> DataFrame:
    """The recommendation table from normalised events; without a scorer no model is involved."""
    return build_marts(events, names, cat, scorer)["user_clusters"]


def build_marts(
    events: DataFrame,
    names: DataFrame | None,
    cat: Catalog,
    scorer: Scorer | None = None,
) -> dict[str, DataFrame]:
    """All three tables from normalised events.

    Events are read for the users' counts, for their first titles and for the activity.  Landed events (:func:`gapwise.sources.tracking.land_events`) are the intended
    input: all but the titles' scan then skip everything that is not a completed use.

    ``scorer`` makes the model scores from the stored rollup, for example
    ``functools.partial(als_scores, cat=cat)``.  Calling this runs the jobs that store the rollup and fit
    the model; the tables themselves are computed when they are used.
    """
    rollup = event_rollup(events, cat)
    scores = scorer(rollup) if scorer is not None else None
    return {
        "user_clusters": assemble_user_clusters(rollup, names, cat, scores),
        "user_activity": user_activity(completed_core(events, cat)),
        "user_service_stats": profile_affinity(rollup),
    }

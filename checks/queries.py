"""One query per operator, over the generated tables.

What normalises or audits the log reads the generated tables; what takes
normalised events reads the events as landed, once per session and input
folder; what takes the stored tables reads what the batch build made of those.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property, partial

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.catalog import Catalog
from gapwise.functions import text
from gapwise.operators import (
    affinity,
    events,
    fill,
    gaps,
    insights,
    model,
    naming,
    profile,
    quality,
    ranking,
    search,
    state,
)
from gapwise.plans import build, enrich
from gapwise.sources import fixture, marts, tracking
from gapwise.storage import new_path

Query = Callable[[SparkSession, str], DataFrame]

LOOKUP_ID = " 7 "
BROWSED_CLUSTER = 0
SAMPLE_SIZE = 20
SEARCH_TEXT = "customer#"


class Inputs:
    """The event log of one folder and what is derived from it, all lazy but the stored tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, cat: Catalog):
        self.spark, self.sf_dir, self.cat = spark, sf_dir, cat

    @property
    def tracking(self) -> DataFrame:
        return fixture.tracking(self.spark, self.sf_dir)

    @property
    def names(self) -> DataFrame:
        return fixture.names_ref(self.spark, self.sf_dir)

    @cached_property
    def events_path(self) -> str:
        path = new_path(self.spark, "events")
        tracking.land_events(events.normalize_events(self.tracking), path)
        return path

    @property
    def events(self) -> DataFrame:
        return tracking.read_events(self.spark, self.events_path)

    @property
    def completed(self) -> DataFrame:
        return events.completed_core(self.events, self.cat)

    @cached_property
    def mart_path(self) -> str:
        path = new_path(self.spark, "marts")
        marts.write_marts(build.build_marts(self.events, self.names, self.cat, self.scorer), path)
        return path

    def mart(self, name: str) -> DataFrame:
        return marts.read_mart(self.spark, self.mart_path, name)

    @property
    def user_clusters(self) -> DataFrame:
        return self.mart("user_clusters")

    @property
    def cells(self) -> DataFrame:
        return marts.read_cells(self.spark, self.mart_path)

    @property
    def activity(self) -> DataFrame:
        return self.mart("user_activity")

    @property
    def affinity(self) -> DataFrame:
        return self.mart("user_service_stats")

    @property
    def active(self) -> DataFrame:
        return ranking.active_service(self.affinity, self.cat)

    def scorer(self, users: DataFrame) -> Column:
        return fixture.fixed_score_array(self.cat)

    @property
    def scores(self) -> DataFrame:
        return fixture.fixed_scores(self.user_clusters, self.cat)

    @property
    def scored_gaps(self) -> DataFrame:
        return gaps.gap_candidates(self.scores, gaps.adopted_services(self.affinity))

    @property
    def model_slots(self) -> DataFrame:
        top = ranking.topn_per_user(self.scored_gaps, self.cat)
        return ranking.spread_ranks(self.active, top)

    @property
    def empty_slots(self) -> DataFrame:
        """Users as a table stores them that knows no recommendations yet."""
        text_slot, score_slot = F.lit(None).cast("string"), F.lit(None).cast("double")
        return fill.assign_segment(self.active, self.cat).withColumns(
            {
                name: score_slot if name.endswith("_score") else text_slot
                for name in (*fill.SLOT_COLUMNS, "rec1_name")
            }
        )

    @cached_property
    def user_index(self) -> DataFrame:
        return model.dense_index(self.affinity, "user_id", "user_idx")

    @cached_property
    def als_model(self):
        return model.fit_als(model.index_affinity(self.affinity, self.user_index, self.cat), self.cat)


_INPUTS: dict[tuple[str, str], Inputs] = {}


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INPUTS:
        _INPUTS[key] = Inputs(spark, sf_dir, Catalog())
    return _INPUTS[key]


# -- sources and sinks ---------------------------------------------------------


def q_read_tracking(i: Inputs) -> DataFrame:
    path = new_path(i.spark, "tracking-csv")
    marts.export_csv(i.tracking, path)
    return tracking.read_tracking(i.spark, path)


def q_reordered_log(i: Inputs) -> DataFrame:
    """What is read from a log without event ids, whose columns and times are written another way."""
    path = new_path(i.spark, "reordered-csv")
    marts.export_csv(fixture.reordered_log(i.tracking), path)
    log = events.normalize_events(tracking.read_tracking(i.spark, path, multi_line=False))
    path = new_path(i.spark, "reordered-events")
    tracking.land_events(log, path)
    landed = tracking.read_events(i.spark, path)
    counts = landed.groupBy("user_id").agg(F.count("*").alias("events"), F.max("created_at").alias("newest"))
    firsts = events.pass_through_first(landed, "process_name")
    return counts.join(firsts, "user_id").join(events.latest_activity_hint(landed), "user_id", "left")


def q_pick_timestamp(i: Inputs) -> DataFrame:
    other = i.tracking.withColumnRenamed("created_at", "event_time").withColumn(
        "updated_at", F.lit(None).cast("timestamp_ntz")
    )
    return tracking.pick_timestamp(other).select("event_id", "created_at")


def q_read_marts(i: Inputs) -> DataFrame:
    tables = marts.read_marts(i.spark, i.mart_path)
    users, stats = tables["user_clusters"], tables["user_service_stats"]
    return users.select("user_id", "cluster_id", "active_service").join(stats, "user_id")


def q_write_marts(i: Inputs) -> DataFrame:
    """Written, read back, written again elsewhere and read back: the stored users."""
    path = new_path(i.spark, "marts-copy")
    marts.write_marts(marts.read_marts(i.spark, i.mart_path), path)
    return marts.read_mart(i.spark, path, "user_clusters")


def _explorer(i: Inputs) -> DataFrame:
    return insights.explorer_view(i.user_clusters, i.cat)


def q_export_csv(i: Inputs) -> DataFrame:
    path = new_path(i.spark, "export-csv")
    view = _explorer(i)
    marts.export_csv(view, path)
    reader = i.spark.read.schema(view.schema).option("header", True).option("escape", '"')
    # CSV reads empty text back as missing; the view has no missing text.
    return reader.csv(path).fillna("")


def q_export_json(i: Inputs) -> DataFrame:
    path = new_path(i.spark, "export-json")
    view = _explorer(i)
    marts.export_json(view, path)
    return i.spark.read.schema(view.schema).json(path)


# -- compositions --------------------------------------------------------------


def q_valid_user_ids(i: Inputs) -> DataFrame:
    return events.valid_user_ids(fixture.uuid_like_ids(i.tracking), "external_id")


def q_explorer_filter(i: Inputs) -> DataFrame:
    return insights.explorer_filter(
        i.user_clusters,
        clusters=(0, 1, 2),
        services=("APPLICATION_DRAFTING", "RESEARCH", "QUERY_ANSWER"),
        search=SEARCH_TEXT,
    )


def q_indexed_search(i: Inputs) -> DataFrame:
    """The same rows as of the scan, by the index of three-letter runs."""
    path = new_path(i.spark, "search-index")
    search.write_index(i.user_clusters, path)
    services = ("APPLICATION_DRAFTING", "RESEARCH", "QUERY_ANSWER")
    return search.indexed_filter(i.user_clusters, path, (0, 1, 2), services, SEARCH_TEXT)


def _merged_state(i: Inputs) -> DataFrame:
    """The log in three parts, by event, added in an order of their own; two of them compacted before the third."""
    path = new_path(i.spark, "usage-state")
    for part in (2, 0, 1):
        state.add_part(path, f"third-{part}", i.events.filter(F.col("event_id") % 3 == part), i.cat)
        if part == 0:
            state.compact(i.spark, path)
    return state.read_state(i.spark, path)


def q_merged_affinity(i: Inputs) -> DataFrame:
    return state.state_affinity(_merged_state(i))


def q_merged_last_active(i: Inputs) -> DataFrame:
    return state.state_last_active(_merged_state(i))


def q_extended_index(i: Inputs) -> DataFrame:
    """Users of even numbers first; the others are numbered after them."""
    even = i.affinity.filter(F.col("user_id").cast("long") % 2 == 0)
    return model.extend_index(model.dense_index(even, "user_id", "user_idx"), i.affinity, "user_id", "user_idx")


def q_all_activity(i: Inputs) -> DataFrame:
    """More events a user than Spark limits ranks for."""
    return profile.recent_activity(i.activity, n=5000)


def q_build_percentile(i: Inputs) -> DataFrame:
    """The build in which services used no more than a quarter of their users use them count as gaps."""
    cat = Catalog(settings=replace(i.cat.settings, use_percentile_gaps=True))
    return build.build_user_clusters(i.events, i.names, cat, i.scorer)


def q_gap_thresholds(i: Inputs) -> DataFrame:
    return affinity.gap_thresholds(i.affinity, i.cat.settings.gap_usage_percentile / 100.0)


def q_adopted_services(i: Inputs) -> DataFrame:
    return gaps.adopted_services(i.affinity, q_gap_thresholds(i), i.cat)


def q_missing_users(i: Inputs) -> DataFrame:
    """Users of every service have no gap to score, so the model leaves them out."""
    top = ranking.topn_per_user(i.scored_gaps, i.cat)
    recs = ranking.spread_ranks(i.active, top).filter(F.col("cross_recommend_1").isNotNull())
    return gaps.missing_users(i.affinity, recs, i.cat)


def q_label_join(i: Inputs) -> DataFrame:
    coded = i.events.select(
        "event_id", "process_type", i.cat.cluster_of(F.col("process_type")).alias("cluster_id")
    )
    return naming.label_join(coded, i.cat, "process_type", "cluster_id", "Unknown")


def q_restore_names(i: Inputs) -> DataFrame:
    return naming.restore_names(i.active, i.names)


def q_profile_gaps(i: Inputs) -> DataFrame:
    return gaps.profile_gaps(i.active, i.affinity, i.cat)


def q_gap_status(i: Inputs) -> DataFrame:
    users = i.user_clusters
    return profile.gap_status(gaps.profile_gaps(users, i.affinity, i.cat), users)


def q_user_profile(i: Inputs) -> DataFrame:
    return profile.user_profile(i.user_clusters, i.cat)


def _fixed_scores(i: Inputs, services: int, n: int) -> DataFrame:
    return model.score_factors(*fixture.fixed_factors(i.user_index, services), n)


def q_score_all(i: Inputs) -> DataFrame:
    return _fixed_scores(i, len(i.cat.core), 3)


def q_decode_index(i: Inputs) -> DataFrame:
    """Every number is moved by one, so the last user and a sixth service are unknown."""
    scored = _fixed_scores(i, len(i.cat.core) + 1, len(i.cat.core) + 1)
    moved = scored.withColumn("user_idx", F.col("user_idx") + 1)
    return model.decode_index(moved, i.user_index, i.cat)


def q_fit_als(i: Inputs) -> DataFrame:
    """What must hold for any fitted model: as many factors as users and services, all of them
    numbers that are not negative, and a loss below that of knowing nothing."""
    als, params, n = i.als_model, model.AlsParams(), len(i.cat.core)
    features = als.userFactors.union(als.itemFactors).select(F.explode("features").alias("v"))
    bad = features.agg(F.count_if(F.col("v").isNull() | F.isnan("v") | (F.col("v") < 0)).alias("bad_values"))
    indexed = model.index_affinity(i.affinity, i.user_index, i.cat)
    pairs = model.score_all(als, n).join(indexed, ["user_idx", "process_idx"], "left")
    used = F.col("interaction_count").isNotNull()
    weight = 1 + params.alpha * F.coalesce("interaction_count", F.lit(0))
    loss = pairs.agg(
        F.count("*").alias("pairs"),
        F.sum(weight * F.pow(used.cast("double") - F.col("score"), 2)).alias("loss"),
        F.sum(F.when(used, weight)).alias("without"),
    )
    return (
        als.userFactors.agg(F.count_distinct("id").alias("users"), F.min(F.size("features")).alias("rank"))
        .join(als.itemFactors.agg(F.count_distinct("id").alias("services")))
        .join(bad)
        .join(loss)
        .select(
            "users", "services", "rank", "bad_values", "pairs",
            (F.col("loss") < 0.5 * F.col("without")).alias("lowers_loss"),
        )
    )


def q_k_sweep(i: Inputs) -> DataFrame:
    """Which K were tried, and how many of them have measures that are possible."""
    vectors = model.usage_vectors(affinity.usage_matrix(i.affinity, i.cat), i.cat)
    parts = vectors.select(F.posexplode(vector_to_array("features")).alias("at", "v"))
    spread = parts.groupBy("at").agg(F.var_pop("v") * F.count("*")).toDF("at", "s").agg(F.sum("s").alias("most"))
    swept = model.k_sweep(affinity.usage_matrix(i.affinity, i.cat), i.cat)
    possible = F.col("silhouette").between(-1, 1) & F.col("inertia").between(0, F.col("most"))
    return swept.join(spread).agg(
        F.min("k").alias("k_min"), F.max("k").alias("k_max"), F.count("*").alias("tried"),
        F.count_if(possible).alias("possible"), F.count_if("is_best").alias("best"),
    )


def q_kmeans_segments(i: Inputs) -> DataFrame:
    found = model.kmeans_segments(affinity.usage_matrix(i.affinity, i.cat), i.cat)
    return found.agg(
        F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"),
        F.count_distinct("kmeans_cluster").alias("segments"), F.count_if(F.col("kmeans_cluster").isNull()).alias("without"),
    )


def build_with_als(i: Inputs) -> DataFrame:
    return build.build_user_clusters(i.events, i.names, i.cat, partial(build.als_scores, cat=i.cat))


def q_build_with_als(i: Inputs) -> DataFrame:
    """What must hold for a build with any trained model, over all users: where their first recommendation
    comes from, and how many rows break a rule."""
    used = i.affinity.groupBy("user_id").agg(F.collect_set("process_type").alias("used"))
    rows = build_with_als(i).join(used, "user_id", "full")
    one, two = F.col("cross_recommend_1"), F.col("cross_recommend_2")
    first, second = F.col("rec1_source"), F.col("rec2_source")
    new = ~F.array_contains("used", one) & F.coalesce(~F.array_contains("used", two), F.lit(True))
    rules = (
        F.col("user_id").isNotNull() & one.isNotNull() & F.coalesce(one != two, F.lit(True))
        & (two.isNull() == second.isNull()) & (second.isNull() == F.col("rec2_score").isNull())
        & F.when(first == "als", new & (F.col("rec1_score") == 88) & F.coalesce(F.col("rec2_score") == 58, F.lit(True)))
        .when(first == "usage", (F.col("rec1_score") == 65) & (F.col("rec2_score") == 52))
        .otherwise(False)
    )
    return rows.agg(
        F.count("*").alias("users"),
        F.count_if(first == "als").alias("from_model"),
        F.count_if(first == "usage").alias("full_profiles"),
        F.count_if(two.isNull()).alias("one_gap"),
        F.count_if(~F.coalesce(rules, F.lit(False))).alias("broken"),
    )


def _titles(i: Inputs, cleaned) -> DataFrame:
    title = cleaned(F.col("process_name")).alias("title")
    return i.tracking.select("event_id", title)


def q_display_name(i: Inputs) -> DataFrame:
    title = text.clean_title(F.col("process_name"))
    return i.tracking.select(
        "event_id", text.display_name(title, F.col("user_id"), enrich.UNKNOWN_USER).alias("name")
    )


def _preview(i: Inputs) -> DataFrame:
    return quality.preview(i.user_clusters, ["user_id"])


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {
    # sources and sinks
    "read_tracking": q_read_tracking,
    "reordered_log": q_reordered_log,
    "pick_timestamp": q_pick_timestamp,
    "read_marts": q_read_marts,
    "write_marts": q_write_marts,
    "export_csv": q_export_csv,
    "export_json": q_export_json,
    # projection and predicates
    "normalize_events": lambda i: events.normalize_events(i.tracking),
    "completed_core": lambda i: i.completed,
    "normalization_audit": lambda i: events.normalization_audit(i.tracking, i.cat),
    "user_activity": lambda i: events.user_activity(i.completed),
    "valid_user_ids": q_valid_user_ids,
    "explorer_filter": q_explorer_filter,
    "indexed_search": q_indexed_search,
    "explorer_view": _explorer,
    # aggregations
    "affinity": lambda i: affinity.affinity(i.completed),
    "user_service_stats": lambda i: affinity.user_service_stats(affinity.affinity(i.completed)),
    "affinity_summary": lambda i: affinity.affinity_summary(i.affinity),
    "service_totals": lambda i: affinity.service_totals(i.affinity),
    "usage_matrix": lambda i: affinity.usage_matrix(i.affinity, i.cat),
    "gap_thresholds": q_gap_thresholds,
    "last_active": lambda i: events.last_active(i.completed),
    "merged_affinity": q_merged_affinity,
    "merged_last_active": q_merged_last_active,
    "pass_through_first": lambda i: events.pass_through_first(i.events, "process_name"),
    "latest_activity_hint": lambda i: events.latest_activity_hint(i.events),
    "used_services": lambda i: affinity.used_services(i.affinity),
    "cluster_dist": lambda i: insights.cluster_dist(i.cells),
    "service_by_cluster": lambda i: insights.service_by_cluster(i.cells),
    "rec_frequency": lambda i: insights.rec_frequency(i.cells),
    "rec_coverage_pct": lambda i: insights.rec_coverage_pct(i.cells),
    "platform_kpis": lambda i: insights.platform_kpis(i.cells, i.activity),
    "cluster_summary": lambda i: insights.cluster_summary(i.cells, i.cat),
    "rec_sources": lambda i: insights.rec_sources(i.cells),
    # rankings
    "active_service": lambda i: i.active,
    "global_rank": lambda i: ranking.global_rank(i.affinity, i.cat),
    "peer_rank": lambda i: ranking.peer_rank(i.affinity, i.active, i.cat),
    "topn_per_user": lambda i: ranking.topn_per_user(i.scored_gaps, i.cat),
    "spread_ranks": lambda i: i.model_slots,
    "top_users": lambda i: insights.top_users(i.user_clusters, i.affinity, i.cat),
    "user_stats": lambda i: profile.user_stats(i.affinity),
    "all_activity": q_all_activity,
    "recent_activity": lambda i: profile.recent_activity(i.activity),
    "users_by_cluster": lambda i: insights.users_by_cluster(i.user_clusters, BROWSED_CLUSTER),
    "lookup_user": lambda i: profile.lookup_user(i.user_clusters, LOOKUP_ID),
    "sample_users": lambda i: insights.sample_users(i.user_clusters, SAMPLE_SIZE),
    # joins
    "adopted_services": q_adopted_services,
    "gap_candidates": lambda i: i.scored_gaps,
    "missing_users": q_missing_users,
    "profile_gaps": q_profile_gaps,
    "restore_names": q_restore_names,
    "attach_activity_names": lambda i: naming.attach_activity_names(i.activity, i.events),
    "label_join": q_label_join,
    "user_directory": lambda i: naming.user_directory(i.user_clusters),
    "segment_directory": lambda i: naming.segment_directory(i.user_clusters, i.cat),
    # model
    "dense_index": lambda i: i.user_index,
    "extended_index": q_extended_index,
    "fit_als": q_fit_als,
    "score_all": q_score_all,
    "decode_index": q_decode_index,
    "k_sweep": q_k_sweep,
    "kmeans_segments": q_kmeans_segments,
    # recommendation assembly
    "assign_segment": lambda i: fill.assign_segment(i.active, i.cat),
    "fill_gaps": lambda i: fill.fill_gaps(i.model_slots, i.affinity, i.cat),
    "fill_gaps_no_model": lambda i: fill.fill_gaps(i.empty_slots, i.affinity, i.cat),
    "usage_growth": lambda i: fill.usage_growth(i.affinity, i.cat),
    "enrich_recs": lambda i: fill.enrich_recs(i.user_clusters, i.affinity, i.cat),
    "enrich_recs_empty": lambda i: fill.enrich_recs(i.empty_slots, i.affinity, i.cat),
    "enrich_user_clusters": lambda i: enrich.enrich_user_clusters(
        i.user_clusters, i.affinity, i.events, i.names, i.cat
    ),
    "serve_time_fill": lambda i: fill.serve_time_fill(i.empty_slots, i.affinity, i.cat),
    "build_user_clusters": lambda i: build.build_user_clusters(
        i.events, i.names, i.cat, i.scorer
    ),
    "build_user_clusters_percentile": q_build_percentile,
    "build_user_clusters_no_model": lambda i: build.build_user_clusters(
        i.events, i.names, i.cat
    ),
    "build_user_clusters_als": q_build_with_als,
    # single users, for all of them
    "user_summary": lambda i: profile.user_summary(i.affinity, i.activity, i.cat),
    "service_share": lambda i: profile.service_share(i.affinity, i.cat),
    "gap_status": q_gap_status,
    "rec_cards": lambda i: profile.rec_cards(i.user_clusters, i.cat),
    "user_profile": q_user_profile,
    "outreach_audience": lambda i: profile.outreach_audience(q_user_profile(i)),
    # titles
    "clean_title_short": lambda i: _titles(i, text.clean_title_short),
    "clean_title": lambda i: _titles(i, text.clean_title),
    "display_name": q_display_name,
    # quality
    "table_profile": lambda i: quality.table_profile(marts.read_marts(i.spark, i.mart_path)),
    "null_audit": lambda i: quality.null_audit(i.cells),
    "preview": _preview,
}


def queries() -> dict[str, Query]:
    def bind(run: Callable[[Inputs], DataFrame]) -> Query:
        return lambda spark, sf_dir: run(inputs(spark, sf_dir))

    return {name: bind(run) for name, run in QUERIES.items()}

"""What is shown about single users, computed for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.catalog import (
    DEFAULT_ACTIVE_SERVICE,
    DEFAULT_CLUSTER,
    Catalog,
    source_wording,
)
from gapwise.functions.scores import fit_percent, percent
from gapwise.functions.text import blank_to_null, short_id, valid_name
from gapwise.operators.affinity import service_profiles

# Events shown per user.
RECENT_EVENTS = 20

# Groups of tasks over which the events of a user are spread when many of them are asked for.
ACTIVITY_GROUPS = 64

# The outreach message.
OUTREACH_DOMAIN = "example.com"
OUTREACH_SUBJECT = "⚡ Discover {service} on {product}"
OUTREACH_BODY = (
    "Dear {name},\n\n"
    "We noticed you've been actively using our {active} service on {product}. "
    "To streamline your workflow even further, we highly recommend trying out {service}.\n\n"
    "Based on your service usage profile, similar practitioners who use {active} found {service} "
    "to be extremely valuable for their practice.\n\n"
    "Try {service} today: {site}/services/{code}\n\n"
    "Best regards,\nThe {product} Team"
)
MIN_SLUG_LENGTH = 3


def only_user(df: DataFrame, user_id: str | None) -> DataFrame:
    return df if user_id is None else df.filter(F.col("user_id") == user_id.strip())


def lookup_user(user_clusters: DataFrame, user_id: str) -> DataFrame:
    """One user by trimmed id; the filter reaches the sorted files."""
    return only_user(user_clusters, user_id)


def user_stats(stats: DataFrame, user_id: str | None = None) -> DataFrame:
    """Use counts per service, most used first; for one user or for every user.

    Every user's rows are together and in order; users themselves are in no order, which would be
    a sort of the whole table.
    """
    rows = only_user(stats, user_id).select("user_id", "process_type", "interaction_count")
    if user_id is None:
        rows = rows.repartition("user_id")
        return rows.sortWithinPartitions(
            "user_id", F.col("interaction_count").desc(), "process_type"
        )
    return rows.orderBy(F.col("interaction_count").desc(), "process_type")


def recent_activity(
    activity: DataFrame, user_id: str | None = None, n: int = RECENT_EVENTS
) -> DataFrame:
    """Each user's newest ``n`` events, of one user or of every user.

    Up to the number of rows for which Spark limits ranks before a shuffle, each task sends at most ``n`` events of
    a user however many that user has.  For more, the events are ranked twice: first by user and group of tasks,
    so a user is spread over groups and at most ``n`` rows of each are left, then by user.
    """
    newest = [F.col(c).desc_nulls_last() for c in ("created_at", "event_id", "process_type", "process_name")]
    rows = only_user(activity, user_id)
    if n > int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        group = F.pmod(F.spark_partition_id(), F.lit(ACTIVITY_GROUPS))  # any division gives the same rows
        within = Window.partitionBy("user_id", "__group").orderBy(*newest)
        ranked = rows.withColumn("__group", group).withColumn("__rank", F.row_number().over(within))
        rows = ranked.filter(F.col("__rank") <= n).drop("__group", "__rank")
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy(*newest)))
    return ranked.filter(F.col("position") <= n)


def user_summary(affinity_df: DataFrame, activity: DataFrame, cat: Catalog) -> DataFrame:
    """Totals of every user: actions, services, gaps, top service, recent events."""
    events = activity.groupBy("user_id").agg(F.count("*").alias("events"))
    used = F.col("usage.process_type")
    return (
        service_profiles(affinity_df, cat)
        .join(events, "user_id", "left")
        .select(
            "user_id",
            "total_actions",
            F.size("usage").alias("services_used"),
            F.size(F.array_except(cat.core_array(), used)).alias("gap_count"),
            F.array_max("usage.interaction_count").alias("top_service_count"),
            F.least(F.coalesce("events", F.lit(0)), F.lit(RECENT_EVENTS))
            .cast("long")
            .alias("recent_events"),
        )
    )


def service_share(affinity_df: DataFrame, cat: Catalog) -> DataFrame:
    """Each service's share of a user's actions, and whether it is the primary one."""
    entry = F.col("entry")
    rows = service_profiles(affinity_df, cat).withColumn("entry", F.explode("usage"))
    count = entry.getField("interaction_count")
    return rows.select(
        "user_id",
        entry.getField("process_type").alias("process_type"),
        count.alias("interaction_count"),
        percent(count, F.col("total_actions")).alias("share_pct"),
        (entry.getField("process_type") == F.col("active_service")).alias("is_primary"),
    )


def gap_status(gaps: DataFrame, user_clusters: DataFrame) -> DataFrame:
    """Each gap of a user as first recommendation, second recommendation or open gap."""
    recs = user_clusters.select("user_id", "cross_recommend_1", "cross_recommend_2")
    code = F.col("process_type")
    status = (
        F.when(code == F.col("cross_recommend_1"), "Rec #1")
        .when(code == F.col("cross_recommend_2"), "Rec #2")
        .otherwise("Open gap")
    )
    return (
        gaps.filter("is_gap")
        .join(recs, "user_id", "left")
        .select("user_id", "position", "process_type", status.alias("gap_status"))
    )


def rec_cards(user_clusters: DataFrame, cat: Catalog) -> DataFrame:
    """A row per user and filled slot: label, fit and source as shown."""

    def card(slot: int) -> Column:
        return F.struct(
            F.lit(slot).alias("rank"),
            F.col(f"cross_recommend_{slot}").alias("service"),
            F.col(f"rec{slot}_name").alias("name"),
            F.col(f"rec{slot}_score").alias("score"),
            F.col(f"rec{slot}_source").alias("source"),
        )

    cards = user_clusters.select("user_id", F.inline(F.array(card(1), card(2))))
    fit = fit_percent(F.col("score"))
    fit_text = F.coalesce(
        F.concat(fit.cast("string"), F.lit("% fit")), F.lit("Ranked by platform trends")
    )
    return cards.filter(F.col("service") != "").select(
        "user_id",
        "rank",
        "service",
        F.coalesce(blank_to_null(F.col("name")), cat.service_label(F.col("service"))).alias("label"),
        fit.alias("fit"),
        fit_text.alias("fit_text"),
        source_wording(F.col("source")).alias("source_text"),
    )


def user_profile(user_clusters: DataFrame, cat: Catalog) -> DataFrame:
    """Every user with display defaults in place of what is missing."""
    cluster = F.coalesce("cluster_id", F.lit(DEFAULT_CLUSTER))
    active = F.coalesce(blank_to_null(F.col("active_service")), F.lit(DEFAULT_ACTIVE_SERVICE))

    def rec_name(slot: int) -> Column:
        return F.coalesce(
            blank_to_null(F.col(f"rec{slot}_name")),
            cat.service_label(F.col(f"cross_recommend_{slot}")),
        )

    return user_clusters.select(
        "user_id",
        F.coalesce(valid_name(F.col("Name")), short_id(F.col("user_id"))).alias("display_name"),
        cluster.alias("cluster_id"),
        F.coalesce(
            blank_to_null(F.col("segment_name")),
            cat.known_segment(cluster),
            cat.known_segment(F.lit(DEFAULT_CLUSTER)),
        ).alias("segment_name"),
        active.alias("active_service"),
        F.coalesce(
            blank_to_null(F.col("active_service_name")), cat.service_label(active)
        ).alias("active_service_name"),
        blank_to_null(F.col("cross_recommend_1")).alias("cross_recommend_1"),
        rec_name(1).alias("rec1_name"),
        "rec1_score",
        F.coalesce("rec1_source", F.lit("als")).alias("rec1_source"),
        blank_to_null(F.col("cross_recommend_2")).alias("cross_recommend_2"),
        rec_name(2).alias("rec2_name"),
        "rec2_score",
        F.coalesce("rec2_source", F.lit("als")).alias("rec2_source"),
        "last_active_at",
    )


def fill_template(template: str, **values: Column) -> Column:
    """A text template with ``{name}`` fields as one concatenation of columns."""
    parts: list[Column] = []
    for piece in template.split("{"):
        field, closed, text = piece.partition("}")
        if closed:
            parts += [values[field], F.lit(text)]
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def outreach_audience(
    profiles: DataFrame, product: str = "Gapwise", site: str = "https://example.com"
) -> DataFrame:
    """Recipient, subject and body for every user with a first recommendation.  Nothing is sent."""
    name = F.col("display_name")
    letters = F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))
    from_id = F.concat(F.lit("user_"), F.substring("user_id", 1, 8))
    usable = (F.length(letters) >= MIN_SLUG_LENGTH) & (letters != "nan")
    slug = F.when(usable, letters).otherwise(from_id)
    fields = {
        "name": name,
        "active": F.col("active_service_name"),
        "service": F.col("rec1_name"),
        "code": F.lower("cross_recommend_1"),
        "product": F.lit(product),
        "site": F.lit(site),
    }
    return profiles.filter(F.col("cross_recommend_1").isNotNull()).select(
        "user_id",
        F.concat(slug, F.lit("@" + OUTREACH_DOMAIN)).alias("recipient"),
        fill_template(OUTREACH_SUBJECT, **fields).alias("subject"),
        fill_template(OUTREACH_BODY, **fields).alias("body"),
    )

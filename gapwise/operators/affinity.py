"""Completed uses per user and service, and the tables derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapwise.catalog import Catalog, lookup
from gapwise.operators.events import first_values, is_completed_core
from gapwise.storage import materialize


def affinity(completed: DataFrame) -> DataFrame:
    """Completed uses per user and service; counted before the shuffle, so no user is too hot."""
    return completed.groupBy("user_id", "process_type").agg(
        F.count("*").alias("interaction_count")
    )


def user_service_stats(affinity_df: DataFrame) -> DataFrame:
    return affinity_df.select("user_id", "process_type", "interaction_count")


def affinity_summary(affinity_df: DataFrame) -> DataFrame:
    """Distinct users and distinct services.

    Users are counted from one row per user, services from one row per service; counting both
    in one aggregate would double every row first.
    """
    users = affinity_df.select("user_id").distinct().agg(F.count("user_id").alias("users"))
    services = affinity_df.groupBy("process_type").agg(F.count("*").alias("uses"))
    return users.select(
        "users", services.agg(F.count("process_type")).scalar().alias("services")
    )


def service_totals(stats: DataFrame) -> DataFrame:
    """Completed uses per service, most used first."""
    totals = stats.groupBy("process_type").agg(F.sum("interaction_count").alias("total"))
    return totals.orderBy(F.col("total").desc(), "process_type")


def usage_matrix(affinity_df: DataFrame, cat: Catalog) -> DataFrame:
    """User by core-service matrix of use counts, zero-filled.

    The columns are known from the catalogue, so one conditional aggregate per
    service does it in a single shuffle; a pivot would aggregate twice.
    """
    cells = [
        F.coalesce(
            F.sum(F.when(F.col("process_type") == code, F.col("interaction_count"))), F.lit(0)
        ).alias(code)
        for code in cat.core
    ]
    return affinity_df.groupBy("user_id").agg(*cells)


def gap_thresholds(affinity_df: DataFrame, p: float) -> DataFrame:
    """The exact discrete p-th percentile (0..1) of the use counts of each service.

    The least count that at least a share ``p`` of the service's users do not exceed.  Users are counted per
    service and count first, combined before the shuffle; what is ordered are the different counts alone.
    """
    histogram = affinity_df.groupBy("process_type", "interaction_count").agg(F.count("*").alias("users"))
    service = Window.partitionBy("process_type")
    upto = F.sum("users").over(service.orderBy("interaction_count").rowsBetween(Window.unboundedPreceding, 0))
    enough = F.greatest(F.ceil(F.sum("users").over(service) * p), F.lit(1))
    reached = histogram.select("process_type", "interaction_count", upto.alias("upto"), enough.alias("enough"))
    return (
        reached.filter(F.col("upto") >= F.col("enough"))
        .groupBy("process_type")
        .agg(F.min("interaction_count").alias("gap_threshold"))
    )


def used_services(affinity_df: DataFrame) -> DataFrame:
    """Each user's services, kept relational for joins.

    The affinity table has one row per pair, so there is nothing to make distinct.
    """
    return affinity_df.select("user_id", "process_type")


# -- one row per user -------------------------------------------------------
#
# ``usage`` holds a user's services from least to most used, as
# struct<interaction_count, priority, process_type>.  A service occurs once, so
# the array is never longer than the list of services.


def _ascending(count: Column, service: Column, cat: Catalog) -> Column:
    return F.struct(
        count.alias("interaction_count"),
        cat.priority_of(service).alias("priority"),
        service.alias("process_type"),
    )


def _descending(count: Column, service: Column, cat: Catalog) -> Column:
    return F.struct(
        (-count).alias("negated"),
        cat.priority_of(service).alias("priority"),
        service.alias("process_type"),
    )


def service_profiles(affinity_df: DataFrame, cat: Catalog) -> DataFrame:
    """One row per user: usage, most used service and total, from the affinity table."""
    count, service = F.col("interaction_count"), F.col("process_type")
    return affinity_df.groupBy("user_id").agg(
        F.min(_descending(count, service, cat)).getField("process_type").alias("active_service"),
        F.sort_array(F.collect_list(_ascending(count, service, cat))).alias("usage"),
        F.sum("interaction_count").alias("total_actions"),
    )


def user_rollup(events: DataFrame, cat: Catalog, pass_through: tuple[str, ...] = ()) -> DataFrame:
    """Everything the event log says about a user: one row each.

    Like :func:`service_profiles`, plus the time of the last completed use and
    the pass-through columns.  Takes normalised events; users without a
    completed use of a core service are left out.

    Counts, last use and the times of the first values are of fixed width, so one hash aggregate over one scan combines
    them before the shuffle and a user leaves each task as one row.  These rows are stored; text is then taken from the
    events at the stored times alone.  Events without a user are one user, without first values.  Runs the job
    that stores the rows.
    """
    completed = is_completed_core(cat)
    place = lookup({code: i for i, code in enumerate(cat.core)}, F.col("process_type"), "int")
    narrow = (events if pass_through else events.filter(completed)).select(
        "user_id", "created_at", F.when(completed, place).alias("place"),
        *[F.col(col).isNotNull().alias(col) for col in pass_through],
    )
    counts = [F.count_if(F.col("place") == i).alias(code) for i, code in enumerate(cat.core)]
    times = [F.min(F.when(F.col(col), F.col("created_at"))).alias(f"first_{col}_at") for col in pass_through]
    last = F.max(F.when(F.col("place").isNotNull(), F.col("created_at"))).alias("last_active_at")
    total = sum((F.col(c) for c in cat.core[1:]), F.col(cat.core[0]))
    rows = narrow.groupBy("user_id").agg(*counts, last, *times).filter(total > 0)
    if pass_through:
        rows = materialize(rows, "user-counts")
    for col in pass_through:
        known = rows.filter(F.col("user_id").isNotNull())
        first = first_values(events.filter(F.col("user_id").isNotNull()), known, col, f"first_{col}_at")
        rows = rows.join(first.withColumnRenamed(col, f"first_{col}"), "user_id", "left")

    def used(entry) -> Column:
        cells = [F.when(F.col(c) > 0, entry(F.col(c), F.lit(c), cat)) for c in cat.core]
        return F.array_compact(F.array(*cells))

    return rows.select(
        "user_id",
        F.array_min(used(_descending)).getField("process_type").alias("active_service"),
        F.sort_array(used(_ascending)).alias("usage"),
        total.alias("total_actions"),
        "last_active_at",
        *[F.col(f"first_{col}").alias(col) for col in pass_through],
    )


def usage_counts(services: Sequence[str]) -> list[Column]:
    """For per-user rows with ``usage``: the count of each service, zero where it is not used."""

    def count(code: str) -> Column:
        entry = F.get(F.filter("usage", lambda u: u.getField("process_type") == code), 0)
        return F.coalesce(entry.getField("interaction_count"), F.lit(0))

    return [count(code) for code in services]


def profile_matrix(profiles: DataFrame, cat: Catalog) -> DataFrame:
    """The usage matrix from per-user rows, without a shuffle."""
    counts = zip(usage_counts(cat.core), cat.core)
    return profiles.select("user_id", *[count.alias(code) for count, code in counts])


def profile_affinity(profiles: DataFrame) -> DataFrame:
    """The affinity table back from per-user rows, without a shuffle."""
    return profile_uses(profiles).select("user_id", "process_type", "interaction_count")


def profile_uses(profiles: DataFrame) -> DataFrame:
    """Like :func:`profile_affinity`, with each user's active service."""
    entry = F.col("entry")
    return profiles.select("user_id", "active_service", F.explode("usage").alias("entry")).select(
        "user_id",
        "active_service",
        entry.getField("process_type").alias("process_type"),
        entry.getField("interaction_count").alias("interaction_count"),
    )

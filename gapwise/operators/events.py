"""Operators over the event log.

All but the first and the audit take normalised events, so that their filters
are plain comparisons that reach the Parquet scan of landed events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.catalog import Catalog
from gapwise.functions.text import UUID_PATTERN, clean_title, strip
from gapwise.storage import materialize

COMPLETED = "COMPLETED"


def event_order() -> Column:
    """Time order of events: missing times last, ties by event id, then by content.

    A log without event ids is thereby ordered too: events that still tie are equal in all
    that any operator takes from them.
    """
    return F.struct(
        F.col("created_at").isNull(),
        F.col("created_at"),
        F.col("event_id"),
        F.col("process_type"),
        F.col("process_name"),
    )


def normalize_events(tracking: DataFrame) -> DataFrame:
    """Status and service code in upper case, ids without outer space."""
    return tracking.withColumns(
        {
            "user_id": strip(F.col("user_id")),
            "status": F.upper("status"),
            "process_type": F.upper("process_type"),
        }
    )


def is_completed_core(cat: Catalog) -> Column:
    """Condition on normalised events; NULL status or service is not a completed use."""
    return (F.col("status") == COMPLETED) & cat.is_core(F.col("process_type"))


def completed_core(events: DataFrame, cat: Catalog) -> DataFrame:
    """Completed uses of core services, from normalised events."""
    return events.filter(is_completed_core(cat))


def normalization_audit(tracking: DataFrame, cat: Catalog) -> DataFrame:
    """Rows before and after normalise-and-filter, and under a case-sensitive status filter."""
    normalized = (F.upper("status") == COMPLETED) & cat.is_core(F.upper("process_type"))
    return tracking.agg(
        F.count("*").alias("raw_rows"),
        F.count_if(normalized).alias("completed_core_rows"),
        F.count_if(F.col("status") == COMPLETED).alias("strict_status_rows"),
    )


def user_activity(completed: DataFrame) -> DataFrame:
    """The completed events as stored; the event id orders events of the same time."""
    return completed.select(
        "event_id", "user_id", "process_type", "status", "process_name", "created_at"
    )


def valid_user_ids(df: DataFrame, col: str = "user_id") -> DataFrame:
    """Rows whose id is a canonical UUID, in either case."""
    return df.filter(F.col(col).rlike(UUID_PATTERN))


def last_active(completed: DataFrame) -> DataFrame:
    return completed.groupBy("user_id").agg(F.max("created_at").alias("last_active_at"))


# -- first and latest values ------------------------------------------------
#
# Text only fits an aggregate that sorts.  So the extreme time of each user is found first, from columns of
# fixed width that a hash aggregate holds, and text is taken from the events of that time alone: one a user
# where times differ.


def first_time(col: str) -> Column:
    """Aggregate of fixed width: time of the earliest event with a ``col``; NULL if none of them has a time."""
    return F.min(F.when(F.col(col).isNotNull(), F.col("created_at")))


def events_at(events: DataFrame, times: DataFrame, at: str = "at") -> DataFrame:
    """Events of the time that ``times`` (``user_id`` and ``at``, a row per user) gives their user; NULL matches NULL.

    They meet by a hash of user and time, one number that is cheap to look up and leaves no user hot, so an event
    of another time may be among them: what is taken from the result must again be the extreme one.  ``times``
    should be a stored table: then Spark knows its size, and a small one goes to the events.
    """
    wanted = times.select(F.xxhash64("user_id", at).alias("wanted"))
    return events.join(wanted, F.xxhash64("user_id", "created_at") == F.col("wanted"), "left_semi")


def first_values(events: DataFrame, times: DataFrame, col: str, at: str = "at") -> DataFrame:
    """Earliest non-NULL ``col`` of the users in ``times``, which has their :func:`first_time`; users without one are left out."""
    found = events_at(events.filter(F.col(col).isNotNull()), times, at)
    return found.groupBy("user_id").agg(F.min_by(col, event_order()).alias(col))


def pass_through_first(events: DataFrame, col: str) -> DataFrame:
    """Earliest non-NULL value of ``col`` per user, over events of any status; runs the job that stores the times."""
    times = materialize(events.groupBy("user_id").agg(first_time(col).alias("at")), "first-times")
    found = first_values(events, times, col).select(F.col("user_id").alias("found_id"), col)
    same = F.col("user_id").eqNullSafe(F.col("found_id"))
    return times.select("user_id").join(found, same, "left").select("user_id", col)


def latest_activity_hint(events: DataFrame) -> DataFrame:
    """Cleaned title of each user's latest completed event, of whatever service; runs the job that stores the times.

    The latest event decides even if it has no title, and an event without a
    time counts as the latest; users without a usable title are left out.
    """
    completed = events.filter((F.col("status") == COMPLETED) & F.col("user_id").isNotNull())
    untimed = F.count_if(F.col("created_at").isNull()) > 0
    newest = F.when(~untimed, F.max("created_at"))
    times = materialize(completed.groupBy("user_id").agg(newest.alias("at")), "latest-times")
    latest = events_at(completed, times).groupBy("user_id").agg(F.max_by("process_name", event_order()).alias("title"))
    return latest.select("user_id", clean_title(F.col("title")).alias("hint")).filter(
        F.col("hint").isNotNull()
    )

"""The generated event and customer tables, seen as an event log and a names table.

The generated users have used everything, so the status is derived from the
number in ``props``; that leaves each user with one to five services.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.catalog import Catalog

# Service for each generated event type, in mixed case on purpose.
SERVICE_OF_EVENT = {
    "purchase": "application_drafting",
    "click": "Research",
    "view": "QUERY_ANSWER",
    "signup": "synopsis_generation",
    "error": "DOCUMENT_EMBEDDING",
}


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The number gets a column of its own, so that the JSON is parsed once per row.
    number = F.get_json_object("props", "$.k").cast("int")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", number)
    k = F.col("k")
    kind = F.col("event_type")
    event_id = F.col("event_id").cast("string")
    service = F.when(k == 99, "legacy_export")
    for event_type, code in SERVICE_OF_EVENT.items():
        service = service.when(kind == event_type, code)
    status = (
        F.when(k == 98, F.lit(None).cast("string"))
        .when(k < 5, "completed")
        .when((k < 10) | (k == 99), "COMPLETED")
        .otherwise("failed")
    )
    title = (
        F.when(k % 11 == 0, F.lit(None).cast("string"))
        .when(kind == "click", F.concat(F.lit("Async Research: item "), event_id))
        .when(kind == "view", F.concat(F.lit("Async Query: " + "long title " * 7), event_id))
        .when(kind == "signup", F.concat(F.lit("Conversation Record Turn "), event_id))
        .otherwise(F.concat(F.lit(" Async job "), event_id))
    )
    return events.select(
        "event_id",
        F.col("user_id").cast("string").alias("user_id"),
        service.alias("process_type"),
        status.alias("status"),
        title.alias("process_name"),
        F.col("ts").alias("created_at"),
    )


def names_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    name = (
        F.when(key % 7 == 0, "")
        .when(key % 11 == 0, "nan")
        .when(key % 13 == 0, F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")))
        .otherwise(F.col("c_name"))
    )
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customers.select(key.cast("string").alias("user_id"), name.alias("Name"))


def fixed_scores(users: DataFrame, cat: Catalog) -> DataFrame:
    """A deterministic stand-in for model scores: every user and service, with ties for every user."""
    pairs = users.select("user_id", F.explode(cat.core_array()).alias("process_type"))
    rank = cat.priority_of(F.col("process_type"))
    score = ((F.col("user_id").cast("long") * 31 + rank * rank * 17) % 5) / 5.0
    return pairs.withColumn("score", score.cast("double"))


def fixed_score_array(cat: Catalog) -> Column:
    """The scores of :func:`fixed_scores` as an array in the user's row."""
    ranks = [cat.priority_of(F.lit(code)) for code in cat.core]
    scores = [((F.col("user_id").cast("long") * 31 + r * r * 17) % 5) / 5.0 for r in ranks]
    return F.array(*[s.cast("double") for s in scores])


def fixed_factors(index: DataFrame, services: int) -> tuple[DataFrame, DataFrame]:
    """Stand-ins for a model's factors: of the numbered users, and of the services."""
    number = F.col("user_idx")
    users = index.select(
        number.alias("id"),
        F.array((number * 7 % 11) / 8.0, (number * 3 % 5) / 4.0).cast("array<float>").alias("features"),
    )
    number = F.col("id")
    items = index.sparkSession.range(services).select(
        number.cast("int").alias("id"),
        F.array((number + 1) / 2.0, (number * number % 3) / 4.0).cast("array<float>").alias("features"),
    )
    return users, items


def reordered_log(tracking_df: DataFrame) -> DataFrame:
    """The log as other systems write it: no event id, columns in another order, times as text with an offset.

    Odd events tell the time of a zone five and a half hours ahead.
    """
    odd = F.col("event_id") % 2 == 1
    ahead = F.col("created_at") + F.expr("INTERVAL '5:30' HOUR TO MINUTE")
    text = F.date_format(F.when(odd, ahead).otherwise(F.col("created_at")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return tracking_df.select(
        "status",
        "process_name",
        F.concat(text, F.when(odd, "+05:30").otherwise("Z")).alias("event_time"),
        F.concat(F.lit(" "), "user_id").alias("user_id"),
        "process_type",
    )


def uuid_like_ids(tracking_df: DataFrame) -> DataFrame:
    """Each user's id as a UUID-like text; every third one is cut short."""
    digest = F.md5(F.col("user_id").cast("binary"))
    groups = [F.substr(digest, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    full = F.concat_ws("-", *groups)
    cut = F.when(F.col("user_id").cast("long") % 3 == 0, F.substring(full, 1, 8)).otherwise(full)
    return tracking_df.select("user_id").distinct().select("user_id", cut.alias("external_id"))

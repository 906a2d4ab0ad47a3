"""Search in users' ids and names by an index of three-letter runs.

The index holds (run, user) for every place of a lower-cased id or name, filled up at its end, so that a text
that is shorter than a run begins one too.  Every match of a text contains all runs of the text; of these the rarest are looked up,
their users are found in common, and the explorer's own condition is then checked on those users alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.operators.insights import explorer_filter, searched_name

RUN = 3
FILL = "\x00"

#: Runs of a text that are looked up, and users up to which they are named in the condition on the stored users, so that
#: only their buckets are read.  More users are found by a join; both give the same rows.
LOOKED_UP = 3
NAMED = 100

_INDEX_SCHEMA = "run string, user_id string"
_COUNTS_SCHEMA = "run string, users bigint"


def _runs(text: Column) -> Column:
    """The runs of a text, one for each of its places."""
    filled = F.concat(F.lower(text), F.lit(FILL * (RUN - 1)))
    places = F.sequence(F.lit(1), F.length(text))
    return F.when(F.length(text) > 0, F.transform(places, lambda at: F.substr(filled, at, F.lit(RUN))))


def search_index(users: DataFrame) -> DataFrame:
    """``run, user_id``, each once."""
    texts = [F.col("user_id")] + [F.col(name) for name in searched_name(users)]
    none = F.array().cast("array<string>")
    runs = F.array_distinct(F.flatten(F.array(*[F.coalesce(_runs(text), none) for text in texts])))
    return users.where(F.col("user_id").isNotNull()).select(F.explode(runs).alias("run"), "user_id")


def write_index(users: DataFrame, path: str) -> None:
    """Store the index in order of runs, and how many users have each.

    Ranged by run and user, so a run that most users have is split over files.
    """
    order = ["run", "user_id"]
    search_index(users).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/runs")
    index = users.sparkSession.read.schema(_INDEX_SCHEMA).parquet(f"{path}/runs")
    counts = index.groupBy("run").agg(F.count("*").alias("users"))
    counts.repartitionByRange("run").sortWithinPartitions("run").write.mode("overwrite").parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame:
    """Users who may have ``text`` (lower case, not empty) in their id or name: all who have it, and few others."""
    index = spark.read.schema(_INDEX_SCHEMA).parquet(f"{path}/runs")
    if len(text) < RUN:
        return index.where(F.col("run").startswith(text)).select("user_id").distinct()
    runs = sorted({text[at : at + RUN] for at in range(len(text) - RUN + 1)})
    counts = spark.read.schema(_COUNTS_SCHEMA).parquet(f"{path}/counts").where(F.col("run").isin(runs))
    known = {row["run"]: row["users"] for row in counts.collect()}  # at most the runs of the text
    if len(known) < len(runs):  # some run occurs nowhere
        return index.select("user_id").limit(0)
    rarest = sorted(runs, key=lambda run: (known[run], run))[:LOOKED_UP]
    found = index.where(F.col("run").isin(rarest)).groupBy("user_id").agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(rarest)).select("user_id")


def indexed_filter(
    users: DataFrame,
    path: str,
    clusters: Sequence[int] | None = None,
    services: Sequence[str] = (),
    search: str = "",
) -> DataFrame:
    """The rows of :func:`explorer_filter` for a literal text, found by the index in ``path``."""
    text = search.strip().lower()
    if text:
        found = candidates(users.sparkSession, path, text)
        some = [row["user_id"] for row in found.limit(NAMED + 1).collect()]
        if len(some) <= NAMED:
            users = users.where(F.col("user_id").isin(some))
        else:
            users = users.join(found, "user_id", "left_semi")
    return explorer_filter(users, clusters, services, search)

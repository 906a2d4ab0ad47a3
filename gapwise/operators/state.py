"""Use counts and last use as mergeable parts: new events are added without reading old ones.

A part is the state of some events, for example of a day: per user and service the completed uses and the time of the last.
Parts add up in any order.  Each has a name and is added once; its manifest appears by one rename after its data, so a
part that was half written is not there, and repeating an addition that succeeded is refused.  Compacting sums the parts there are
into a base, which names them; parts that come in meanwhile are simply not in it.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.catalog import Catalog
from gapwise.operators.events import completed_core
from gapwise.sources import builds
from gapwise.storage import remove

STATE_SCHEMA = "user_id string, process_type string, interaction_count bigint, last_active_at timestamp_ntz"

_PART = re.compile(r"part-(.+)\.json")
_BASE = re.compile(r"base-(\d{8})\.json")
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.=-]*")


def usage_state(events: DataFrame, cat: Catalog) -> DataFrame:
    """The state of normalised events; counts and times are of fixed width and combined before the shuffle."""
    return completed_core(events, cat).groupBy("user_id", "process_type").agg(
        F.count("*").alias("interaction_count"), F.max("created_at").alias("last_active_at")
    )


def merge_states(states: DataFrame) -> DataFrame:
    """States of several parts, one below the other, as the state of all their events."""
    return states.groupBy("user_id", "process_type").agg(
        F.sum("interaction_count").alias("interaction_count"), F.max("last_active_at").alias("last_active_at")
    )


def _store(spark: SparkSession, path: str, state: DataFrame, manifest: str, told: dict) -> None:
    data = f"data-{uuid.uuid4().hex}"
    try:
        state.write.parquet(f"{path}/{data}")
        builds.put_once(spark, path, manifest, told | {"data": data})
    except BaseException:
        remove(spark, f"{path}/{data}")
        raise


def add_part(path: str, part: str, events: DataFrame, cat: Catalog) -> None:
    """Add the state of ``events`` under the name ``part``; an error if there is a part of that name."""
    if not _NAME.fullmatch(part):
        raise ValueError(f"not a name of a part: {part!r}")
    spark = events.sparkSession
    if f"part-{part}.json" in builds.names(spark, path):
        raise FileExistsError(f"{path} already has part {part}")
    _store(spark, path, usage_state(events, cat), f"part-{part}.json", {})


def _manifests(spark: SparkSession, path: str) -> tuple[list[int], list[str]]:
    """Numbers of the bases and names of the parts."""
    listed = builds.names(spark, path)
    bases = [int(found[1]) for found in map(_BASE.fullmatch, listed) if found]
    return bases, [found[1] for found in map(_PART.fullmatch, listed) if found]


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], int]:
    """The states to merge, the parts in them, and the number of the base among them (0 for none)."""
    bases, parts = _manifests(spark, path)
    base = builds.get(spark, path, f"base-{bases[-1]:08d}.json") if bases else {"parts": [], "data": None}
    others = [part for part in parts if part not in set(base["parts"])]
    folders = [base["data"]] if base["data"] else []
    folders += [builds.get(spark, path, f"part-{part}.json")["data"] for part in others]
    reader = spark.read.schema(STATE_SCHEMA)
    rows = reader.parquet(*[f"{path}/{folder}" for folder in folders]) if folders else spark.createDataFrame([], STATE_SCHEMA)
    return rows, parts, bases[-1] if bases else 0


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The state of all parts: as many rows to add up as parts have users and services, no events."""
    return merge_states(_read(spark, path)[0])


def parts(spark: SparkSession, path: str) -> list[str]:
    """Names of the parts that have been added, ascending."""
    return _manifests(spark, path)[1]


def compact(spark: SparkSession, path: str) -> None:
    """Sum the parts there are into a new base.  Their data and the base's before the last are deleted."""
    rows, known, last = _read(spark, path)
    _store(spark, path, merge_states(rows), f"base-{last + 1:08d}.json", {"parts": known})
    if last:  # what readers of the last base may still read stays until the next time
        before = builds.get(spark, path, f"base-{last:08d}.json")
        for part in before["parts"]:
            remove(spark, f"{path}/{builds.get(spark, path, f'part-{part}.json')['data']}")
        if last > 1:
            remove(spark, f"{path}/{builds.get(spark, path, f'base-{last - 1:08d}.json')['data']}")


def state_affinity(state: DataFrame) -> DataFrame:
    """The affinity table of a state."""
    return state.select("user_id", "process_type", "interaction_count")


def state_last_active(state: DataFrame) -> DataFrame:
    """Time of each user's last completed use."""
    return state.groupBy("user_id").agg(F.max("last_active_at").alias("last_active_at"))

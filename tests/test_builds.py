"""Stored tables: buckets by user, and builds that readers see whole or not at all."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gapwise.operators import profile
from gapwise.sources import builds, marts
from gapwise.storage import new_path


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_of(df):
    return {r[0].rsplit("/", 1)[1] for r in df.select(F.input_file_name()).distinct().collect()}


@pytest.fixture()
def shuffled(spark):
    """Nothing is small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_user_is_read_from_one_bucket(spark, inputs):
    """The files of all other buckets are unreadable, and are not read."""
    path = new_path(spark, "one-bucket")
    marts.write_marts(marts.read_marts(spark, inputs.mart_path), path)
    expected = {
        name: sorted(map(repr, marts.read_mart(spark, path, name).filter("user_id = '7'").collect())) for name in marts.MART_SCHEMAS
    }
    bucket = spark.range(1).select(F.pmod(F.hash(F.lit("7")), F.lit(8))).first()[0]
    spoilt = 0
    for file in Path(path.removeprefix("file:")).rglob("part-*_?????.*parquet"):
        if int(re.search(r"_(\d{5})\.", file.name)[1]) != bucket:
            file.write_bytes(b"spoilt")
            spoilt += 1
    assert spoilt > 14
    for name, rows in expected.items():
        assert sorted(map(repr, marts.read_user(spark, path, name, " 7 ").collect())) == rows != []
    looked = profile.lookup_user(marts.read_mart(spark, path, "user_clusters"), " 7 ")
    assert sorted(map(repr, looked.collect())) == expected["user_clusters"]
    with pytest.raises(Exception):
        marts.read_mart(spark, path, "user_clusters").collect()


def test_stored_tables_are_joined_and_grouped_where_they_are(spark, inputs, shuffled):
    users, stats = inputs.user_clusters, inputs.affinity
    plan = plan_of(users.join(stats, "user_id"))
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert users.join(stats, "user_id").count() == stats.count()
    counted = stats.groupBy("user_id").agg(F.sum("interaction_count").alias("n")).join(users, "user_id")
    assert "Exchange" not in plan_of(counted) and counted.count() == users.count()


def test_every_file_holds_one_bucket(spark, inputs):
    build = builds.current(spark, inputs.mart_path)
    for name in marts.MART_SCHEMAS:
        rows = spark.read.parquet(f"{inputs.mart_path}/{build.name}/{name}").select(
            F.pmod(F.hash("user_id"), F.lit(build.buckets)).alias("bucket"), F.input_file_name().alias("file")
        )
        for row in rows.distinct().collect():
            assert int(re.search(r"_(\d{5})\.c", row["file"])[1]) == row["bucket"]


def test_a_task_writes_its_own_buckets(spark, inputs):
    """As many files as buckets and clusters, however many tasks there are; events have up to the spread."""
    assert len(files_of(inputs.mart("user_service_stats"))) <= 8
    assert len(files_of(inputs.mart("user_clusters"))) <= 8 * 3
    assert len(files_of(inputs.activity)) <= 8 * 8


def test_a_new_build_replaces_the_old_one_and_is_read_at_once(spark, inputs):
    path = new_path(spark, "builds")
    tables = marts.read_marts(spark, inputs.mart_path)
    marts.write_marts(tables, path)
    first, before = builds.current(spark, path), marts.read_mart(spark, path, "user_clusters")
    fewer = {name: df.filter("user_id < '5'") for name, df in tables.items()}
    marts.write_marts(fewer, path, buckets=3)
    second = builds.current(spark, path)
    assert second.name != first.name and second.buckets == 3
    assert marts.read_mart(spark, path, "user_clusters").count() == fewer["user_clusters"].count() < before.count()
    # A third one: the first is gone, the second stays for those who read it.
    kept = marts.read_mart(spark, path, "user_service_stats")
    marts.write_marts(tables, path)
    names = {p.rsplit("/", 1)[1] for p in _listed(spark, path)}
    assert first.name not in names and second.name in names and builds.current(spark, path).name in names
    assert kept.count() == fewer["user_service_stats"].count()


def _listed(spark, path):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [status.getPath().toString() for status in fs.listStatus(target)]


def test_a_write_that_fails_leaves_the_old_tables(spark, inputs):
    path = new_path(spark, "builds-failing")
    tables = marts.read_marts(spark, inputs.mart_path)
    marts.write_marts(tables, path)
    before, rows = builds.current(spark, path), marts.read_mart(spark, path, "user_service_stats").collect()
    broken = tables["user_service_stats"].withColumn("interaction_count", F.raise_error(F.lit("killed")).cast("long"))
    with pytest.raises(Exception, match="killed"):
        marts.write_marts(tables | {"user_service_stats": broken}, path)
    assert builds.current(spark, path) == before
    assert sorted(marts.read_mart(spark, path, "user_service_stats").collect()) == sorted(rows)
    left = [p for p in _listed(spark, path) if "/build-" in p]
    assert len(left) == 1 and left[0].endswith(before.name)


def test_tables_without_a_manifest_are_not_read(spark, inputs):
    """What a killed process leaves: files, but no manifest."""
    path = new_path(spark, "builds-killed")
    with pytest.raises(builds.Unpublished):
        marts.read_mart(spark, path, "user_clusters")
    marts._write_mart(inputs.affinity, "user_service_stats", f"{path}/build-dead/user_service_stats", 8)
    with pytest.raises(builds.Unpublished):
        marts.read_mart(spark, path, "user_service_stats")


def test_two_builds_do_not_take_one_number(spark, inputs, monkeypatch):
    path = new_path(spark, "builds-race")
    some = {"user_service_stats": inputs.affinity}
    marts.write_marts(some, path)
    late = builds.current(spark, path)
    monkeypatch.setattr(builds, "_numbers", lambda spark, path: [])  # as a writer that listed before the other's rename
    with pytest.raises(FileExistsError):
        builds.publish(spark, path, builds.Build("build-late", 8, ("user_service_stats",)))
    monkeypatch.undo()
    assert builds.current(spark, path) == late


def test_quotes_in_the_path(spark, inputs):
    path = new_path(spark, "it's")
    marts.write_marts({"user_service_stats": inputs.affinity}, path)
    assert marts.read_mart(spark, path, "user_service_stats").count() == inputs.affinity.count()

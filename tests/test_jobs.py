"""The batch work from the command line, end to end."""

import os
import re
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gapwise import jobs
from gapwise.catalog import Catalog
from gapwise.sources import fixture, marts
from gapwise.sources.marts import read_marts
from gapwise.sources.tracking import read_events
from gapwise.storage import new_path


@pytest.fixture(scope="module")
def folders(spark, inputs):
    names = ("log", "names", "events", "marts", "repaired", "csv", "json")
    paths = {name: new_path(spark, f"job-{name}") for name in names}
    marts.export_csv(inputs.tracking, paths["log"])
    inputs.names.write.parquet(paths["names"])
    jobs.main(["land", "--log", paths["log"], "--multi-line", "--out", paths["events"]])
    jobs.main(["build", "--events", paths["events"], "--names", paths["names"],
               "--out", paths["marts"], "--no-model"])
    return paths


def test_land(spark, folders, inputs):
    landed = spark.read.parquet(folders["events"])
    assert sorted(map(repr, landed.collect())) == sorted(map(repr, inputs.events.collect()))


def test_build(spark, folders):
    tables = read_marts(spark, folders["marts"])
    assert tables["user_clusters"].count() == 150
    assert tables["user_activity"].count() == 1_027
    assert tables["user_service_stats"].count() == 565


def test_enrich(spark, folders):
    jobs.main(["enrich", "--marts", folders["marts"], "--events", folders["events"],
               "--names", folders["names"], "--out", folders["repaired"]])
    tables = read_marts(spark, folders["repaired"])
    assert tables["user_clusters"].filter("cross_recommend_2 IS NULL").count() == 0
    assert tables["user_activity"].count() == 1_027


def test_verify_and_diagnose(folders, capfd):
    jobs.main(["verify", "--marts", folders["marts"]])
    jobs.main(["diagnose", "--marts", folders["marts"]])
    shown = capfd.readouterr().out
    assert "null_rec1" in shown and "silhouette" in shown


def test_export(spark, folders):
    common = ["--marts", folders["marts"], "--cluster", "0", "--search", "customer#"]
    jobs.main(["export", "--out", folders["csv"], *common])
    jobs.main(["export", "--out", folders["json"], "--format", "json", "--raw", *common])
    csv = spark.read.option("header", True).csv(folders["csv"])
    raw = spark.read.json(folders["json"])
    assert csv.columns[:3] == ["User", "User ID", "Segment"]
    assert csv.count() == raw.count() > 0 and "cross_recommend_1" in raw.columns


@pytest.mark.parametrize("options", [[], ["--single-line", "--multi-line"]])
def test_line_breaks_must_be_decided(folders, options):
    with pytest.raises(SystemExit):
        jobs.main(["land", "--log", folders["log"], "--out", folders["events"] + "-x", *options])


def test_reports_are_whole(spark, capfd):
    jobs.show_all(spark.range(30).selectExpr("id", "repeat('x', 40) AS wide"))
    shown = capfd.readouterr().out
    assert shown.count("x" * 40) == 30 and "29" in shown and "only showing" not in shown


def test_accumulate(spark, folders, capfd):
    path = new_path(spark, "job-state")
    jobs.main(["accumulate", "--events", folders["events"], "--state", path, "--part", "2024-01-01"])
    once = capfd.readouterr().out
    jobs.main(["accumulate", "--events", folders["events"], "--state", path, "--part", "2024-01-02", "--compact"])
    twice = capfd.readouterr().out
    counts = [sorted(map(int, re.findall(r"\|\s*(\d+)\s*\|$", shown, re.M))) for shown in (once, twice)]
    assert sum(counts[0]) == 1_027 and counts[1] == [2 * n for n in counts[0]]
    with pytest.raises(FileExistsError):
        jobs.main(["accumulate", "--events", folders["events"], "--state", path, "--part", "2024-01-01"])


def test_export_by_an_index(spark, folders, tmp_path):
    jobs.main(["index", "--marts", folders["marts"], "--out", str(tmp_path / "index")])
    common = ["--marts", folders["marts"], "--cluster", "0", "--search", "customer#"]
    jobs.main(["export", *common, "--out", str(tmp_path / "scan")])
    jobs.main(["export", *common, "--out", str(tmp_path / "found"), "--index", str(tmp_path / "index")])
    one, two = (sorted(spark.read.text(str(tmp_path / p)).collect()) for p in ("scan", "found"))
    assert one == two and len(one) > 10
    with pytest.raises(SystemExit):
        jobs.main(["export", *common, "--out", str(tmp_path / "no"), "--index", "i", "--regex"])


def test_more_clusters_than_a_screen_and_all_users(spark, folders, tmp_path, capfd):
    many = read_marts(spark, folders["marts"])
    users = spark.range(2500).selectExpr("CAST(id AS STRING) AS user_id", "CAST(id % 40 AS INT) AS cluster_id")
    many["user_clusters"] = many["user_clusters"].drop("user_id", "cluster_id").limit(1).crossJoin(users)
    counts = spark.range(2500).selectExpr(
        "CAST(id AS STRING) AS user_id", "IF(id < 1250, 'RESEARCH', 'QUERY_ANSWER') AS process_type",
        "CAST(1 + id % 3 AS LONG) AS interaction_count",
    )
    many["user_service_stats"] = counts
    marts.write_marts(many, str(tmp_path / "m"))
    jobs.main(["verify", "--marts", str(tmp_path / "m")])
    shown = capfd.readouterr().out
    assert all(f"|{c}" in shown.replace(" ", "") for c in range(40))
    rows = []
    old, jobs.k_sweep = jobs.k_sweep, lambda matrix, cat, sample=None: rows.append((matrix.count(), sample)) or matrix.limit(0)
    try:
        jobs.main(["diagnose", "--marts", str(tmp_path / "m")])
    finally:
        jobs.k_sweep = old
    assert rows == [(2500, None)]


@pytest.fixture(scope="module")
def reordered(spark, inputs):
    """The whole way from a log without event ids, with other columns and times."""
    paths = {name: new_path(spark, f"reordered-{name}") for name in ("log", "names", "events", "marts", "repaired", "work")}
    marts.export_csv(fixture.reordered_log(inputs.tracking), paths["log"])
    inputs.names.write.parquet(paths["names"])
    common = ["--work", paths["work"]]
    jobs.main([*common, "land", "--log", paths["log"], "--single-line", "--out", paths["events"]])
    jobs.main([*common, "build", "--events", paths["events"], "--names", paths["names"], "--out", paths["marts"]])
    jobs.main([*common, "enrich", "--marts", paths["marts"], "--events", paths["events"],
               "--names", paths["names"], "--out", paths["repaired"]])
    return paths


def test_a_log_without_event_ids(spark, inputs, reordered):
    events = read_events(spark, reordered["events"])
    kept = ["user_id", "process_type", "status", "process_name", "created_at"]
    assert sorted(map(repr, events.select(*kept).collect())) == sorted(map(repr, inputs.events.select(*kept).collect()))
    tables = read_marts(spark, reordered["marts"])
    columns = ["user_id", "cluster_id", "active_service", "last_active_at", "process_name", "Name"]
    ours, theirs = (sorted(map(repr, t.select(*columns).collect())) for t in (tables["user_clusters"], inputs.user_clusters))
    assert ours == theirs
    repaired = read_marts(spark, reordered["repaired"])["user_activity"]
    assert repaired.filter("process_name IS NULL").count() == tables["user_activity"].filter("process_name IS NULL").count()


def test_the_work_folder_is_removed(reordered):
    assert not list(Path(reordered["work"]).glob("*"))


def test_enriching_keeps_event_ids(spark, folders):
    ids = read_marts(spark, folders["repaired"])["user_activity"].select("event_id")
    assert ids.filter("event_id IS NULL").count() == 0 and ids.distinct().count() == 1_027


def test_every_table_is_computed_once(spark, inputs, tmp_path):
    computed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            computed.add(len(batch))
            yield batch

    activity = inputs.activity.mapInPandas(counted, inputs.activity.schema)
    marts.write_marts({"user_activity": activity}, str(tmp_path / "m"))
    assert computed.value == 1_027


def test_a_hot_user_is_spread_over_files(spark, tmp_path):
    small = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few rows become one file again
    spark.conf.set(small, "false")
    rows = spark.range(5000).selectExpr(
        "id AS event_id", "'u' AS user_id", "'RESEARCH' AS process_type", "'COMPLETED' AS status",
        "CAST(NULL AS STRING) AS process_name", "CAST(NULL AS TIMESTAMP_NTZ) AS created_at",
    )
    marts.write_marts({"user_activity": rows}, str(tmp_path / "m"))
    spark.conf.unset(small)
    sizes = marts.read_mart(spark, str(tmp_path / "m"), "user_activity").groupBy(F.input_file_name()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 1000


def test_runs_from_another_folder(tmp_path, folders):
    """The package travels with --py-files: nothing is found by the working directory."""
    archive = tmp_path / "gapwise.zip"
    root = Path(jobs.__file__).parent.parent
    with zipfile.ZipFile(archive, "w") as target:
        for path in (root / "gapwise").rglob("*.py"):
            target.write(path, path.relative_to(root))
    code = (
        "from pyspark.sql import SparkSession\n"
        f"s = SparkSession.builder.master('local[2]').config('spark.submit.pyFiles', {str(archive)!r})"
        ".config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "from gapwise import jobs\n"
        f"jobs.main(['--work', {str(tmp_path / 'w')!r}, 'build', '--events', {folders['events']!r}, '--out', {str(tmp_path / 'm')!r}])\n"
    )
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    env["PYSPARK_SUBMIT_ARGS"] = f"--py-files {archive} pyspark-shell"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert list((tmp_path / "m").glob("build-*/user_clusters")) and list((tmp_path / "m").glob("manifest-*.json"))
    assert not list((tmp_path / "w").glob("*"))


def test_catalogue_file(tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text('{"core_services": ["X"], "services": {"X": {"label": "Ex"}}}')
    args = jobs.parser().parse_args(["--catalog", str(path), "verify", "--marts", "m"])
    assert args.run is jobs.verify
    assert Catalog.from_json(args.catalog).core == ("X",)

"""Command line for the batch work: land, build, enrich, accumulate, verify, diagnose, index, export.

Usage: ``python -m gapwise.jobs <command> --help``.  The session comes from the
environment, as spark-submit and the cluster's defaults set it up.
"""

from __future__ import annotations

import argparse
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from gapwise.catalog import Catalog
from gapwise.operators import insights, quality
from gapwise.operators.affinity import service_totals, usage_matrix
from gapwise.operators.events import normalize_events
from gapwise.operators.model import k_sweep
from gapwise.operators.search import indexed_filter, write_index
from gapwise.operators.state import add_part, compact, read_state, state_affinity
from gapwise.plans.build import als_scores, build_marts
from gapwise.plans.enrich import enrich_marts
from gapwise.sources.marts import export_csv, export_json, read_cells, read_mart, read_marts, write_marts
from gapwise.sources.tracking import conform_tracking, land_events, read_events, read_tracking
from gapwise.storage import work_folder


def show_all(report: DataFrame) -> None:
    """Print every row of a report; its rows are bounded by catalogue, clusters or sources."""
    report.show(max(1, report.count()), truncate=False)


def _names(spark: SparkSession, path: str | None) -> DataFrame | None:
    return None if path is None else spark.read.parquet(path).select("user_id", "Name")


def land(spark: SparkSession, cat: Catalog, args: argparse.Namespace) -> None:
    """CSV or Parquet log of any supported shape to normalised, landed events."""
    times = cat.settings.timestamp_columns
    if args.format == "parquet":
        log = conform_tracking(spark.read.parquet(args.log), times)
    elif args.single_line == args.multi_line:
        raise SystemExit("for a CSV log give --single-line, or --multi-line (a file is then one task)")
    else:
        log = read_tracking(spark, args.log, times, multi_line=args.multi_line)
    land_events(normalize_events(log), args.out)


def build(spark: SparkSession, cat: Catalog, args: argparse.Namespace) -> None:
    """Landed events to the three tables, with a trained model unless told otherwise."""
    scorer = None if args.no_model else partial(als_scores, cat=cat)
    events = read_events(spark, args.events)
    write_marts(build_marts(events, _names(spark, args.names), cat, scorer), args.out)


def enrich(spark: SparkSession, cat: Catalog, args: argparse.Namespace) -> None:
    """Stored tables, repaired, to a new folder."""
    tables, events = read_marts(spark, args.marts), read_events(spark, args.events)
    write_marts(enrich_marts(tables, events, _names(spark, args.names), cat), args.out)


def accumulate(spark: SparkSession, cat: Catalog, args: argparse.Namespace) -> None:
    """Landed events as a new part of a usage state, once; and the use counts of all parts."""
    add_part(args.state, args.part, read_events(spark, args.events), cat)
    if args.compact:
        compact(spark, args.state)
    show_all(service_totals(state_affinity(read_state(spark, args.state))))


def verify(spark: SparkSession, cat: Catalog, args: argparse.Namespace) -> None:
    """Row counts, NULLs, clusters, sources and first rows of the stored tables."""
    tables, cells = read_marts(spark, args.marts), read_cells(spark, args.marts)
    show_all(quality.table_profile(tables))
    show_all(quality.null_audit(cells))
    show_all(insights.cluster_dist(cells))
    show_all(insights.rec_sources(cells))
    show_all(insights.platform_kpis(cells, tables["user_activity"]))
    show_all(quality.preview(tables["user_clusters"], ["user_id"]))


def diagnose(spark: SparkSession, cat: Catalog, args: argparse.Namespace) -> None:
    """Inertia and silhouette of the usage vectors for a range of K."""
    stats = read_mart(spark, args.marts, "user_service_stats")
    show_all(k_sweep(usage_matrix(stats, cat), cat, sample=args.sample))


def index(spark: SparkSession, cat: Catalog, args: argparse.Namespace) -> None:
    """A search index of the stored users, for exports with a text."""
    write_index(read_mart(spark, args.marts, "user_clusters"), args.out)


def export(spark: SparkSession, cat: Catalog, args: argparse.Namespace) -> None:
    """The explorer's filtered view as CSV or JSON Lines."""
    users, services = read_mart(spark, args.marts, "user_clusters"), args.service or ()
    if args.index and args.regex:
        raise SystemExit("an index finds literal texts, not patterns")
    if args.index:
        found = indexed_filter(users, args.index, args.cluster, services, args.search)
    else:
        found = insights.explorer_filter(users, args.cluster, services, args.search, args.regex)
    view = insights.explorer_view(found, cat, args.raw)
    (export_csv if args.format == "csv" else export_json)(view, args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__)
    top.add_argument("--catalog", help="JSON catalogue; the built-in one without it")
    top.add_argument("--work", help="shared folder for intermediate tables, else spark.checkpoint.dir")
    commands = top.add_subparsers(dest="command", required=True)

    def command(run, *options: tuple[str, dict]) -> None:
        sub = commands.add_parser(run.__name__, help=run.__doc__)
        sub.set_defaults(run=run)
        for name, settings in options:
            sub.add_argument(name, **settings)

    needed, flag = {"required": True}, {"action": "store_true"}
    out, marts, events = ("--out", needed), ("--marts", needed), ("--events", needed)
    names = ("--names", {"help": "Parquet table with user_id and Name, such as stored users"})
    text_format = ("--format", {"choices": ("csv", "json"), "default": "csv"})
    log_format = ("--format", {"choices": ("csv", "parquet"), "default": "csv"})

    command(
        land, ("--log", needed), out, log_format,
        ("--single-line", {**flag, "help": "no field of the CSV log has a line break: files are split over tasks"}),
        ("--multi-line", {**flag, "help": "fields may have line breaks: each file is read by one task"}),
    )
    command(build, events, out, names, ("--no-model", flag))
    command(enrich, marts, events, out, names)
    command(
        accumulate, events, ("--state", needed), ("--part", {**needed, "help": "name of these events, for example their day"}),
        ("--compact", {**flag, "help": "then sum the parts there are"}),
    )
    command(verify, marts)
    command(diagnose, marts, ("--sample", {"type": int, "help": "so many users, by a seed; all without it"}))
    command(index, marts, out)
    command(
        export, marts, out, text_format, ("--index", {"help": "search index of the same build"}),
        ("--cluster", {"type": int, "action": "append"}), ("--service", {"action": "append"}),
        ("--search", {"default": ""}), ("--regex", flag), ("--raw", flag),
    )
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    cat = Catalog.from_json(args.catalog) if args.catalog else Catalog()
    spark = SparkSession.builder.appName(f"gapwise-{args.command}").getOrCreate()
    with work_folder(spark, args.work):
        args.run(spark, cat, args)


if __name__ == "__main__":
    main()

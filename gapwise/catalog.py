"""Service and segment catalogue, and the column expressions that look things up in it.

The catalogue is configuration: a handful of services and segments that live on
the driver.  Its size is known before a plan is built, so lookups are map
literals evaluated inside whole-stage codegen instead of joins.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Service codes, labels and clusters in priority order.
DEFAULT_SERVICES = (
    ("APPLICATION_DRAFTING", "Application Drafting", 0),
    ("RESEARCH", "Legal Research", 1),
    ("QUERY_ANSWER", "Query Answer", 2),
    ("SYNOPSIS_GENERATION", "Synopsis Generation", 0),
    ("DOCUMENT_EMBEDDING", "Document Embedding", 0),
)

# Segments.
DEFAULT_SEGMENTS = (
    (0, "Heavy Draftsman", "Power user of Application Drafting — high-frequency document creator"),
    (1, "Heavy Researcher", "Deep legal research user — case laws, judgments, and court updates"),
    (2, "Query Analyst", "Frequent Q&A user — legal definitions and quick lookups"),
)

# Wording for each recommendation source.
SOURCE_WORDING = {
    "als": "ALS collaborative filter",
    "peer": "Popular with similar users",
    "global": "Platform-wide trend",
    "usage": "Grow lowest-usage service (full profile)",
}
UNKNOWN_SOURCE_WORDING = "Recommended for you"

# Timestamp columns by preference, pass-through columns, default service and segment.
TIMESTAMP_CANDIDATES = ("created_at", "timestamp", "event_time", "completed_at", "updated_at")
PASS_THROUGH_COLUMNS = ("process_name",)
DEFAULT_ACTIVE_SERVICE = "APPLICATION_DRAFTING"
DEFAULT_CLUSTER = 0


@dataclass(frozen=True)
class Service:
    code: str
    label: str | None = None
    cluster_id: int = DEFAULT_CLUSTER


@dataclass(frozen=True)
class Segment:
    cluster_id: int
    label: str
    description: str | None = None


@dataclass(frozen=True)
class Settings:
    gap_usage_percentile: float = 25
    use_percentile_gaps: bool = False
    k_min: int = 2
    k_max: int = 8
    sample_users: int = 2000
    timestamp_columns: tuple[str, ...] = TIMESTAMP_CANDIDATES
    pass_through_columns: tuple[str, ...] = PASS_THROUGH_COLUMNS
    display_name_from: str = "process_name"


@dataclass(frozen=True)
class Catalog:
    """Services, the ordered core and priority lists, segments and settings."""

    services: tuple[Service, ...] = tuple(Service(*row) for row in DEFAULT_SERVICES)
    core: tuple[str, ...] = tuple(row[0] for row in DEFAULT_SERVICES)
    priority: tuple[str, ...] = tuple(row[0] for row in DEFAULT_SERVICES)
    segments: tuple[Segment, ...] = tuple(Segment(*row) for row in DEFAULT_SEGMENTS)
    settings: Settings = field(default_factory=Settings)

    # -- construction -----------------------------------------------------

    @staticmethod
    def from_mapping(config: Mapping) -> "Catalog":
        """Catalogue from a parsed configuration document."""
        services = config.get("services", {})
        core = tuple(config.get("core_services", ()))
        segments = config.get("clusters")
        gaps = config.get("recommendation", {})
        sweep = config.get("cluster_analysis", {})
        metadata = config.get("user_metadata", {})
        base = Settings()
        return Catalog(
            services=tuple(
                Service(code, meta.get("label"), int(meta.get("cluster_id", DEFAULT_CLUSTER)))
                for code, meta in services.items()
            ),
            core=core,
            priority=tuple(config.get("service_priority", core)),
            segments=tuple(
                Segment(int(cid), meta.get("label", f"Cluster {cid}"), meta.get("desc"))
                for cid, meta in segments.items()
            )
            if segments
            else Catalog().segments,
            settings=replace(
                base,
                gap_usage_percentile=gaps.get("gap_usage_percentile", base.gap_usage_percentile),
                use_percentile_gaps=gaps.get("use_percentile_gaps", base.use_percentile_gaps),
                k_min=sweep.get("k_min", base.k_min),
                k_max=sweep.get("k_max", base.k_max),
                sample_users=sweep.get("sample_users", base.sample_users),
                timestamp_columns=tuple(metadata.get("timestamp_columns", base.timestamp_columns)),
                pass_through_columns=tuple(
                    metadata.get("pass_through_columns", base.pass_through_columns)
                ),
                display_name_from=metadata.get("display_name_from", base.display_name_from),
            ),
        )

    @staticmethod
    def from_json(path: str) -> "Catalog":
        with open(path, encoding="utf-8") as handle:
            return Catalog.from_mapping(json.load(handle))

    # -- dimension tables --------------------------------------------------

    def dim_service(self, spark: SparkSession) -> DataFrame:
        codes = list(dict.fromkeys([*self.core, *(s.code for s in self.services)]))
        by_code = {s.code: s for s in self.services}
        order = {code: i for i, code in enumerate(self.priority)}
        rows = [
            (
                code,
                by_code[code].label if code in by_code else None,
                by_code[code].cluster_id if code in by_code else DEFAULT_CLUSTER,
                order.get(code, len(self.priority)),
                code in self.core,
            )
            for code in codes
        ]
        return literal_table(
            spark, rows, "service string, label string, cluster_id int, priority int, is_core boolean"
        )

    def dim_segment(self, spark: SparkSession) -> DataFrame:
        rows = [(s.cluster_id, s.label, s.description) for s in self.segments]
        return literal_table(spark, rows, "cluster_id int, label string, description string")

    # -- column expressions ------------------------------------------------

    def priority_of(self, service: Column) -> Column:
        """Position in the priority list; unknown services rank after all known ones."""
        order = {code: i for i, code in enumerate(self.priority)}
        return F.coalesce(lookup(order, service, "int"), F.lit(len(self.priority)))

    def cluster_of(self, service: Column) -> Column:
        known = {s.code: s.cluster_id for s in self.services}
        return F.coalesce(lookup(known, service, "int"), F.lit(DEFAULT_CLUSTER))

    def service_label(self, service: Column, missing: str | None = None) -> Column:
        """Configured label, else the code in title case; ``missing`` for a NULL or empty code."""
        known = {s.code: s.label for s in self.services if s.label is not None}
        titled = F.initcap(F.replace(service, F.lit("_"), F.lit(" ")))
        label = F.coalesce(lookup(known, service, "string"), titled)
        return F.when(service != "", label).otherwise(F.lit(missing).cast("string"))

    def segment_label(self, cluster_id: Column) -> Column:
        """Configured label, else ``Cluster <id>``; NULL for a NULL id."""
        return F.coalesce(
            self.known_segment(cluster_id),
            F.concat(F.lit("Cluster "), cluster_id.cast("string")),
        )

    def known_segment(self, cluster_id: Column) -> Column:
        return lookup({s.cluster_id: s.label for s in self.segments}, cluster_id, "string")

    def is_core(self, service: Column) -> Column:
        return service.isin(list(self.core))

    def core_array(self) -> Column:
        return string_array(self.core)


def sql_literal(value) -> str:
    """A configuration value as SQL text: one expression to parse instead of many calls."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value).lower() if isinstance(value, bool) else str(value)


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows of configuration as a table that needs no Python to scan."""
    row_type = T.ArrayType(T.StructType.fromDDL(schema))
    records = ", ".join(f"struct({', '.join(map(sql_literal, row))})" for row in rows)
    return spark.range(1).select(F.inline(F.expr(f"array({records})").cast(row_type)))


def lookup(table: Mapping, key: Column, value_type: str) -> Column:
    """``table[key]`` as a column, NULL when absent.  ``table`` is driver-side configuration."""
    if not table:
        return F.lit(None).cast(value_type)
    entries = ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({entries})"), key).cast(value_type)


def string_array(values) -> Column:
    return F.expr(f"array({', '.join(map(sql_literal, values))})").cast("array<string>")


def source_wording(source: Column) -> Column:
    """Readable wording of a recommendation source; a missing source reads as the model's."""
    known = F.when(source != "", source).otherwise(F.lit("als"))
    return F.coalesce(lookup(SOURCE_WORDING, known, "string"), F.lit(UNKNOWN_SOURCE_WORDING))

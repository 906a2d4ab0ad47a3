"""Known figures of the generated data at sf0.01."""

import pytest
from pyspark.sql import functions as F

from gapwise.operators import affinity, events, fill, gaps

pytestmark = pytest.mark.usefixtures("at_sf001")


@pytest.fixture()
def at_sf001(sf_dir):
    if not sf_dir.rstrip("/").endswith("sf0.01"):
        pytest.skip("figures are for sf0.01")


def pairs(df, key, value):
    return {row[key]: row[value] for row in df.collect()}


def test_event_counts(inputs, cat):
    audit = events.normalization_audit(inputs.tracking, cat).first()
    assert tuple(audit) == (10_000, 1_027, 651)


def test_service_totals(inputs):
    assert pairs(affinity.service_totals(inputs.affinity), "process_type", "total") == {
        "APPLICATION_DRAFTING": 188,
        "RESEARCH": 229,
        "QUERY_ANSWER": 191,
        "SYNOPSIS_GENERATION": 214,
        "DOCUMENT_EMBEDDING": 205,
    }


def test_services_per_user(inputs):
    sizes = inputs.affinity.groupBy("user_id").count().groupBy("count").agg(F.count("*").alias("n"))
    assert pairs(sizes, "count", "n") == {1: 2, 2: 13, 3: 44, 4: 50, 5: 41}


def test_active_services(inputs):
    counts = inputs.active.groupBy("active_service").agg(F.count("*").alias("n"))
    assert pairs(counts, "active_service", "n") == {
        "APPLICATION_DRAFTING": 36,
        "RESEARCH": 38,
        "QUERY_ANSWER": 26,
        "SYNOPSIS_GENERATION": 25,
        "DOCUMENT_EMBEDDING": 25,
    }


def test_adopted_by_percentile(inputs, cat):
    thresholds = affinity.gap_thresholds(inputs.affinity, 0.25)
    assert gaps.adopted_services(inputs.affinity, thresholds, cat).count() == 291


def test_sources_without_a_model(inputs, cat):
    filled = fill.fill_gaps(inputs.empty_slots, inputs.affinity, cat)
    sources = {
        slot: pairs(filled.groupBy(f"rec{slot}_source").agg(F.count("*").alias("n")), 0, 1)
        for slot in (1, 2)
    }
    assert sources[1] == {"peer": 93, "global": 16, "usage": 41}
    assert sources[2] == {"peer": 31, "global": 28, "usage": 41, None: 50}

"""Titles, names, labels and scores at their edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gapwise.catalog import Catalog, source_wording
from gapwise.functions import scores, text
from gapwise.operators import insights, naming, profile, quality
from gapwise.sources.marts import USER_CLUSTERS_SCHEMA


def values(spark, column, inputs, kind="string"):
    rows = [(i, x) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def users(spark, *rows):
    full = [[row.get(f.name) for f in USER_CLUSTERS_SCHEMA] for row in rows]
    return spark.createDataFrame(full, USER_CLUSTERS_SCHEMA)


def test_strip_removes_every_kind_of_whitespace(spark):
    assert values(spark, text.strip, ["\t a b \n", "　", None]) == ["a b", "", None]


def test_names(spark):
    names = ["", "nan", "None", "  A ", " nan ", None]
    assert values(spark, text.valid_name, names) == [None, None, None, "A", None, None]


def test_title_lengths(spark):
    exact = ["x" * 55, "x" * 56, "\t" + "x" * 57 + " ", "y" * 54 + " zzz"]
    assert values(spark, text.clean_title, exact) == ["x" * 55, "x" * 56, "x" * 55 + "…", "y" * 54 + "…"]
    assert values(spark, text.clean_title_short, exact)[2] == "x" * 56


def test_title_prefixes(spark):
    titles = [
        "Async Research: case", "Async Query: q", "Async Draft: d", "Async job 7", "Async ",
        "Async Research: ", "Conversation Record Turn", "Conversation Record Turn 9",
        "Async Async job", "   ", "", None, "Rasync Query: x",
    ]
    assert values(spark, text.clean_title, titles) == [
        "case", "q", "d", "job 7", "Async", "Research:", None, "9",
        "Async job", None, None, None, "Rasync Query: x",
    ]
    short = values(spark, text.clean_title_short, titles)
    assert short[6:8] == ["Conversation Record Turn", "Conversation Record Turn 9"]
    assert short[9:12] == ["", "", None]


def test_display_names(spark):
    def named(title):
        return text.display_name(title, F.lit("0123456789"), "Unknown user")

    assert values(spark, named, ["A", "", None]) == ["A", "User · 01234567…", "User · 01234567…"]

    def of_id(user_id):
        return text.display_name(F.lit(None).cast("string"), user_id, "Unknown user")

    assert values(spark, of_id, ["", None, "7"]) == ["Unknown user", "Unknown user", "User · 7…"]


def test_uuid_pattern(spark):
    ids = ["0aB9c8d7-0000-1111-2222-333344445555", "0ab9c8d7-0000-1111-2222-33334444555",
           " 0ab9c8d7-0000-1111-2222-333344445555", None]
    assert values(spark, lambda c: c.rlike(text.UUID_PATTERN), ids) == [True, False, False, None]


def test_labels(spark, cat):
    codes = ["RESEARCH", "NEW_THING", "", None]
    assert values(spark, lambda c: cat.service_label(c, "—"), codes) == [
        "Legal Research", "New Thing", "—", "—",
    ]
    assert values(spark, cat.service_label, codes)[2:] == [None, None]
    assert values(spark, cat.segment_label, [0, 2, 9, None], "int") == [
        "Heavy Draftsman", "Query Analyst", "Cluster 9", None,
    ]
    assert values(spark, source_wording, ["peer", "", None, "other"]) == [
        "Popular with similar users", "ALS collaborative filter", "ALS collaborative filter",
        "Recommended for you",
    ]


def test_label_text_is_quoted(spark):
    odd = Catalog.from_mapping(
        {
            "core_services": ["X"],
            "services": {"X": {"label": "It's a \\ \"label\"", "cluster_id": 4}},
            "clusters": {"4": {"label": "O'Four", "desc": "d"}},
        }
    )
    assert values(spark, odd.service_label, ["X"]) == ["It's a \\ \"label\""]
    assert [tuple(r) for r in odd.dim_segment(spark).collect()] == [(4, "O'Four", "d")]
    assert [tuple(r) for r in odd.dim_service(spark).collect()] == [
        ("X", "It's a \\ \"label\"", 4, 0, True)
    ]


def test_configuration_defaults():
    cat = Catalog.from_mapping({"core_services": ["X", "Y"], "services": {"X": {}}})
    assert cat.priority == ("X", "Y")
    assert [s.label for s in cat.segments] == [s.label for s in Catalog().segments]
    assert cat.settings.gap_usage_percentile == 25 and not cat.settings.use_percentile_gaps


def test_scores(spark):
    given = [-3.0, 58.9, 130.0, None, float("nan"), float("inf")]
    assert values(spark, scores.fit_percent, given, "double") == [0, 58, 100, None, None, None]
    assert values(spark, scores.score_text, [0.5, 1.5, 58.4, None], "double") == ["0", "2", "58", ""]


def test_percent_rounds_half_to_even(spark):
    def of_200(x):
        return scores.percent(x, F.lit(200))

    assert values(spark, of_200, [1, 3, 5, 200], "long") == [0, 2, 2, 100]
    assert values(spark, lambda x: scores.percent(x, F.lit(0)), [1], "long") == [None]


def test_restore_names(spark):
    stored = users(spark, {"user_id": "a", "Name": "nan"}, {"user_id": "b", "Name": " Own "},
                   {"user_id": "c"}, {"user_id": "d"})
    names = spark.createDataFrame(
        [(" a ", "Ann"), ("b", "Bob"), (" c", "C1"), ("c", "C2"), ("d", "None"), (None, "X")],
        "user_id string, Name string",
    )
    rows = {r["user_id"]: r["Name"] for r in naming.restore_names(stored, names).collect()}
    assert rows == {"a": "Ann", "b": "Own", "c": "C2", "d": None}


def test_attach_activity_names(spark):
    t = dt.datetime(2024, 1, 1)
    schema = (
        "event_id long, user_id string, process_type string, status string, process_name string, "
        "created_at timestamp_ntz"
    )
    activity = spark.createDataFrame(
        [(1, "u", "A", "COMPLETED", None, t), (2, "u", None, "COMPLETED", None, None),
         (3, "v", "A", "COMPLETED", "own", t), (4, "v", "A", "COMPLETED", "own", t)], schema)
    events = spark.createDataFrame(
        [(9, "u", "A", "COMPLETED", "later", t), (8, "u", "A", "COMPLETED", "first", t),
         (7, "u", "A", "FAILED", "failed", t), (6, "u", None, "COMPLETED", "null keys", None),
         (5, "v", "A", "COMPLETED", "other", t)], schema)
    rows = naming.attach_activity_names(activity, events).collect()
    assert sorted((r["user_id"], r["process_type"] or "", r["process_name"]) for r in rows) == [
        ("u", "", "null keys"), ("u", "A", "first"), ("v", "A", "own"),
    ]
    assert sorted(r["event_id"] for r in rows) == [1, 2, 3]


def test_activity_titles_without_event_ids(spark):
    """The first title in order of text; a user without times meets its titles in one row per service."""
    schema = "event_id long, user_id string, process_type string, status string, process_name string, created_at timestamp_ntz"
    hot = [(None, "u", "A", "COMPLETED", None, None)] * 500 + [(None, "u", "A", "COMPLETED", "own", None)] * 500
    events = [(None, "u", "A", "COMPLETED", title, None) for title in (None, "b", "a", "c")] * 100
    rows = naming.attach_activity_names(spark.createDataFrame(hot, schema), spark.createDataFrame(events, schema))
    assert sorted(r["process_name"] for r in rows.collect()) == ["a", "own"]


def test_explorer_filter(spark):
    stored = users(
        spark,
        {"user_id": "u(1", "cluster_id": 0, "active_service": "A", "Name": "Zed"},
        {"user_id": "u2", "cluster_id": 1, "active_service": None, "Name": None},
        {"user_id": "x3", "cluster_id": 1, "active_service": "B", "Name": "has U2 inside"},
    )

    def found(*args, **kwargs):
        rows = insights.explorer_filter(stored, *args, **kwargs).collect()
        return sorted(r["user_id"] for r in rows)

    assert found([0, 1]) == ["u(1", "u2", "x3"]
    assert found() == ["u(1", "u2", "x3"] and found([]) == []
    assert found([1], ["A"]) == ["u2"]
    assert found([0, 1], search="(") == ["u(1"]
    assert found([0, 1], search=" U2 ") == ["u2", "x3"]
    assert found([0, 1], search="^u.$", regex=True) == ["u2"]
    by_display = stored.drop("Name").withColumn("user_display_name", F.lit("Zed"))
    assert insights.explorer_filter(by_display, [0], search="zE").count() == 1


def test_explorer_view(spark, cat):
    stored = users(
        spark,
        {"user_id": "0123456789", "cluster_id": 7, "active_service": "NEW_ONE", "Name": "nan",
         "cross_recommend_1": "RESEARCH", "rec1_score": 58.5, "rec1_source": "peer"},
        {"user_id": "b", "Name": " Bob "},
    )
    first, second = insights.explorer_view(stored, cat).orderBy("User ID").collect()
    assert first["User"] == "01234567…" and first["Segment"] == "Cluster 7"
    assert first["Active Service"] == "New One"
    assert first["Primary Recommendation"] == "Legal Research"
    assert (first["Primary Fit Score"], first["Primary Source"]) == ("58", "Peer")
    assert (first["Secondary Recommendation"], first["Secondary Fit Score"]) == ("", "")
    assert (second["User"], second["Active Service"]) == ("Bob", "Unknown")
    assert insights.explorer_view(stored, cat, raw=True).columns == stored.columns


def test_empty_tables(spark, cat):
    empty = users(spark)
    activity = spark.createDataFrame([], "user_id string, event_id long")
    assert insights.rec_coverage_pct(empty).first()[0] == 0
    assert tuple(insights.platform_kpis(empty, activity).first()) == (0, 0, 0, 0)
    assert insights.cluster_summary(empty, cat).count() == 0
    assert quality.null_audit(empty).first()["users"] == 0
    assert [r["users"] for r in naming.segment_directory(empty, cat).collect()] == [0, 0, 0]


def test_blank_recommendation_is_counted_but_not_covered(spark):
    stored = users(spark, {"user_id": "a", "cross_recommend_1": "  "},
                   {"user_id": "b", "cross_recommend_1": "X"}, {"user_id": "c"})
    assert insights.rec_coverage_pct(stored).first()[0] == 33
    frequency = {r["service"]: r["users"] for r in insights.rec_frequency(stored).collect()}
    assert frequency == {"  ": 1, "X": 1}


def test_null_service_is_excluded_from_adoption(spark):
    stored = users(spark, {"user_id": "a", "cluster_id": 0}, {"user_id": "b", "cluster_id": 0,
                                                              "active_service": "X"})
    rows = insights.service_by_cluster(stored).collect()
    assert [tuple(r) for r in rows] == [(0, "X", 1)]


def test_cluster_summary_breaks_ties_by_priority(spark, cat):
    stored = users(
        spark,
        {"user_id": "a", "cluster_id": 1, "active_service": "QUERY_ANSWER"},
        {"user_id": "b", "cluster_id": 1, "active_service": "RESEARCH"},
        {"user_id": "c", "cluster_id": 8, "active_service": None, "cross_recommend_1": "ZZZ"},
    )
    rows = {r["cluster_id"]: r for r in insights.cluster_summary(stored, cat).collect()}
    assert rows[1]["top_active_service"] == "RESEARCH" and rows[1]["top_recommendation"] == "—"
    assert rows[8]["top_active_service"] == "—" and rows[8]["top_recommendation"] == "ZZZ"
    assert rows[8]["segment"] == "—" and rows[1]["users"] == 2


def test_segment_directory_lists_found_segments(spark, cat):
    stored = users(spark, {"user_id": "a", "cluster_id": 9}, {"user_id": "b", "cluster_id": 0})
    rows = [(r["cluster_id"], r["label"], r["users"])
            for r in naming.segment_directory(stored, cat).collect()]
    assert rows[0][2] == 1 and rows[-1] == (9, "Cluster 9", 1) and len(rows) == 4


def test_user_directory(spark):
    stored = users(spark, {"user_id": "0123456789", "Name": " NaN "}, {"user_id": "b", "Name": " B "})
    rows = {r["user_id"]: (r["user_label"], r["has_name"])
            for r in naming.user_directory(stored).collect()}
    assert rows == {"0123456789": ("01234567…", False), "b": ("B", True)}


def test_profile_defaults(spark, cat):
    stored = users(spark, {"user_id": "0123456789"},
                   {"user_id": "b", "cluster_id": 5, "active_service": "", "rec1_source": "peer"})
    rows = {r["user_id"]: r for r in profile.user_profile(stored, cat).collect()}
    first = rows["0123456789"]
    assert first["display_name"] == "01234567…" and first["cluster_id"] == 0
    assert first["active_service"] == "APPLICATION_DRAFTING"
    assert first["active_service_name"] == "Application Drafting"
    assert first["rec1_source"] == "als" and first["rec1_name"] is None
    assert rows["b"]["segment_name"] == "Heavy Draftsman" and rows["b"]["rec1_source"] == "peer"


def test_rec_cards(spark, cat):
    stored = users(
        spark,
        {"user_id": "a", "cross_recommend_1": "RESEARCH", "rec1_score": 130.0,
         "cross_recommend_2": "NEW_ONE"},
        {"user_id": "b", "cross_recommend_1": ""},
    )
    cards = profile.rec_cards(stored, cat).orderBy("rank").collect()
    assert [(c["rank"], c["label"], c["fit"], c["fit_text"]) for c in cards] == [
        (1, "Legal Research", 100, "100% fit"), (2, "New One", None, "Ranked by platform trends"),
    ]


def test_outreach(spark, cat):
    stored = users(
        spark,
        {"user_id": "0123456789", "Name": "Zoë O'Hara 3", "cross_recommend_1": "RESEARCH",
         "active_service": "QUERY_ANSWER"},
        {"user_id": "abcdefghij", "Name": "Al", "cross_recommend_1": "RESEARCH"},
        {"user_id": "c", "Name": "No Recommendation"},
    )
    audience = profile.outreach_audience(
        profile.user_profile(stored, cat), product="Acme", site="https://acme.example"
    )
    first, second = audience.orderBy("user_id").collect()
    assert first["recipient"] == "zoëohara3@example.com"
    assert second["recipient"] == "user_abcdefgh@example.com"
    assert first["subject"] == "⚡ Discover Legal Research on Acme"
    assert first["body"].startswith("Dear Zoë O'Hara 3,\n\nWe noticed you've been actively using our "
                                    "Query Answer service on Acme.")
    assert first["body"].endswith(
        "Try Legal Research today: https://acme.example/services/research\n\n"
        "Best regards,\nThe Acme Team"
    )


@pytest.mark.parametrize("user_id, expected", [(" a ", 1), ("z", 0)])
def test_lookup_trims_the_id(spark, user_id, expected):
    assert profile.lookup_user(users(spark, {"user_id": "a"}), user_id).count() == expected

"""What the plans may and may not contain, and results when nothing is small enough to broadcast."""

import re

import pytest

import __spark_entry__ as entry
from checks.queries import QUERIES
from gapwise.operators import events
from gapwise.operators.affinity import profile_uses, user_rollup
from gapwise.operators.ranking import rank_lists
from gapwise.plans import build
from tests.compare import differences, duck

# What trains with the library or joins one-row results of its checks.
TRAINED = {"fit_als", "k_sweep", "kmeans_segments"}
# Broadcast by a hint: offsets, one per partition, of the numbering.
NUMBERED = {"dense_index", "extended_index", "score_all", "decode_index"}
RELATIONAL = sorted(name for name in QUERIES if name not in TRAINED and name != "build_user_clusters_als")
PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups")
FORBIDDEN = (*PYTHON, "CartesianProduct", "BroadcastNestedLoopJoin", "Scan ExistingRDD")


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RELATIONAL)
def test_plan(spark, sf_dir, name, no_broadcast):
    plan = plan_of(entry.queries()[name](spark, sf_dir))
    items = ("Scan ExistingRDD",) if name in NUMBERED else ()
    assert [node for node in FORBIDDEN if node in plan and node not in items] == []

    # With automatic broadcasts off, what is left are the hints: rank lists and thresholds.
    keys = set(re.findall(r"BroadcastHashJoin \[(\w+)#", plan))
    hinted = {"adopted_services": {"process_type"}} | dict.fromkeys(NUMBERED, {"part"})
    assert keys <= {"list_key"} | hinted.get(name, set())

    # The only window without keys orders one row per service.
    unkeyed = re.search(r"windowspecdefinition\([^,]*(DESC|ASC)", plan)
    assert unkeyed is None or name == "global_rank" or name in NUMBERED


@pytest.mark.parametrize(
    "name",
    ["build_user_clusters", "enrich_user_clusters", "fill_gaps", "attach_activity_names", "restore_names",
     "gap_status", "user_summary", "top_users", "missing_users", "topn_per_user", "peer_rank"],
)
def test_results_without_broadcasts(spark, sf_dir, name, no_broadcast):
    actual = entry.queries()[name](spark, sf_dir).toArrow()
    expected = duck(sf_dir).sql(entry.oracle_sql()[name]).to_arrow_table()
    assert differences(actual, expected) == []


def test_rank_limits_run_before_the_shuffle(spark, sf_dir):
    plan = plan_of(entry.queries()["recent_activity"](spark, sf_dir))
    assert re.search(r"WindowGroupLimit .*, 20, Final[\s\S]*Exchange[\s\S]*WindowGroupLimit .*, 20, Partial", plan)


@pytest.mark.parametrize("name", ["top_users", "preview", "sample_users"])
def test_top_k_is_not_a_sort(spark, sf_dir, name):
    assert "TakeOrderedAndProject" in plan_of(entry.queries()[name](spark, sf_dir))


def test_build_shuffles_users_once_per_user_table(spark, inputs, cat, no_broadcast):
    """From the stored rollup without scores: the users move for the join with the names, not to be filled."""
    rollup = build.event_rollup(inputs.events, cat)
    plan = plan_of(build.assemble_user_clusters(rollup, None, cat))
    main = plan.split("BroadcastExchange")[0]
    assert "Exchange" not in main


def test_scores_stay_in_the_users_row(inputs, cat, no_broadcast):
    """Between the stored rollup and the slots: one scan, one vectorised step, nothing that moves or joins."""
    rollup = build.event_rollup(inputs.events, cat)
    plan = plan_of(build.model_slots(rollup, build.als_scores(rollup, cat), cat))
    assert "Exchange" not in plan and "Join" not in plan
    # The plan is printed once before and, by adaptive execution, once more at most.
    assert plan.count("FileScan parquet") == plan.count("ArrowEvalPython") == 1


def before_the_first_exchange(plan):
    """Nodes under every lowest exchange of a plan, from the scan up."""
    lines = [line for line in plan.split("== Initial Plan ==")[-1].splitlines() if line.strip()]
    found, below = [], []
    for line in reversed(lines):
        below = [] if "FileScan" in line else below
        below.append(line)
        if "Exchange" in line:
            found.append("\n".join(below))
    return [part for part in found if part.count("Exchange") == 1 and "FileScan" in part]


@pytest.fixture()
def stored(monkeypatch):
    """The plans of what operators store, in order."""
    from gapwise.operators import affinity, events

    plans, of = [], events.materialize

    def recorded(df, name):
        plans.append(plan_of(df))
        return of(df, name)

    monkeypatch.setattr(events, "materialize", recorded)
    monkeypatch.setattr(affinity, "materialize", recorded)
    return plans


def test_counts_and_times_of_the_rollup_are_hashed(inputs, cat, stored, no_broadcast):
    plan = plan_of(user_rollup(inputs.events, cat, ("process_name",)))
    assert len(stored) == 1 and stored[0].count("Exchange ") == 1 and stored[0].count("FileScan") == 1
    assert "SortAggregate" not in stored[0] and "Sort " not in stored[0]
    assert "IsNotNull(process_name)" in plan
    first = before_the_first_exchange(plan)
    assert first and all("Sort" not in part for part in first)
    # Without first values the filter of the counts reaches the scan.
    assert "EqualTo(status,COMPLETED)" in plan_of(user_rollup(inputs.events, cat))


@pytest.mark.parametrize(
    "operator", [lambda e: events.pass_through_first(e, "process_name"), events.latest_activity_hint], ids=["first", "latest"]
)
def test_text_is_taken_from_events_of_one_time(inputs, stored, no_broadcast, operator):
    plan = plan_of(operator(inputs.events))
    assert len(stored) == 1 and "Sort" not in stored[0] and "max_by" not in stored[0] and "min_by" not in stored[0]
    read = re.search(r"ReadSchema: (\S+)", stored[0])[1]
    assert "event_id" not in read
    first = before_the_first_exchange(plan)
    assert first and all("Sort" not in part for part in first)
    assert re.search(r"SortMergeJoin \[xxhash64\(user_id#\d+, created_at#\d+, 42\)\], \[wanted#\d+L\], LeftSemi", plan)


def test_ratings_are_not_keyed_by_service(inputs, cat, no_broadcast, monkeypatch):
    """Before the fit and after it users move by their own number; the sums of a fit are keyed by place in the equations."""
    from gapwise.operators import model, usage_factors

    plans, of = [], model.materialize

    def recorded(df, name):
        plans.append(plan_of(df))
        return of(df, name)

    monkeypatch.setattr(model, "materialize", recorded)
    monkeypatch.setattr(usage_factors, "materialize", recorded)
    indexed = model.index_affinity(inputs.affinity, inputs.user_index, cat)
    fitted = model.fit_als(indexed, cat, model.AlsParams(max_iter=1))
    plans.append(plan_of(fitted.userFactors))
    keys = {key for plan in plans for key in re.findall(r"hashpartitioning\((.*?), \d+\)", plan)}
    assert keys and all(k.startswith(("user_id#", "user_idx#", "service_0#", "part#")) for k in keys)
    assert "Exchange" not in plans[-1]


def test_titles_and_names_are_joined_where_users_are(spark, inputs, no_broadcast):
    plan = plan_of(entry.queries()["restore_names"](spark, inputs.sf_dir))
    assert len(re.findall(r"SortMergeJoin \[user_id#", plan)) == 1
    plan = plan_of(entry.queries()["attach_activity_names"](spark, inputs.sf_dir))
    assert plan.count("SortMergeJoin") == 1


def test_summary_does_not_double_the_rows(spark, sf_dir):
    assert "Expand" not in plan_of(entry.queries()["affinity_summary"](spark, sf_dir))


def test_all_users_are_not_sorted(spark, sf_dir):
    assert "rangepartitioning" not in plan_of(entry.queries()["user_stats"](spark, sf_dir))


def test_rank_lists_are_bounded_by_the_catalogue(inputs, cat):
    rollup = build.event_rollup(inputs.events, cat)
    rows = rank_lists(profile_uses(rollup), cat).collect()
    assert len(rows) == len(cat.core) + 1
    assert all(len(r["peers"]) <= len(cat.core) for r in rows)


def test_reports_read_the_cells(spark, inputs):
    """One scan of the users made them; no report reads users again."""
    for name in ("cluster_dist", "service_by_cluster", "rec_frequency", "rec_sources", "null_audit", "platform_kpis", "cluster_summary"):
        read = {path.split("/")[-2] for path in entry.queries()[name](spark, inputs.sf_dir).inputFiles()}
        assert read == ({"user_cells", "user_activity"} if name == "platform_kpis" else {"user_cells"})
    assert inputs.cells.count() < 200


def test_column_pruning(spark, inputs):
    plan = plan_of(entry.queries()["cluster_dist"](spark, inputs.sf_dir))
    assert "ReadSchema: struct<cluster_id:int,users:bigint>" in plan
    plan = plan_of(entry.queries()["user_directory"](spark, inputs.sf_dir))
    assert "rec1_score" not in plan

"""The fill rules: hand-written cases, and random tables against plain Python."""

import random

import pytest

from gapwise.catalog import Catalog, Segment, Service
from gapwise.operators import fill, gaps, ranking
from gapwise.operators.affinity import service_profiles
from gapwise.plans.build import model_slots

CODES = ("A", "B", "C", "D", "E", "F")
USERS_SCHEMA = (
    "user_id string, active_service string, cross_recommend_1 string, rec1_score double, "
    "rec1_source string, cross_recommend_2 string, rec2_score double, rec2_source string"
)


def catalog(n):
    codes = CODES[:n]
    return Catalog(
        services=tuple(Service(c, f"Service {c}", i % 3) for i, c in enumerate(codes)),
        core=codes,
        priority=codes,
        segments=(Segment(0, "Zero"), Segment(1, "One"), Segment(2, "Two")),
    )


def affinity_of(spark, uses):
    rows = [(u, s, n) for u, counts in uses.items() for s, n in counts.items()]
    return spark.createDataFrame(rows, "user_id string, process_type string, interaction_count long")


def users_of(spark, uses, slots, cat):
    rows = []
    for user in uses:
        one, two = slots.get(user, (None, None))
        rows.append((user, active(uses[user], cat), one, 88.0 if one else None, "als" if one else None,
                     two, 58.0 if two else None, "als" if two else None))
    return spark.createDataFrame(rows, USERS_SCHEMA)


# -- plain Python, one user at a time ------------------------------------------


def order(counts, cat, sign=-1):
    place = {c: i for i, c in enumerate(cat.priority)}
    return sorted(counts, key=lambda s: (sign * counts[s], place.get(s, len(place)), s))


def active(counts, cat):
    return order(counts, cat)[0]


def rankings(uses, cat):
    everyone, peers = {}, {}
    for counts in uses.values():
        mine = peers.setdefault(active(counts, cat), {})
        for service, n in counts.items():
            everyone[service] = everyone.get(service, 0) + n
            mine[service] = mine.get(service, 0) + n
    return order(everyone, cat), {a: order(totals, cat) for a, totals in peers.items()}


def first(candidates, *excluded):
    taken = set().union(*excluded)
    return next((s for s in candidates if s not in taken), None)


def growth(counts, cat):
    rest = [s for s in order(counts, cat, sign=1) if s != active(counts, cat)]
    rest = rest or list(counts)
    return (*rest, None)[:2] if len(rest) == 1 else rest[:2]


def expect_batch(uses, slots, cat):
    everyone, peers = rankings(uses, cat)
    out = {}
    for user, counts in uses.items():
        mine = peers[active(counts, cat)]
        near = mine[: max(3, len(cat.core) - 1)]
        given = slots.get(user, (None, None))
        picks, filled = list(given), []
        for slot in (0, 1):
            if picks[slot] is None:
                picks[slot] = first(mine + everyone, counts, [p for p in picks if p])
        for slot in (0, 1):
            if given[slot]:
                filled.append((picks[slot], (88.0, 58.0)[slot], "als"))
            elif picks[slot]:
                source = "peer" if picks[slot] in near else "global"
                filled.append((picks[slot], (72.0, 58.0)[slot], source))
            else:
                filled.append((None, None, None))
        if picks[0] is None and len(counts) >= len(cat.core):
            filled = [
                (s, score, "usage") if s else (None, None, None)
                for s, score in zip(growth(counts, cat), (65.0, 52.0))
            ]
        out[user] = (*filled[0], *filled[1])
    return out


def expect_repair(uses, slots, cat):
    everyone, peers = rankings(uses, cat)
    out = {}
    for user, counts in uses.items():
        mine = peers[active(counts, cat)]
        had = slots.get(user, (None, None))
        one = [had[0], 88.0, "als"] if had[0] else [None] * 3
        two = [had[1], 58.0, "als"] if had[1] else [None] * 3
        if not one[0]:
            pick = first(mine, counts, [had[1]])
            one = [pick, 72.0, "peer" if pick in mine[:3] else "global"] if pick else one
        if not two[0]:
            pick = first(mine + everyone, counts, [one[0]])
            two = [pick, 58.0, "peer" if pick in mine[:5] else "global"] if pick else two
        if not one[0] and len(counts) >= len(cat.core):
            a, b = growth(counts, cat)
            one, two = [a, 65.0, "usage"], [b, 52.0, "usage"] if b else [None] * 3
        if not two[0]:
            pick = first(everyone, [one[0], active(counts, cat)])
            two = [pick, 50.0, "global"] if pick else two
        out[user] = (*one, *two)
    return out


def slots_of(df):
    return {r["user_id"]: tuple(r[c] for c in fill.SLOT_COLUMNS) for r in df.collect()}


def random_case(seed):
    rng = random.Random(seed)
    n = rng.randint(1, len(CODES))
    cat = catalog(n)
    uses, slots = {}, {}
    for user in range(rng.randint(1, 25)):
        used = rng.sample(cat.core, rng.randint(1, n))
        uses[f"u{user}"] = {s: rng.randint(1, 3) for s in used}
        open_services = [s for s in cat.core if s not in used]
        rng.shuffle(open_services)
        if rng.random() < 0.5 and open_services:
            one = open_services[0]
            two = open_services[1] if len(open_services) > 1 and rng.random() < 0.5 else None
            slots[f"u{user}"] = (None, one) if rng.random() < 0.2 else (one, two)
    return cat, uses, slots


@pytest.mark.parametrize("seed", range(12))
def test_random_tables(spark, seed):
    cat, uses, slots = random_case(seed)
    affinity, users = affinity_of(spark, uses), users_of(spark, uses, slots, cat)
    assert slots_of(fill.fill_gaps(users, affinity, cat)) == expect_batch(uses, slots, cat)
    assert slots_of(fill.enrich_recs(users, affinity, cat)) == expect_repair(uses, slots, cat)


# -- single cases ----------------------------------------------------------------


def test_service_nobody_used_is_never_recommended(spark):
    """Someone with every seen service keeps empty slots and does not grow: the profile is not full."""
    cat, uses = catalog(3), {"all": {"A": 2, "B": 1}, "one": {"A": 1}}
    rows = slots_of(fill.fill_gaps(users_of(spark, uses, {}, cat), affinity_of(spark, uses), cat))
    assert rows["all"] == (None,) * 6
    assert rows["one"] == ("B", 72.0, "peer", None, None, None)


def test_catalogue_of_one_service(spark):
    cat, uses = catalog(1), {"u": {"A": 2}}
    rows = slots_of(fill.fill_gaps(users_of(spark, uses, {}, cat), affinity_of(spark, uses), cat))
    assert rows["u"] == ("A", 65.0, "usage", None, None, None)


def test_repair_never_fills_both_slots_with_one_service(spark):
    cat = catalog(3)
    uses = {"u": {"A": 3}, "v": {"A": 2, "B": 1, "C": 1}}
    slots = {"u": (None, "B")}
    rows = slots_of(
        fill.enrich_recs(users_of(spark, uses, slots, cat), affinity_of(spark, uses), cat)
    )
    assert rows["u"][0] == "C" and rows["u"][3] == "B"


def test_blank_slot_counts_as_empty(spark):
    cat, uses = catalog(2), {"u": {"A": 1}, "v": {"B": 1, "A": 2}}
    users = users_of(spark, uses, {"u": ("", "")}, cat)
    rows = slots_of(fill.fill_gaps(users, affinity_of(spark, uses), cat))
    assert rows["u"][:3] == ("B", 72.0, "peer")


def test_all_counts_tied(spark, cat):
    uses = {"u": {code: 1 for code in cat.core}}
    affinity = affinity_of(spark, uses)
    assert ranking.active_service(affinity, cat).first()["active_service"] == cat.priority[0]
    row = fill.usage_growth(affinity, cat).first()
    assert (row["growth_1"], row["growth_2"]) == cat.priority[1:3]


def test_unknown_service_loses_ties(spark, cat):
    affinity = affinity_of(spark, {"u": {"AAA_OTHER": 2, "DOCUMENT_EMBEDDING": 2}})
    assert ranking.active_service(affinity, cat).first()["active_service"] == "DOCUMENT_EMBEDDING"


def test_default_segment(spark, cat):
    users = spark.createDataFrame([("u", "SOMETHING"), ("v", "RESEARCH"), ("w", None)],
                                  "user_id string, active_service string")
    rows = {r["user_id"]: r["cluster_id"] for r in fill.assign_segment(users, cat).collect()}
    assert rows == {"u": 0, "v": 1, "w": 0}


def test_active_service_outside_the_catalogue_uses_the_global_list(spark):
    cat, uses = catalog(2), {"u": {"A": 1}, "v": {"A": 1, "B": 2}}
    users = spark.createDataFrame([("u", "GONE") + (None,) * 6, ("x", None) + (None,) * 6],
                                  USERS_SCHEMA)
    rows = slots_of(fill.enrich_recs(users, affinity_of(spark, uses), cat))
    assert rows["u"][:3] == ("B", 72.0, "peer")
    assert rows["x"][0] == "A"


def test_serve_time_fill(spark):
    cat = catalog(3)
    uses = {"u": {"A": 1}, "full": {"A": 1, "B": 2, "C": 9}, "kept": {"A": 1}}
    users = users_of(spark, uses, {"kept": ("B", None)}, cat)
    rows = slots_of(fill.serve_time_fill(users, affinity_of(spark, uses), cat))
    assert rows["u"][:3] == ("C", 65.0, "global")
    assert rows["full"][:3] == (None, None, None)
    assert rows["kept"][:3] == ("B", 88.0, "als")


def test_serve_time_fill_falls_back_to_catalogue_order(spark):
    cat = catalog(3)
    users = users_of(spark, {"u": {"A": 1}}, {}, cat)
    rows = slots_of(fill.serve_time_fill(users, affinity_of(spark, {"u": {"A": 1}}), cat))
    assert rows["u"][:3] == ("B", 65.0, "global")


@pytest.mark.parametrize("percentile_gaps", [False, True])
def test_slots_in_a_row_equal_slots_by_joins(spark, inputs, cat, percentile_gaps):
    """The batch build picks the model's slots within a user's row; the operators pick them by joins."""
    from dataclasses import replace

    settings = replace(cat.settings, use_percentile_gaps=percentile_gaps)
    chosen = replace(cat, settings=settings)
    users = service_profiles(inputs.affinity, chosen)
    in_row = model_slots(users, inputs.scorer(users), chosen).select(
        "user_id", "cross_recommend_1", "cross_recommend_2"
    )
    thresholds = None
    if percentile_gaps:
        from gapwise.operators.affinity import gap_thresholds

        thresholds = gap_thresholds(inputs.affinity, 0.25)
    adopted = gaps.adopted_services(inputs.affinity, thresholds, chosen)
    top = ranking.topn_per_user(gaps.gap_candidates(inputs.scores, adopted), chosen)
    joined = ranking.spread_ranks(inputs.active, top).select(*in_row.columns)
    assert sorted(map(repr, in_row.collect())) == sorted(map(repr, joined.collect()))

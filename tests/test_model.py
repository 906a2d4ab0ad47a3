"""Invariants of the model operators and of what is built from them."""

import itertools
import math
from fractions import Fraction
from functools import partial

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.recommendation import ALS
from pyspark.sql import functions as F

from gapwise.operators import affinity, model, usage_factors
from gapwise.operators.affinity import usage_matrix
from gapwise.operators.model import AlsParams
from gapwise.plans import build

# Score that each source gives to slots 1 and 2.
SCORES = {
    "als": (88.0, 58.0),
    "peer": (72.0, 58.0),
    "global": (72.0, 58.0),
    "usage": (65.0, 52.0),
}


@pytest.fixture(scope="module")
def matrix(inputs, cat):
    return usage_matrix(inputs.affinity, cat)


@pytest.fixture(scope="module")
def built(inputs, cat):
    scorer = partial(build.als_scores, cat=cat)
    table = build.build_user_clusters(inputs.events, inputs.names, cat, scorer)
    return [row.asDict() for row in table.collect()]


@pytest.fixture(scope="module")
def used(inputs):
    services = {}
    for row in inputs.affinity.collect():
        services.setdefault(row["user_id"], set()).add(row["process_type"])
    return services


def test_one_row_per_user(built, used):
    assert sorted(row["user_id"] for row in built) == sorted(used)


def test_slots_differ(built):
    for row in built:
        one, two = row["cross_recommend_1"], row["cross_recommend_2"]
        assert one is None or one != two


def test_sources_scores_and_gaps_agree(built, used, cat):
    seen = set()
    for row in built:
        for slot in (1, 2):
            service, source = row[f"cross_recommend_{slot}"], row[f"rec{slot}_source"]
            score = row[f"rec{slot}_score"]
            if service is None:
                assert source is None and score is None
                continue
            seen.add(source)
            assert score == SCORES[source][slot - 1]
            if source == "usage":
                assert len(used[row["user_id"]]) == len(cat.core)
            else:
                assert service not in used[row["user_id"]]
    assert {"als", "usage"} <= seen


def test_every_gap_is_recommended_when_scored(built, used, cat):
    for row in built:
        gaps = len(cat.core) - len(used[row["user_id"]])
        filled = sum(row[f"cross_recommend_{slot}"] is not None for slot in (1, 2))
        assert filled == (2 if gaps == 0 else min(gaps, 2))


# -- numbering ---------------------------------------------------------------------


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(5000).select((F.col("id") % 1777).cast("string").alias("key")).repartition(13)
    rows = model.dense_index(df, "key").collect()
    assert [r["key"] for r in sorted(rows, key=lambda r: r["idx"])] == sorted(
        str(i) for i in range(1777)
    )
    assert sorted(r["idx"] for r in rows) == list(range(1777))


def test_decoding_inverts_numbering(inputs, cat):
    indexed = model.index_affinity(inputs.affinity, inputs.user_index, cat)
    scored = indexed.select("user_idx", "process_idx", F.col("interaction_count").alias("score"))
    decoded = model.decode_index(scored, inputs.user_index, cat)
    expected = inputs.affinity.select(
        "user_id", "process_type", F.col("interaction_count").cast("double").alias("score")
    )
    assert sorted(map(tuple, decoded.collect())) == sorted(map(tuple, expected.collect()))


def test_numbers_outside_the_mapping_are_unknown(spark, inputs, cat):
    scored = spark.createDataFrame([(10**12, 0, 1.0), (0, 99, 1.0)], "user_idx long, process_idx int, score double")
    rows = model.decode_index(scored, inputs.user_index, cat).collect()
    assert {(r["user_id"] == "UNKNOWN", r["process_type"] == "UNKNOWN") for r in rows} == {
        (True, False), (False, True),
    }


# -- factor tables -------------------------------------------------------------------


@pytest.fixture(scope="module")
def indexed(inputs, cat):
    return model.index_affinity(inputs.affinity, inputs.user_index, cat)


@pytest.fixture(scope="module")
def library(indexed):
    """The library's fit with the same parameters, to compare with: each of its item blocks holds all ratings of a service."""
    params = AlsParams()
    als = ALS(
        userCol="user_idx", itemCol="process_idx", ratingCol="interaction_count", rank=params.rank,
        maxIter=params.max_iter, regParam=params.reg_param, implicitPrefs=True, alpha=params.alpha,
        coldStartStrategy="drop", seed=params.seed, nonnegative=True,
    )
    return als.fit(indexed.withColumn("user_idx", F.col("user_idx").cast("int")))


def test_scoring_equals_the_library(inputs, library):
    n = 3
    ours = {(r["user_idx"], r["process_idx"]): r["score"] for r in model.score_all(library, n).collect()}
    rows = library.recommendForAllUsers(n).collect()
    theirs = {(r["user_idx"], x["process_idx"]): x["rating"] for r in rows for x in r["recommendations"]}
    assert len(ours) == len(theirs) == n * inputs.user_index.count()
    for user in {u for u, _ in ours}:
        one, two = (sorted(v for (u, _), v in found.items() if u == user) for found in (ours, theirs))
        assert one == pytest.approx(two, abs=1e-5)


def test_factor_tables_are_the_model_of_the_matrix(inputs, matrix, cat):
    """The same vectors as from the usage matrix, and each user's exact factors for them."""
    fitted = usage_factors.fit_usage_factors(matrix, cat)
    items = {r["id"]: r["features"] for r in inputs.als_model.itemFactors.collect()}
    assert sorted(items) == list(range(len(cat.core)))
    assert np.allclose([items[i] for i in sorted(items)], fitted.vectors, rtol=1e-6)
    numbers = {r["user_id"]: r["user_idx"] for r in inputs.user_index.collect()}
    factors = {r["id"]: r["features"] for r in inputs.als_model.userFactors.collect()}
    rows = matrix.collect()
    counts = np.array([[r[c] for c in cat.core] for r in rows], dtype=float)
    expected = usage_factors.user_factors(counts, fitted.vectors, AlsParams())
    assert np.allclose([factors[numbers[r["user_id"]]] for r in rows], expected, rtol=1e-5, atol=1e-6)


def test_services_are_at_the_optimum_of_their_half_step(inputs, matrix, cat):
    """Moving any service's vector from the least-squares solution for these users raises the loss."""
    rows = matrix.collect()
    counts = np.array([[r[c] for c in cat.core] for r in rows], dtype=float)
    params = AlsParams()
    fitted = usage_factors.fit_usage_factors(matrix, cat, params)
    before = usage_factors.fit_usage_factors(matrix, cat, AlsParams(max_iter=params.max_iter - 1))
    users = usage_factors.user_factors(counts, before.vectors, params)
    least = loss(counts, users, fitted.vectors, params)
    assert least <= loss(counts, users, before.vectors, params)
    rng = np.random.default_rng(3)
    for _ in range(200):
        moved = np.maximum(fitted.vectors + rng.normal(scale=1e-3, size=fitted.vectors.shape), 0.0)
        assert loss(counts, users, moved, params) > least


def test_many_items_are_scored_the_same_way(spark):
    users = spark.createDataFrame([(1, [1.0, 2.0])], "id int, features array<float>")
    items = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(200)], "id int, features array<float>")
    rows = model.score_factors(users, items, 200).collect()
    assert {r["process_idx"]: r["score"] for r in rows} == {i: i + 1.0 for i in range(200)}
    assert model.score_factors(users, items.limit(0), 5).count() == 0


def test_numbers_of_64_bits(spark, cat):
    rows = [(1 << 40, 0, 3), (1 << 40, 1, 1), ((1 << 40) + 1, 1, 2)]
    indexed = spark.createDataFrame(rows, "user_idx long, process_idx int, interaction_count long")
    fitted = model.fit_als(indexed, cat, AlsParams(max_iter=2))
    scored = model.score_all(fitted, 5).collect()
    assert {(r["user_idx"], r["process_idx"]) for r in scored} == {(u, i) for u in (1 << 40, (1 << 40) + 1) for i in (0, 1)}
    none = model.fit_als(indexed.limit(0), cat, AlsParams(max_iter=2))
    assert none.userFactors.count() == none.itemFactors.count() == model.score_all(none, 5).count() == 0


def test_scores_are_finite(inputs, cat):
    rows = model.score_all(inputs.als_model, len(cat.core)).collect()
    assert all(math.isfinite(r["score"]) for r in rows)
    assert len(rows) == inputs.user_index.count() * len(cat.core)


def test_fits_repeat(indexed, cat):
    short = AlsParams(max_iter=2)
    once, again = (
        sorted((r["id"], tuple(r["features"])) for r in model.fit_als(indexed, cat, short).userFactors.collect())
        for _ in range(2)
    )
    assert once == again


# -- model without gathering users ------------------------------------------------------


def brute_force(a, b):
    """Non-negative minimiser by trying every set of positive coordinates."""
    best, value = np.zeros(len(b)), 0.0
    for size in range(1, len(b) + 1):
        for chosen in itertools.combinations(range(len(b)), size):
            part = list(chosen)
            x = np.zeros(len(b))
            x[part] = np.linalg.solve(a[np.ix_(part, part)], b[part])
            cost = 0.5 * x @ a @ x - b @ x
            if (x >= 0).all() and cost < value:
                best, value = x, cost
    return best


def test_nonnegative_solver():
    rng = np.random.default_rng(5)
    m, y = rng.normal(size=(40, 9, 5)), rng.normal(size=(40, 9))
    expected = [brute_force(m[i].T @ m[i], m[i].T @ y[i]) for i in range(40)]
    assert np.allclose(usage_factors.solve_nonnegative(m, y), expected, atol=1e-10)


def exact_scores(counts, vectors, params):
    """Scores of one user: an active-set solution in rational numbers, by trying sets of positive factors."""
    k = vectors.shape[1]
    exact = [[Fraction(float(v)) for v in row] for row in vectors]
    used = [c > 0 for c in counts]
    weight = [1 + Fraction(params.alpha) * int(c) for c in counts]
    ridge = Fraction(params.reg_param) * sum(used)
    a = [[sum(w * v[p] * v[q] for w, v in zip(weight, exact)) + (ridge if p == q else 0) for q in range(k)] for p in range(k)]
    b = [sum(w * v[p] for w, v, u in zip(weight, exact, used) if u) for p in range(k)]
    for size in range(k + 1):
        for chosen in itertools.combinations(range(k), size):
            x = [Fraction(0)] * k
            if chosen:
                for p, value in zip(chosen, _solve([[a[p][q] for q in chosen] for p in chosen], [b[p] for p in chosen])):
                    x[p] = value
            if min(x) < 0 or any(x[p] == 0 for p in chosen):
                continue
            slope = [b[p] - sum(a[p][q] * x[q] for q in range(k)) for p in range(k)]
            if all(slope[p] <= 0 for p in range(k) if p not in chosen):
                return [float(sum(x[p] * v[p] for p in range(k))) for v in exact]
    raise AssertionError("no solution")


def _solve(a, b):
    rows = [[*row, value] for row, value in zip(a, b)]
    for i in range(len(rows)):
        top = next(r for r in range(i, len(rows)) if rows[r][i] != 0)
        rows[i], rows[top] = rows[top], rows[i]
        rows[i] = [v / rows[i][i] for v in rows[i]]
        for r in range(len(rows)):
            if r != i:
                rows[r] = [v - rows[r][i] * w for v, w in zip(rows[r], rows[i])]
    return [row[-1] for row in rows]


@pytest.mark.parametrize("scale", [1, 10, 1000, 1_000_000])
def test_scores_are_exact_for_counts_of_any_size(scale):
    rng = np.random.default_rng(scale)
    params = AlsParams(rank=6)
    vectors = np.abs(rng.normal(size=(5, 6))) * (rng.random((5, 6)) < 0.8)
    counts = rng.integers(0, 5, size=(12, 5)) * scale
    found = usage_factors.user_factors(counts.astype(float), vectors, params) @ vectors.T
    expected = np.array([exact_scores(row, vectors, params) for row in counts])
    assert np.abs(found - expected).max() < 1e-6


def test_a_row_does_not_depend_on_its_batch():
    rng = np.random.default_rng(8)
    vectors = np.abs(rng.normal(size=(5, 10)))
    counts = rng.integers(0, 4, size=(50, 5)).astype(float) * 10.0 ** rng.integers(0, 6, size=(50, 1))
    together = usage_factors.user_factors(counts, vectors, AlsParams())
    alone = np.concatenate([usage_factors.user_factors(row[None], vectors, AlsParams()) for row in counts])
    assert (together == alone).all()


def loss(counts, factors, vectors, params):
    used = counts > 0
    error = (1 + params.alpha * counts) * (used - factors @ vectors.T) ** 2
    penalty = (used.sum(1) * (factors**2).sum(1)).sum() + (used.sum(0) * (vectors**2).sum(1)).sum()
    return error.sum() + params.reg_param * penalty


def test_fit_lowers_the_loss_to_the_library_level(inputs, library, matrix, cat):
    rows = sorted(matrix.collect(), key=lambda r: r["user_id"])
    counts = np.array([[r[c] for c in cat.core] for r in rows], dtype=float)
    losses = []
    for iterations in (1, 15):
        params = AlsParams(max_iter=iterations)
        fitted = usage_factors.fit_usage_factors(matrix, cat, params)
        factors = usage_factors.user_factors(counts, fitted.vectors, params)
        losses.append(loss(counts, factors, fitted.vectors, params))
    assert losses[1] < losses[0]

    users = {r["user_id"]: r["user_idx"] for r in inputs.user_index.collect()}
    by_item = {r["id"]: r["features"] for r in library.itemFactors.collect()}
    by_user = {r["id"]: r["features"] for r in library.userFactors.collect()}
    theirs = loss(
        counts,
        np.array([by_user[users[r["user_id"]]] for r in rows]),
        np.array([by_item[i] for i in range(len(cat.core))]),
        AlsParams(),
    )
    assert losses[1] < 1.15 * theirs


@pytest.fixture(scope="module")
def busy(spark, inputs, cat):
    """The rollup with counts from a few to a million."""
    rollup = build.event_rollup(inputs.events, cat)
    factor = F.pow(F.lit(10), F.pmod(F.xxhash64("user_id"), F.lit(7))).cast("long")
    more = F.transform(
        "usage", lambda u: u.withField("interaction_count", u["interaction_count"] * factor)
    )
    return rollup.withColumn("usage", F.array_sort(more))


def test_picks_do_not_depend_on_partitions(busy, cat):
    picks = []
    for n in (1, 4, 8):
        rollup = busy.repartition(n)
        slots = build.model_slots(rollup, build.als_scores(rollup, cat), cat)
        picks.append(sorted(map(tuple, slots.select("user_id", "cross_recommend_1", "cross_recommend_2").collect())))
    assert picks[0] == picks[1] == picks[2]


def test_service_without_users_is_not_scored(spark, cat):
    rows = [("u", [(3, 1, "RESEARCH")]), ("v", [(1, 2, "QUERY_ANSWER")])]
    users = spark.createDataFrame(
        rows, "user_id string, usage array<struct<interaction_count: long, priority: int, process_type: string>>"
    )
    fitted = usage_factors.fit_usage_factors(affinity.profile_matrix(users, cat), cat, AlsParams(max_iter=2))
    scored = users.select(usage_factors.usage_scores(fitted).alias("s")).collect()
    for r in scored:
        known = [code for code, value in zip(cat.core, r["s"]) if value is not None]
        assert set(known) == {"RESEARCH", "QUERY_ANSWER"}
        assert all(value is None or (math.isfinite(value) and value >= 0) for value in r["s"])


def test_empty_tables_have_a_model(spark, inputs, cat):
    none = build.event_rollup(inputs.events.limit(0), cat)
    assert build.model_slots(none, build.als_scores(none, cat), cat).count() == 0


# -- clusters -----------------------------------------------------------------------------


def test_k_sweep(matrix, cat):
    rows = model.k_sweep(matrix, cat, k_max=5).orderBy("k").collect()
    assert [r["k"] for r in rows] == [2, 3, 4, 5]
    assert rows[-1]["inertia"] < rows[0]["inertia"]
    best = [r for r in rows if r["is_best"]]
    assert len(best) == 1 and best[0]["silhouette"] == max(r["silhouette"] for r in rows)


def test_k_sweep_stops_below_the_number_of_users(matrix, cat):
    assert [r["k"] for r in model.k_sweep(matrix, cat, sample=4).collect()] == [2, 3]
    assert model.k_sweep(matrix.limit(0), cat).count() == 0


def test_kmeans_segments(matrix, cat):
    rows = model.kmeans_segments(matrix, cat).collect()
    assert {r["kmeans_cluster"] for r in rows} == {0, 1, 2} and len(rows) == matrix.count()


@pytest.fixture(scope="module")
def grouped(spark, cat):
    """Users of three kinds of profile, far apart: the best clustering is plain, whatever a model starts from."""
    kinds = [(1, 0, 0, 0, 0), (0, 300, 0, 300, 0), (0, 0, 90_000, 0, 90_000)]
    rows = [(f"u{i}", *[c + (i // 3 % 2 if c else 0) for c in kinds[i % 3]]) for i in range(600)]
    return spark.createDataFrame(rows, ["user_id", *cat.core])


def test_weighted_profiles_are_measured_as_all_users(grouped, cat):
    vectors = model.usage_vectors(grouped, cat).cache()
    assert model.weighted_vectors(grouped, cat).count() == 6
    swept = {r["k"]: r for r in model.k_sweep(grouped, cat, k_max=3).collect()}
    for k in (2, 3):
        plain = KMeans(k=k, seed=7).fit(vectors)
        assert swept[k]["inertia"] == pytest.approx(plain.summary.trainingCost, rel=1e-6, abs=1e-6)
        assert swept[k]["silhouette"] == pytest.approx(ClusteringEvaluator().evaluate(plain.transform(vectors)), abs=1e-6)
    assert [k for k, r in swept.items() if r["is_best"]] == [3]
    found = {r["user_id"]: r["kmeans_cluster"] for r in model.kmeans_segments(grouped, cat).collect()}
    assert len(found) == 600
    assert all(found[f"u{i}"] == found[f"u{i % 3}"] for i in range(600)) and len(set(found.values())) == 3


def test_no_more_clusters_than_profiles(grouped, cat):
    assert [r["k"] for r in model.k_sweep(grouped, cat, k_max=8).collect()] == [2, 3, 4, 5, 6]
    alone = grouped.filter("user_id IN ('u0', 'u6', 'u12')")
    assert model.k_sweep(alone, cat).count() == 0

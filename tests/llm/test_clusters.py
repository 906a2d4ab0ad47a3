import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gapwise.llm import op13_clusters as op
from gapwise.llm.queries import queries

SMALL = op.ClusterParams(clusters=3, rounds=4, dimensions=2, scale=4, seed=3)
SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, x string, distance int, at int"


def lloyd(rows, params):
    """All distances, round after round, in plain integers; rows of (vec_id, components)."""
    kept = [
        (i, [math.floor(params.scale * v) for v in x])
        for i, x in rows
        if x is not None and len(x) == params.dimensions and all(v is not None and math.isfinite(v) for v in x)
    ]
    name = lambda i: hashlib.sha256(f"{params.seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [x for _, x in sorted(kept, key=lambda r: (name(r[0]), r[1]))[: params.clusters]]
    square = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))

    def nearest():
        return [min((square(x, c), k) for k, c in enumerate(centroids)) for _, x in kept]

    for _ in range(params.rounds):
        found = nearest()
        for k in range(len(centroids)):
            mine = [x for (_, x), (_, own) in zip(kept, found) if own == k]
            if mine:
                centroids[k] = [sum(column) // len(mine) for column in zip(*mine)]
    found = nearest()
    return [(i, k, d) for (i, _), (d, k) in zip(kept, found)], centroids


def key(row):
    return (row[0] is not None, row)


def assigned(spark, rows, params):
    table = spark.createDataFrame([(i, x, 1, "c", "x", 2, 3) for i, x in rows], SCHEMA)
    found, centroids = op.cluster_vectors(table, params)
    return [(r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()], centroids.orderBy("cluster").collect()


ODD = [
    (1, [0.3, -0.2]), (1, [0.3, -0.2]), (1, [5.0, 5.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]),
    (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (None, [-4.0, -4.1]), (None, [-4.0, -4.1]),
    (9, [-0.1, -0.1]), (10, [4.9, 5.2]), (11, [2.5, 2.5]), (12, [-100.0, 70.0]),
]


@pytest.mark.parametrize("rows", [ODD, ODD[:2], ODD[3:10], []], ids=["odd", "fewer than centroids", "none usable", "empty"])
def test_odd_vectors(spark, rows):
    found, centroids = assigned(spark, rows, SMALL)
    expected, middle = lloyd(rows, SMALL)
    assert sorted(found, key=key) == sorted(expected, key=key)
    assert [r["components"] for r in centroids] == middle
    for row in centroids:
        own = [d for _, k, d in expected if k == row["cluster"]]
        assert (row["members"], row["cluster_inertia"], row["inertia"]) == (len(own), sum(own), sum(d for *_, d in expected))


def test_many_equal_vectors_and_ties(spark):
    rows = [(i, [1.0, 1.0]) for i in range(400)] + [(400 + i, [float(i % 5), float(i % 3)]) for i in range(100)]
    found, _ = assigned(spark, rows, SMALL)
    assert sorted(found) == sorted(lloyd(rows, SMALL)[0])


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=8),
    st.lists(st.lists(st.integers(-4, 4), min_size=2, max_size=2), max_size=20),
    st.sampled_from([1, (1 << 26) // 4]),
)
def test_tournament_is_the_nearest(centroids, points, factor):
    """Zero leaves the smaller number; large components go by integers instead of doubles."""
    c = np.array(centroids, np.int64) * factor
    x = np.array(points, np.int64).reshape(-1, 2) * factor
    b = op.Bisectors(c)
    found = b.nearest(x)
    square = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert found.tolist() == square.argmin(axis=1).tolist()
    assert b.distances(x, found).tolist() == square.min(axis=1).tolist()


def test_components_beyond_exact_distances_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        assigned(spark, [(1, [1e9, 0.0])], SMALL)


def test_query_has_a_row_per_vector(spark, tiny_dir):
    rows = queries()["op13_clusters"](spark, tiny_dir)
    assert set(rows.columns) == {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"}
    found = [(r["vec_id"], r["cluster"], r["distance"]) for r in rows.collect()]
    source = spark.read.parquet(f"{tiny_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    expected, middle = lloyd([tuple(r) for r in source], op.ClusterParams())
    assert sorted(found) == sorted(expected)
    hashes = {k: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for k, c in enumerate(middle)}
    assert all(r["centroid_sha256"] == hashes[r["cluster"]] for r in rows.collect())

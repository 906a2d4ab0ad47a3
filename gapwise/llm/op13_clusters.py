"""Clustering around integer centroids, the nearest one found by a tournament of bisectors.

A vector lies nearer to centroid j than to centroid i exactly where a linear form is positive: its inner product with
2 (j - i) exceeds |j|^2 - |i|^2.  These normals and thresholds are integers, made once a round for all pairs of
centroids.  A vector starts with centroid 0 and meets the others in order; each of the k - 1 tests eliminates one
of two, and zero leaves the smaller number.  Only the winner's distance is computed, exactly.

Vectors stay where they are.  A task adds up its own members of every centroid, so a vector that occurs very often costs
no more than others, and what meets is k rows of sums a task.  The quantised vectors are a stored table, read
once a round, so a lost executor repeats one scan.

Nulls: a vector that is missing, has another number of components, or one that is missing or not finite, is left out;
a missing id is hashed as empty text and kept.  Rows are never merged: repeated ids and equal vectors are vectors of
their own, and equal hashes are ordered by components.  With fewer vectors than centroids, there are as many centroids
as vectors; an empty table gives no rows.  Components of 2^27 or more after scaling are an error, since
the distance would not fit its type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm.common import keep_table

#: Scaled components below this keep every distance of up to 64 components below 2^63.
LARGEST = 1 << 27

#: Products and sums up to this are exact in doubles.
EXACT_DOUBLE = 1 << 53


@dataclass(frozen=True)
class ClusterParams:
    clusters: int = 8
    rounds: int = 10
    dimensions: int = 64
    scale: int = 1024
    seed: int = 3


def quantise(vectors: DataFrame, params: ClusterParams = ClusterParams(), vector: str = "embedding") -> DataFrame:
    """``vec_id`` and the integers floor(scale * component) of every usable vector."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    too_large = F.raise_error(F.lit("a component is too large for exact distances")).cast("bigint")

    def scaled(v: Column) -> Column:
        return F.when(F.abs(v) < LARGEST // params.scale, F.floor(v * params.scale)).otherwise(too_large)

    usable = vectors.where((F.size(vector) == params.dimensions) & finite)
    return usable.select("vec_id", F.transform(x, scaled).alias("x"))


def first_centroids(points: DataFrame, params: ClusterParams = ClusterParams()) -> np.ndarray:
    """The vectors whose seeded ids have the smallest hashes, a row each; at most ``clusters`` rows reach the driver."""
    text = F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = points.orderBy(F.sha2(text, 256), "x").limit(params.clusters).collect()
    return np.array([row["x"] for row in rows], np.int64).reshape(len(rows), params.dimensions)


class Bisectors:
    """Normals and thresholds of all pairs of centroids, for one round."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        squares = np.einsum("kd,kd->k", centroids, centroids)
        self.normals = 2 * (centroids[None, :, :] - centroids[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of each row, the smaller of equals."""
        normals = self.normals
        bound = int(np.abs(x).max(initial=0)) * int(np.abs(normals).max(initial=0)) * x.shape[1]
        if bound < EXACT_DOUBLE:  # the same integers, by faster products
            x, normals = x.astype(float), normals.astype(float)
        holder = np.zeros(len(x), np.int32)
        for challenger in range(1, len(self.centroids)):
            beaten = []
            for champion in range(challenger):
                rows = np.flatnonzero(holder == champion)
                side = x[rows] @ normals[champion, challenger] - self.thresholds[champion, challenger]
                beaten.append(rows[side > 0])
            holder[np.concatenate(beaten)] = challenger
        return holder

    def distances(self, x: np.ndarray, nearest: np.ndarray) -> np.ndarray:
        apart = x - self.centroids[nearest]
        return np.einsum("nd,nd->n", apart, apart)


def _matrix(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _next_centroids(points: DataFrame, bisectors: Bisectors, params: ClusterParams) -> np.ndarray:
    """Exact floors of the members' means; a centroid without members stays."""
    k, d = bisectors.centroids.shape

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch, d)
            nearest = bisectors.nearest(x)
            for number in range(k):
                mine = nearest == number
                totals[number] += x[mine].sum(axis=0)
                counts[number] += int(mine.sum())
        for number in np.flatnonzero(counts):
            yield pa.RecordBatch.from_pydict(
                {
                    "cluster": pa.array(np.full(d, number), pa.int32()),
                    "at": pa.array(range(d), pa.int32()),
                    "total": pa.array(totals[number], pa.int64()),
                    "n": pa.array(np.full(d, counts[number]), pa.int64()),
                }
            )

    parts = points.select("x").mapInArrow(members, "cluster int, at int, total bigint, n bigint")
    exact = F.sum(F.col("total").cast("decimal(38,0)"))
    moved = bisectors.centroids.copy()
    # clusters * dimensions rows, whatever the input
    for row in parts.groupBy("cluster", "at").agg(exact.alias("total"), F.sum("n").alias("n")).collect():
        moved[row["cluster"], row["at"]] = int(row["total"]) // row["n"]
    return moved


def fit(points: DataFrame, params: ClusterParams = ClusterParams()) -> np.ndarray:
    """Centroids after all rounds, a row each; runs a job a round over the stored ``points``."""
    centroids = first_centroids(points, params)
    if len(centroids):
        for _ in range(params.rounds):
            centroids = _next_centroids(points, Bisectors(centroids), params)
    return centroids


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` (squared) of every vector."""
    kind = points.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return points.selectExpr("vec_id", "CAST(0 AS int) AS cluster", "CAST(0 AS bigint) AS distance").limit(0)
    bisectors = Bisectors(centroids)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, centroids.shape[1])
            found = bisectors.nearest(x)
            columns = [batch.column("vec_id"), pa.array(found), pa.array(bisectors.distances(x, found))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return points.mapInArrow(nearest, f"vec_id {kind}, cluster int, distance bigint")


def describe(spark: SparkSession, assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """A row per centroid: its components and their hash, members, and the sums of distances."""
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    rows = assigned.groupBy("cluster").agg(F.count("*").alias("members"), total.alias("inertia")).collect()
    found = {row["cluster"]: (row["members"], int(row["inertia"])) for row in rows}
    inertia = sum(own for _, own in found.values())
    table = []
    for number, components in enumerate(centroids.tolist()):
        members, own = found.get(number, (0, 0))
        text = ",".join(map(str, components))
        table.append((number, components, members, own, inertia, hashlib.sha256(text.encode()).hexdigest()))
    return spark.createDataFrame(
        table,
        "cluster int, components array<bigint>, members bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )


def cluster_vectors(
    vectors: DataFrame, params: ClusterParams = ClusterParams(), vector: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """The vectors with cluster and distance, and the table of the centroids (at most ``clusters`` rows)."""
    points, _ = keep_table(quantise(vectors, params, vector), "points")
    centroids = fit(points, params)
    assigned, _ = keep_table(assign(points, centroids), "assigned")
    return assigned, describe(vectors.sparkSession, assigned, centroids)


def oracle(params: ClusterParams = ClusterParams()) -> str:
    """The same by all distances, round after round."""
    d, k = params.dimensions, params.clusters

    def nearest(name: str, centroids: str) -> str:
        square = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        return (
            f"{name} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, "
            f"min(struct_pack(d := d, k := k)) AS m FROM (SELECT r, vec_id, x, k, {square} AS d "
            f"FROM kept CROSS JOIN {centroids}) GROUP BY r)"
        )

    steps = []
    for at in range(params.rounds):
        steps.append(nearest(f"near{at}", f"c{at}"))
        steps.append(
            f"c{at + 1} AS MATERIALIZED (SELECT o.k, coalesce(n.c, o.c) AS c FROM c{at} o LEFT JOIN ("
            "SELECT k, list(divide(s - ((s % n) + n) % n, n) ORDER BY place) AS c FROM ("
            f"SELECT m.k AS k, place, sum(x[place])::BIGINT AS s, count(*) AS n FROM near{at} CROSS JOIN range(1, {d + 1}) t(place) "
            "GROUP BY m.k, place) GROUP BY k) n USING (k))"
        )
    steps.append(nearest("final", f"c{params.rounds}"))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda v: floor({params.scale} * v::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = {d} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {d}
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c
  FROM (SELECT sha256('{params.seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM kept ORDER BY h, x LIMIT {k})
),
{",".join(steps)},
sums AS (SELECT m.k AS k, sum(m.d)::BIGINT AS cluster_inertia FROM final GROUP BY m.k)
SELECT vec_id, m.k::INTEGER AS cluster, m.d AS distance, cluster_inertia,
       (SELECT sum(cluster_inertia) FROM sums)::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM final JOIN c{params.rounds} o ON o.k = m.k JOIN sums ON sums.k = m.k
"""

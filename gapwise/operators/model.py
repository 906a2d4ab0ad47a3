"""Model operators: id numbering, implicit-feedback factorisation, cluster diagnostics."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.catalog import Catalog, lookup
from gapwise.operators.insights import sample_users
from gapwise.operators.usage_factors import SEED, AlsParams, fit_columns, user_factor_rows
from gapwise.storage import materialize

# Id of users or services outside the numbering, number of segments.
UNKNOWN_ID = "UNKNOWN"
SEGMENTS = 3

# Models of a sweep that are trained at a time; each runs many short jobs.
SWEEP_THREADS = 4


def dense_index(df: DataFrame, col: str, index: str = "idx") -> DataFrame:
    """Mapping table from the distinct values of ``col`` to 0..n-1, in their order.

    Range-partitioned, sorted, and written once with each row's place in its
    partition; the partitions' sizes then give the offsets.  Nothing but one row
    per partition is ever in one place, and because the numbering reads what was
    written, a lost executor cannot move the boundaries.
    """
    place = F.monotonically_increasing_id()
    ordered = (
        df.select(col)
        .distinct()
        .repartitionByRange(col)
        .sortWithinPartitions(col)
        .withColumn("place", place)
        .select(
            col,
            F.shiftright("place", 33).alias("part"),
            F.col("place").bitwiseAND((1 << 33) - 1).alias("local"),
        )
    )
    placed = materialize(ordered, f"index-{col}")
    sizes = placed.groupBy("part").agg(F.count("*").alias("rows"))
    # One row per partition of the line above: a window without keys is fine here.
    offsets = sizes.selectExpr(
        "part",
        "coalesce(sum(rows) OVER "
        "(ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset",
    )
    number = F.col("offset") + F.col("local")
    return placed.join(F.broadcast(offsets), "part").select(col, number.alias(index))


def extend_index(known: DataFrame, df: DataFrame, col: str, index: str = "idx") -> DataFrame:
    """The mapping ``known`` with the values of ``df`` that it lacks, numbered after its greatest number.

    Old numbers stay, so tables that hold them stay right, and numbers remain dense.  NULL is a value.  Neither
    mapping is gathered; the new values alone are sorted.
    """
    have = known.select(F.col(col).alias("have"))
    fresh = df.select(col).distinct().join(have, F.col(col).eqNullSafe(F.col("have")), "left_anti")
    start = known.agg(F.coalesce(F.max(index) + 1, F.lit(0).cast("long"))).scalar()
    numbered = dense_index(fresh, col, index)
    return known.select(col, index).unionByName(numbered.withColumn(index, F.col(index) + start))


def index_affinity(affinity_df: DataFrame, users: DataFrame, cat: Catalog) -> DataFrame:
    """The affinity table with numbered users and core services.

    Users take their numbers from the mapping table; a service's number is its
    place in the catalogue, which needs no table.
    """
    place = lookup({code: i for i, code in enumerate(cat.core)}, F.col("process_type"), "int")
    return (
        affinity_df.withColumn("process_idx", place)
        .filter(F.col("process_idx").isNotNull())
        .join(users, "user_id")
        .select("user_idx", "process_idx", "interaction_count", "user_id", "process_type")
    )


@dataclass(frozen=True)
class FactorTables:
    """A fitted model as tables of ``id`` and ``features``, one of users and one of services."""

    userFactors: DataFrame  # noqa: N815, named as the library's models name them
    itemFactors: DataFrame  # noqa: N815


def fit_als(indexed: DataFrame, cat: Catalog, params: AlsParams = AlsParams()) -> FactorTables:
    """Implicit-feedback factors of the numbered users and services; runs the jobs of the fit.

    The ratings become one row of counts per user, combined before the shuffle, and users move no further: a service's
    equations are sums that each task adds up over its users.  No block holds the ratings of a service, and
    numbers may have 64 bits.  A service that nobody has used has no row.
    """
    services = [f"service_{place}" for place in range(len(cat.core))]
    cells = [
        F.coalesce(F.sum(F.when(F.col("process_idx") == place, F.col("interaction_count"))), F.lit(0)).alias(name)
        for place, name in enumerate(services)
    ]
    counts = materialize(indexed.groupBy("user_idx").agg(*cells), "user-counts")
    fitted = fit_columns(counts, services, params)
    known = [(place, vector.tolist()) for place, vector in enumerate(fitted.vectors) if vector.any()]
    items = counts.sparkSession.createDataFrame(known, "id int, features array<float>")
    return FactorTables(user_factor_rows(counts, "user_idx", fitted), items)


def score_all(model: FactorTables, n_items: int) -> DataFrame:
    """The ``n_items`` best scored services of every user, as rows."""
    return score_factors(model.userFactors, model.itemFactors, n_items)


def score_factors(users: DataFrame, items: DataFrame, n_items: int) -> DataFrame:
    """Scores of ``users`` for ``items``, both with ``id`` and ``features``: the best ``n_items`` each.

    There are as many items as services, whatever the data; they become one array and each user
    is scored in place, without a shuffle.  Equal scores go to the greater number.
    """
    rows = sorted(items.collect(), key=lambda row: row.id)
    if not rows:
        return users.select(
            F.col("id").alias("user_idx"), F.lit(None).cast("int").alias("process_idx"),
            F.lit(None).cast("float").alias("score"),
        ).limit(0)
    vectors = F.array(
        *[
            F.struct(F.lit(row.id).alias("id"), F.array(*[F.lit(float(v)) for v in row.features]).alias("v"))
            for row in rows
        ]
    )

    def dot(item: Column) -> Column:
        products = F.zip_with("features", item["v"], lambda x, y: x.cast("double") * y)
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)

    scored = F.transform(
        vectors, lambda item: F.struct(dot(item).cast("float").alias("score"), item["id"].alias("process_idx"))
    )
    best = F.slice(F.sort_array(scored, asc=False), 1, n_items)
    return users.select(F.col("id").alias("user_idx"), F.inline(best)).select(
        "user_idx", "process_idx", "score"
    )


def decode_index(scored: DataFrame, users: DataFrame, cat: Catalog) -> DataFrame:
    """Numbers back to ids; a number outside the numbering decodes to the unknown id."""
    service = lookup(dict(enumerate(cat.core)), F.col("process_idx"), "string")
    return scored.join(users, "user_idx", "left").select(
        F.coalesce("user_id", F.lit(UNKNOWN_ID)).alias("user_id"),
        F.coalesce(service, F.lit(UNKNOWN_ID)).alias("process_type"),
        F.col("score").cast("double").alias("score"),
    )


# -- clusters of usage vectors ----------------------------------------------------


def usage_vectors(matrix: DataFrame, cat: Catalog, *others: str) -> DataFrame:
    """log1p of the usage matrix as feature vectors, beside ``others`` (the user's id if none are named)."""
    kept = others or ("user_id",)
    logged = matrix.select(*kept, *[F.log1p(code).alias(code) for code in cat.core])
    assembler = VectorAssembler(inputCols=list(cat.core), outputCol="features")
    return assembler.transform(logged).select(*kept, "features")


def weighted_vectors(matrix: DataFrame, cat: Catalog) -> DataFrame:
    """The distinct count rows with ``users``, how many share each, stored once.

    Users with equal counts are one weighted point, which is the same to K-Means and to the silhouette; training works on
    as many rows as there are different profiles.
    """
    distinct = matrix.groupBy(*cat.core).agg(F.count("*").alias("users"))
    return materialize(distinct, "usage-vectors")


def fit_kmeans(vectors: DataFrame, k: int, prediction: str = "prediction") -> KMeansModel:
    """K-Means over ``features`` weighted by ``users``."""
    return KMeans(k=k, seed=SEED, weightCol="users", predictionCol=prediction).fit(vectors)


def silhouette(predicted: DataFrame) -> float | None:
    """Mean squared-Euclidean silhouette of the users behind weighted points with ``features`` and ``prediction``.

    A point stands for ``users`` equal users, each of which is left out of its own cluster's mean alone; the library's
    evaluator would leave out all of them.  From sums per cluster, a row each; NULL for fewer than two clusters.
    """
    x = vector_to_array("features")
    size = F.aggregate(x, F.lit(0.0), lambda total, v: total + v * v)
    points = predicted.select("users", "prediction", x.alias("x"), size.alias("size"))
    places = F.posexplode("x").alias("at", "v")
    sums = points.select("users", "prediction", places).groupBy("prediction", "at").agg(F.sum(F.col("users") * F.col("v")).alias("s"))
    centres = sums.groupBy("prediction").agg(F.sort_array(F.collect_list(F.struct("at", "s"))).getField("s").alias("sums"))
    totals = points.groupBy("prediction").agg(
        F.sum("users").alias("users"), F.sum(F.col("users") * F.col("size")).alias("sizes")
    )
    clusters = totals.join(centres, "prediction").collect()  # a row per cluster
    if len(clusters) < 2:
        return None
    table = F.array(
        *[
            F.struct(
                F.lit(c["prediction"]).alias("cluster"), F.lit(float(c["users"])).alias("users"),
                F.lit(float(c["sizes"])).alias("sizes"), F.array(*map(F.lit, c["sums"])).alias("sums"),
            )
            for c in clusters
        ]
    )

    def apart(c: Column) -> Column:
        """Mean squared distance to the users of a cluster."""
        product = F.aggregate(F.zip_with("x", c["sums"], lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)
        return F.greatest((c["sizes"] + c["users"] * F.col("size") - 2 * product) / c["users"], F.lit(0.0))

    own = F.get(F.filter(table, lambda c: c["cluster"] == F.col("prediction")), 0)
    inner = apart(own) * own["users"] / (own["users"] - 1)
    outer = F.array_min(F.transform(F.filter(table, lambda c: c["cluster"] != F.col("prediction")), apart))
    alone = own["users"] <= 1
    score = F.when(alone, 0.0).otherwise((outer - inner) / F.nullif(F.greatest(outer, inner), F.lit(0.0)))
    weighted = F.col("users") * F.coalesce(score, F.lit(0.0))
    return points.agg(F.sum(weighted) / F.sum("users")).first()[0]


def k_sweep(
    matrix: DataFrame,
    cat: Catalog,
    k_min: int | None = None,
    k_max: int | None = None,
    sample: int | None = None,
) -> DataFrame:
    """Inertia and silhouette for each K, and which K has the best silhouette.

    Over all users, or over a seeded sample of ``sample`` users.  The silhouette
    is the squared-Euclidean one, which is computed from per-cluster sums.  K stays below the number of users and goes
    no further than the number of different profiles.
    """
    k_min = cat.settings.k_min if k_min is None else k_min
    k_max = cat.settings.k_max if k_max is None else k_max
    chosen = matrix if sample is None else sample_users(matrix, sample, SEED)
    table = weighted_vectors(chosen, cat)
    vectors = usage_vectors(table, cat, "users")
    sizes = table.agg(F.count("*").alias("profiles"), F.coalesce(F.sum("users"), F.lit(0)).alias("users")).first()
    last = min(k_max, sizes["users"] - 1, sizes["profiles"])
    def measure(k: int) -> tuple[int, float, float]:
        model = fit_kmeans(vectors, k)
        return k, float(model.summary.trainingCost), silhouette(model.transform(vectors))

    tried = range(max(k_min, 2), last + 1)
    with ThreadPool(SWEEP_THREADS) as threads:
        rows = threads.map(inheritable_thread_target(table.sparkSession)(measure), tried)
    measured = [row for row in rows if row[2] is not None]
    best = max(measured, key=lambda row: (row[2], -row[0]))[0] if measured else None
    return table.sparkSession.createDataFrame(
        [(*row, row[0] == best) for row in rows],
        "k int, inertia double, silhouette double, is_best boolean",
    )


def kmeans_segments(matrix: DataFrame, cat: Catalog, k: int = SEGMENTS) -> DataFrame:
    """Segments by K-Means over the usage vectors: an alternative, never the default.

    Trained on the different profiles; every user is then assigned in its own row.
    """
    model = fit_kmeans(usage_vectors(weighted_vectors(matrix, cat), cat, "users"), k, "kmeans_cluster")
    return model.transform(usage_vectors(matrix, cat)).select("user_id", "kmeans_cluster")

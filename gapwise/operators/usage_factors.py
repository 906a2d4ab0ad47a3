"""The same implicit-feedback factorisation for any number of users per service.

The library ALS gathers all ratings of an item in one block.  There are only a
few services and each of them is used by a large share of the users, so past a
number of users that block no longer fits a task.  Seen from the other side the
problem is easy: a user's factors depend only on the user's own row of counts
and on the service factors, and a service's normal equations are sums over
users.  So users stay where they are, each task adds up its own users' terms,
and what meets is one small matrix per service.

Users with the same counts have the same factors, so the fit runs over the
distinct count rows, weighted by how many users share them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.catalog import Catalog
from gapwise.operators.affinity import usage_counts
from gapwise.storage import materialize

# Fixed value: model seed.
SEED = 42

# Decimals of a score.  What ranks services is what a user of the table can see, and
# the order in which Spark adds up doubles cannot decide between equals.
SCORE_DECIMALS = 6

# Digits kept of the sums over users, for the same reason.
SUM_DIGITS = 10

# A slope is zero if it is below this share of what rounding may leave of it.
ROUNDING = 1e-13


@dataclass(frozen=True)
class AlsParams:
    # Model parameters.
    rank: int = 10
    max_iter: int = 15
    reg_param: float = 0.1
    alpha: float = 40.0
    seed: int = SEED


@dataclass(frozen=True)
class UsageFactors:
    """A fitted model: one factor vector per service (rows follow ``services``)."""

    services: tuple[str, ...]
    vectors: np.ndarray
    params: AlsParams


def _least_squares(m: np.ndarray, y: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Per system the x with the least |m x - y| among those that are zero off ``free``."""
    k = m.shape[2]
    # A fixed coordinate gets an equation of its own, which keeps the columns independent.
    held = np.where(free[:, None, :], 0.0, np.eye(k))
    q, r = np.linalg.qr(np.concatenate([m * free[:, None, :], held], axis=1))
    right = np.einsum("brk,br->bk", q[:, : m.shape[1]], y)
    return np.where(free, np.linalg.solve(r, right[:, :, None])[:, :, 0], 0.0)


def solve_nonnegative(m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each system, the x >= 0 with the least |m x - y|, by active sets.

    ``m`` has independent columns, or ``y`` is zero.  A coordinate is freed while that lowers the error, and
    coordinates that would turn negative are fixed again.  Each system goes its own way, so its
    result does not depend on the others; one that does not end is an error.
    """
    batch, _, k = m.shape
    x, free = np.zeros((batch, k)), np.zeros((batch, k), bool)
    barred = np.zeros((batch, k), bool)
    least = ROUNDING * np.sqrt(np.einsum("brk,brk->bk", m, m)) * np.sqrt(np.einsum("br,br->b", y, y))[:, None]
    todo = np.arange(batch)
    for _ in range(20 * k):
        residual = y[todo] - np.einsum("brk,bk->br", m[todo], x[todo])
        slope = np.einsum("brk,br->bk", m[todo], residual)
        slope = np.where(free[todo] | barred[todo] | (slope <= least[todo]), -np.inf, slope)
        best = slope.argmax(axis=1)
        rises = slope[np.arange(len(todo)), best] > 0
        todo, best = todo[rises], best[rises]
        if not len(todo):
            return x
        free[todo, best] = True
        inner = todo
        while len(inner):
            z = _least_squares(m[inner], y[inner], free[inner])
            negative = free[inner] & (z <= 0)
            fine = ~negative.any(axis=1)
            x[inner[fine]] = z[fine]
            inner, z, negative = inner[~fine], z[~fine], negative[~fine]
            old = x[inner]
            share = np.where(negative, old / np.where(negative, old - z, 1.0), np.inf)
            step = share.min(axis=1, initial=1.0)[:, None]
            moved = old + step * (z - old)
            fixed = negative & (share <= step)
            x[inner] = np.where(fixed, 0.0, np.maximum(moved, 0.0))
            free[inner] &= ~fixed
        # A coordinate that fell back at once has a slope of rounding errors only.
        back = ~free[todo, best]
        barred[todo[~back]] = False
        barred[todo[back], best[back]] = True
    raise ArithmeticError("the non-negative solver did not end")


def user_factors(counts: np.ndarray, vectors: np.ndarray, params: AlsParams) -> np.ndarray:
    """Factors of users, given their counts (a row each) and the service vectors.

    A row of equations per service, weighted by confidence, and one per factor for the penalty: unlike
    the normal equations these keep their digits for counts of any size.
    """
    used = counts > 0
    root = np.sqrt(1.0 + params.alpha * counts)
    penalty = np.sqrt(params.reg_param * used.sum(axis=1))
    rank = vectors.shape[1]
    rows = np.concatenate(
        [root[:, :, None] * vectors, penalty[:, None, None] * np.eye(rank)], axis=1
    )
    right = np.concatenate([root * used, np.zeros((len(counts), rank))], axis=1)
    return solve_nonnegative(rows, right)


def _service_sums(
    counts: np.ndarray, weights: np.ndarray, factors: np.ndarray, alpha: float
) -> np.ndarray:
    """Terms of the services' normal equations that these users contribute, flattened."""
    confidence = alpha * counts
    used = counts > 0
    gram = np.einsum("u,uj,uk->jk", weights, factors, factors)
    squares = np.einsum("u,ui,uj,uk->ijk", weights, confidence, factors, factors, optimize=True)
    right = np.einsum("u,ui,uj->ij", weights, used * (1.0 + confidence), factors, optimize=True)
    ratings = weights @ used
    return np.concatenate([gram.ravel(), squares.ravel(), right.ravel(), ratings.ravel()])


def _digits(values: np.ndarray, digits: int) -> np.ndarray:
    """``values`` with so many significant digits."""
    size = np.floor(np.log10(np.abs(np.where(values == 0, 1.0, values))))
    unit = 10.0 ** (size - digits + 1)
    return np.round(values / unit) * unit


def _solve_services(sums: np.ndarray, n: int, params: AlsParams) -> np.ndarray:
    k = params.rank
    gram, squares, right, ratings = np.split(sums, np.cumsum([k * k, n * k * k, n * k]))
    a = gram.reshape(k, k) + squares.reshape(n, k, k)
    a += (params.reg_param * ratings)[:, None, None] * np.eye(k)
    b = right.reshape(n, k)
    x = np.zeros((n, k))
    known = ratings > 0  # the others have no equations but zeros
    root = np.linalg.cholesky((a[known] + a[known].transpose(0, 2, 1)) / 2)
    x[known] = solve_nonnegative(
        root.transpose(0, 2, 1), np.linalg.solve(root, b[known][:, :, None])[:, :, 0]
    )
    return x


def fit_usage_factors(
    matrix: DataFrame, cat: Catalog, params: AlsParams = AlsParams()
) -> UsageFactors:
    """The model of a usage matrix with a column for each core service."""
    return fit_columns(matrix, list(cat.core), params)


def fit_columns(matrix: DataFrame, services: list[str], params: AlsParams = AlsParams()) -> UsageFactors:
    """Alternate between users (in the tasks) and services (a few small systems), one column of counts each.

    Runs jobs: one that stores the distinct count rows, dealt evenly since their work and not
    their size matters, and one per iteration.
    """
    context = matrix.sparkSession.sparkContext
    distinct = matrix.groupBy(*services).agg(F.count("*").alias("users"))
    rows = materialize(distinct.repartition(2 * context.defaultParallelism), "usage-vectors")
    start = np.random.default_rng(params.seed).normal(size=(len(services), params.rank))
    vectors = np.abs(start) / np.linalg.norm(start, axis=1, keepdims=True)

    for _ in range(params.max_iter):

        def sums(batches: Iterator[pd.DataFrame], vectors: np.ndarray = vectors):
            total: np.ndarray | float = 0.0
            for batch in batches:
                counts = batch[services].to_numpy(dtype=float)
                factors = user_factors(counts, vectors, params)
                weights = batch["users"].to_numpy(dtype=float)
                total = total + _service_sums(counts, weights, factors, params.alpha)
            if not np.isscalar(total):
                yield pd.DataFrame({"place": range(len(total)), "value": total})

        # One row per number in the normal equations: their count depends on the
        # catalogue and the rank alone.
        parts = rows.mapInPandas(sums, "place int, value double")
        added = parts.groupBy("place").agg(F.sum("value").alias("value")).toPandas()
        ordered = added.sort_values("place")["value"].to_numpy()
        if not len(ordered):
            vectors = np.zeros_like(vectors)
            break
        vectors = _solve_services(_digits(ordered, SUM_DIGITS), len(services), params)
    return UsageFactors(tuple(services), vectors, params)


def user_factor_rows(counts: DataFrame, number: str, model: UsageFactors) -> DataFrame:
    """``id`` and ``features`` of every user, from rows of a number and the services' counts; no row moves."""
    services = list(model.services)

    def factors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            distinct, place = np.unique(batch[services].to_numpy(dtype=float), axis=0, return_inverse=True)
            found = user_factors(distinct, model.vectors, model.params)[place.ravel()]
            yield pd.DataFrame({"id": batch[number], "features": list(found)})

    return counts.select(number, *services).mapInPandas(factors, "id bigint, features array<float>")


def usage_scores(model: UsageFactors) -> Column:
    """For per-user rows with ``usage``: an array of scores that follows the services.

    NULL stands for a service that nobody has used.  The row stays where it is.
    """
    known = model.vectors.any(axis=1)

    def score(*counts: pd.Series) -> pd.Series:
        rows = np.stack([c.to_numpy(dtype=float) for c in counts], axis=1)
        distinct, place = np.unique(rows, axis=0, return_inverse=True)
        factors = user_factors(distinct, model.vectors, model.params)
        values = np.round(np.einsum("uj,ij->ui", factors, model.vectors), SCORE_DECIMALS)
        listed = [[v if k else None for v, k in zip(row, known)] for row in values.tolist()]
        return pd.Series([listed[p] for p in place.ravel()], index=counts[0].index, dtype=object)

    return F.pandas_udf(score, "array<double>")(*usage_counts(model.services))

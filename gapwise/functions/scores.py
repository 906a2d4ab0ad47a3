"""Column expressions for scores and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(score: Column) -> Column:
    """The score, or NULL when it is NaN or infinite."""
    return F.when(F.abs(score) < float("inf"), score)


def fit_percent(score: Column) -> Column:
    """Score truncated and clamped to 0..100; NULL stays NULL."""
    usable = finite(score)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), usable))
    return F.when(usable.isNotNull(), clamped.cast("int"))


def percent(part: Column, whole: Column) -> Column:
    """Whole-number percentage, half to even; NULL when ``whole`` is zero."""
    return F.bround(F.try_divide(100.0 * part, whole), 0).cast("long")


def score_text(score: Column) -> Column:
    """Score without decimals as text, half to even; empty when missing."""
    return F.coalesce(F.bround(finite(score), 0).cast("long").cast("string"), F.lit(""))

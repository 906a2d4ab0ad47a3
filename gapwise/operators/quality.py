"""Checks of the stored tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.operators.insights import user_cells


def table_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count, columns and types of each table: a row per column."""

    def profile(name: str, df: DataFrame) -> DataFrame:
        columns = F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(field.name).alias("column_name"),
                    F.lit(field.dataType.simpleString()).alias("column_type"),
                )
                for i, field in enumerate(df.schema, 1)
            ]
        )
        counted = df.agg(F.count("*").alias("row_count"))
        return counted.select(F.lit(name).alias("table_name"), "row_count", F.inline(columns))

    return reduce(DataFrame.unionByName, [profile(name, df) for name, df in tables.items()])


def null_audit(users: DataFrame) -> DataFrame:
    """NULL counts of the columns that should be filled, from the stored cells or from users."""
    cells = users if "users" in users.columns else user_cells(users)
    nulls = {
        "null_cluster": F.col("cluster_id").isNull(),
        "null_active_service": F.col("active_service").isNull(),
        "null_rec1": F.col("cross_recommend_1").isNull(),
        "null_rec1_score": F.col("null_rec1_score"),
        "null_rec2": F.col("null_rec2"),
    }
    zero = F.lit(0).cast("long")
    counted = [F.coalesce(F.sum(F.when(is_null, F.col("users"))), zero).alias(name) for name, is_null in nulls.items()]
    return cells.agg(F.coalesce(F.sum("users"), zero).alias("users"), *counted)


def preview(df: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows by key: a top-k, not a global sort."""
    return df.orderBy(*keys).limit(n)

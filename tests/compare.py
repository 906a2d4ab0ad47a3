"""Comparing a Spark result with the result of a SQL statement."""

from __future__ import annotations

import glob
import os

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        if name in TABLES:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(table: pa.Table) -> list[str]:
    names = sorted(table.column_names)
    columns = [table.column(name).to_pylist() for name in names]
    return sorted(repr(row) for row in zip(*columns))


def _types(table: pa.Table) -> dict[str, str]:
    def plain(kind: pa.DataType) -> str:
        return str(kind).replace("large_", "")

    return {field.name: plain(field.type) for field in table.schema}


def differences(actual: pa.Table, expected: pa.Table) -> list[str]:
    """What differs between two results, whatever their order of rows and columns."""
    found = []
    if _types(actual) != _types(expected):
        ours, theirs = set(_types(actual).items()), set(_types(expected).items())
        found.append(f"schema: {sorted(ours - theirs)} vs {sorted(theirs - ours)}")
    if sorted(actual.column_names) == sorted(expected.column_names):
        ours, theirs = _rows(actual), _rows(expected)
        if ours != theirs:
            only_ours = [r for r in ours if r not in set(theirs)][:2]
            only_theirs = [r for r in theirs if r not in set(ours)][:2]
            found.append(
                f"rows: {len(ours)} vs {len(theirs)}; only ours {only_ours}; only theirs {only_theirs}"
            )
    return found

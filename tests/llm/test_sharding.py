import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gapwise.llm.op1_sharding import (
    ShardParams,
    assign_shards,
    fill_table,
    hot_keys,
    moved_slots,
    place_evenly,
    read_shards,
    shard_sizes,
    slot_of,
    write_shards,
)
from gapwise.llm.queries import queries


def test_every_shard_has_its_share():
    counts = Counter(fill_table(ShardParams()))
    assert len(counts) == 32 and max(counts.values()) - min(counts.values()) <= 1


def test_few_slots_move():
    before = ShardParams()
    fewer = ShardParams(shards=before.shards[:-1])
    assert moved_slots(before, before) == 0
    assert 1 / 32 - 0.001 <= moved_slots(before, fewer) < 0.1


@pytest.mark.parametrize("params", [ShardParams(shards=()), ShardParams(slots=4000), ShardParams(shards=("a", "a"))])
def test_bad_tables_are_refused(params):
    with pytest.raises(ValueError):
        fill_table(params)


def test_odd_rows_are_all_placed(odd_docs, no_docs):
    placed = assign_shards(odd_docs, ["doc_id"])
    rows = placed.collect()
    assert len(rows) == odd_docs.count() and all(r["shard"] for r in rows)
    assert sorted(placed.columns) == sorted([*odd_docs.columns, "shard"])
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add(r["slot"])
    assert all(len(slots) == 1 for slots in by_id.values())
    assert assign_shards(no_docs, ["doc_id", "text"]).count() == 0


def test_parts_of_a_key_do_not_run_together(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "c"), ("", "c")], "x string, y string")
    slots = [r[0] for r in rows.select(slot_of([F.col("x"), F.col("y")], 1_000_003)).collect()]
    assert len(set(slots)) == 4


def test_a_hot_key_is_divided(spark):
    rows = spark.range(4000).select(F.lit("hot").alias("source"), "id")
    assert shard_sizes(assign_shards(rows, ["source"])).count() == 1
    spread = shard_sizes(assign_shards(rows, ["source"], spread=["id"], parts=256)).toPandas()
    assert spread["rows"].sum() == 4000 and len(spread) > 25 and spread["rows"].max() < 800


def test_written_shards(spark, tmp_path):
    placed = assign_shards(spark.range(500), ["id"])
    write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("id", "shard").collect())) == sorted(map(tuple, placed.select("id", "shard").collect()))


def test_plan_is_native(odd_docs):
    plan = assign_shards(odd_docs, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("hot", ["one id", "no id"])
def test_a_third_of_the_rows_under_one_key(spark, tmp_path, hot):
    """The hot key is found and divided; all other keys stay where they would be, and whole rows come back."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(F.lit(7 if hot == "one id" else None)).alias("doc_id"),
        F.concat(F.lit("text "), "id").alias("text"), F.lit("clash").alias("slot"), F.col("id").alias("__q"),
    )
    assert [tuple(r) for r in hot_keys(rows, ["doc_id"]).collect()] == [(7 if hot == "one id" else None, 43)]
    placed = place_evenly(rows, ["doc_id"], ["text"])
    write_shards(placed, str(tmp_path / "out"))
    back = read_shards(spark, str(tmp_path / "out"), placed.schema)
    assert back.columns == placed.columns and sorted(back.collect(), key=str) == sorted(placed.collect(), key=str)
    sizes = [r["rows"] for r in shard_sizes(back).collect()]
    assert sum(sizes) == 3000 and len(sizes) == 32 and max(sizes) < 300
    plain = {r["__q"]: r["slot"] for r in assign_shards(rows, ["doc_id"]).where("__q % 3 > 0 AND __q <> 7").collect()}
    found = {r["__q"]: r["slot"] for r in back.where("__q % 3 > 0 AND __q <> 7").collect()}
    assert found == plain


def test_odd_rows_are_placed_evenly(odd_docs, no_docs):
    placed = place_evenly(odd_docs, ["doc_id"], ["text"])
    assert placed.count() == odd_docs.count() and placed.where("shard IS NULL").count() == 0
    assert sorted(placed.columns) == sorted([*odd_docs.columns, "shard"])
    assert place_evenly(no_docs, ["doc_id"], ["text"]).count() == 0


def test_the_query_returns_whole_rows(spark, tiny_dir, texts):
    rows = queries()["op1_sharding"](spark, tiny_dir)
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    found = {r["doc_id"]: r["text_md5"] for r in rows.collect()}
    assert found == {i: None if t is None else hashlib.md5(t.encode()).hexdigest() for i, t in texts.items()}

"""The registered queries of the operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm import (
    op1_sharding,
    op2_warc,
    op3_lm,
    op4_order_minhash,
    op5_quality,
    op6_repair,
    op7_packing,
    op8_decontaminate,
    op9_html,
    op10_language,
    op11_repair,
    op12_sketch,
    op13_clusters,
)
from gapwise.llm.common import remainder, table
from gapwise.storage import new_path

Query = Callable[[SparkSession, str], DataFrame]

LANGUAGE_FOLDS, LANGUAGE_HELD_OUT = 4, 2
LM_FOLDS, LM_HELD_OUT = 5, 1


def q_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = remainder(F.col("doc_id"), LANGUAGE_FOLDS)
    found = op10_language.identify(docs, fold != LANGUAGE_HELD_OUT)
    return found.withColumn("held_out", fold == LANGUAGE_HELD_OUT)


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def q_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows placed by id, hot ids divided by text, written as shards and read back."""
    placed = op1_sharding.place_evenly(table(spark, sf_dir, "documents"), ["doc_id"], ["text"])
    folder = new_path(spark, "shards")
    op1_sharding.write_shards(placed, folder)
    rows = op1_sharding.read_shards(spark, folder, placed.schema)
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"), "slot", "shard")


def q_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    op2_warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return op2_warc.read_archives(spark, folder)


def q_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-shards")
    op6_repair.write_shards(table(spark, sf_dir, "documents"), folder)
    read = op6_repair.read_shards(spark, folder)
    return read.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def q_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_html.extract(table(spark, sf_dir, "pages"))


def q_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op3_lm.score_documents(docs, remainder(F.col("doc_id"), LM_FOLDS) == LM_HELD_OUT)


def q_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def q_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = op7_packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def q_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def q_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_repair.repair(op11_repair.damage(table(spark, sf_dir, "conversations"))).report


def q_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_sketch.fingerprint_edits(table(spark, sf_dir, "documents"))


def q_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = op13_clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))
    sums = centroids.select("cluster", "cluster_inertia", "inertia", "centroid_sha256")
    return assigned.join(F.broadcast(sums), "cluster")  # a row per centroid


QUERIES: dict[str, Query] = {
    "op1_sharding": q_sharding,
    "op2_warc": q_warc,
    "op3_lm_scores": q_language_model,
    "op4_near_duplicates": q_near_duplicates,
    "op5_quality_rules": q_quality,
    "op6_token_shards": q_token_shards,
    "op7_packing": q_packing,
    "op8_decontamination": q_decontamination,
    "op9_html_text": q_html,
    "op10_language_id": q_language,
    "op11_conversation_repair": q_repair,
    "op12_fingerprints": q_fingerprints,
    "op13_clusters": q_clusters,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": op1_sharding.oracle(),
        "op8_decontamination": op8_decontaminate.oracle(),
        "op11_conversation_repair": op11_repair.oracle(),
        "op13_clusters": op13_clusters.oracle(),
    }

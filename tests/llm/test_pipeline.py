import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gapwise.llm import op4_order_minhash, op5_quality, op8_decontaminate, op10_language
from gapwise.llm.common import remainder
from gapwise.llm.tokens import encoder


@pytest.fixture(scope="module")
def stages(spark, tiny_docs, tiny_dir, tmp_path_factory):
    """What each stage got and gave."""
    found, docs = [], tiny_docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, tiny_dir).write.parquet(path)
        found.append((name, docs, spark.read.parquet(path)))
        docs = found[-1][2]
    return {name: (before, after) for name, before, after in found}


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "decontamination", "packing"]


def test_all_but_the_last_keep_the_columns(stages, tiny_docs):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.schema.simpleString() == tiny_docs.schema.simpleString()
            assert after.exceptAll(before).count() == 0


def test_every_decision_takes_effect(spark, stages, tiny_dir):
    before, after = stages["language_id"]
    verdict = op10_language.identify(before, remainder(F.col("doc_id"), 4) != 2)
    assert ids(after) == ids(verdict.where("not rejected"))
    before, after = stages["quality_rules"]
    assert ids(after) == ids(op5_quality.judge(before, spark.read.parquet(f"{tiny_dir}/labels.parquet")).where("kept")) < ids(before)
    before, after = stages["near_dedup"]
    assert ids(after) == ids(op4_order_minhash.near_duplicates(before).where("kept")) < ids(before)
    before, after = stages["decontamination"]
    found = op8_decontaminate.contaminated(before, spark.read.parquet(f"{tiny_dir}/benchmark.parquet"))
    assert ids(after) == ids(before) - ids(found) < ids(before)


def test_all_that_is_left_is_packed(stages):
    before, after = stages["packing"]
    lengths = {r["doc_id"]: len(encoder().ids(r["text"], 1)) for r in before.collect()}
    packed = {r["doc_id"]: r["n"] for r in after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert packed == lengths


def test_run_is_the_stages(spark, stages, tiny_dir):
    rows = corpus_pipeline.run(spark, tiny_dir)
    assert rows.agg(F.sum("length")).first() == stages["packing"][1].agg(F.sum("length")).first()
    assert ids(rows) == ids(stages["packing"][1])


def test_odd_documents_pass_every_stage(spark, odd_docs, no_docs, tiny_dir):
    """Which of the odd rows each stage keeps, taken alone."""

    def kept(at, docs=odd_docs):
        return corpus_pipeline.STAGES[at][1](spark, docs, tiny_dir)

    def rows(df):
        return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in df.select("doc_id", "text").collect())

    letters = odd_docs.where("text rlike '[a-zA-Z]'")
    assert set(rows(kept(0))) <= set(rows(letters))
    assert all(len(text.split()) >= 20 for *_, text in rows(kept(1)))
    one = kept(2)
    texts_before, texts_after = ({r["text"] or "" for r in df.select("text").collect()} for df in (odd_docs, one))
    assert texts_after == texts_before and one.count() == len(texts_before)
    assert rows(kept(3)) == rows(odd_docs)
    packed = kept(4)
    ids = sum(len(encoder().ids(r["text"], 1)) for r in odd_docs.select("text").collect())
    assert packed.agg(F.sum("length")).first()[0] == ids
    for at in range(5):
        assert kept(at, no_docs).count() == 0
        assert at == 4 or kept(at).columns == odd_docs.columns

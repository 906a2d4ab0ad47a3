import pytest
from pyspark.sql import functions as F

from gapwise.llm import op10_language as language
from gapwise.llm.common import remainder
from gapwise.llm.queries import queries


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    found = queries()["op10_language_id"](spark, sf_dir)
    held = found.where("held_out").join(docs, "doc_id").toPandas()
    assert len(held) > 200
    assert (held.lang == held.lang_pred).mean() > 0.97
    clear = held[held.n > 200]
    assert (clear.lang == clear.lang_pred).mean() > 0.99 and clear.rejected.mean() < 0.01
    assert held.score.between(0, 1).all()


def test_one_row_per_document(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = queries()["op10_language_id"](spark, sf_dir)
    assert found.count() == docs.count() == found.select("doc_id").distinct().count()


def test_language_of_held_out_rows_is_not_looked_at(spark, tiny_docs):
    train = remainder(F.col("doc_id"), 4) != 2
    wrong = tiny_docs.withColumn("lang", F.when(train, F.col("lang")).otherwise("xx"))
    assert "xx" not in language.fit_dictionaries(wrong, train)
    assert language.fit_dictionaries(wrong, train) == language.fit_dictionaries(tiny_docs, train)


def test_odd_rows(odd_docs, no_docs, tiny_docs):
    found = {(r["doc_id"], r["lang_pred"], r["rejected"]) for r in language.identify(odd_docs, F.lit(True)).collect()}
    assert {(2, "und", True), (3, "und", True), (4, "und", True), (5, "de", False)} <= found
    kept = language.keep_identified(odd_docs, F.lit(True))
    assert kept.columns == odd_docs.columns and kept.where("text is null").count() == 0
    assert language.identify(no_docs, F.lit(True)).count() == 0
    assert language.fit_dictionaries(no_docs, F.lit(True)) == {}
    unlabelled = language.identify(tiny_docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert [r[0] for r in unlabelled.select("lang_pred").distinct().collect()] == ["und"]


def test_ties_and_single_languages():
    params = language.LanguageParams()
    both = language.Encoder({"b": b"some raw content here", "a": b"some raw content here"}, params)
    assert both.classify("some raw content") == ("a", 0.5, 0.0, True)
    one = language.Encoder({"a": b"some raw content here"}, params)
    assert one.classify("any text")[0] == "a" and not one.classify("any text")[3]
    assert one.classify("123 ... !") == ("und", 0.0, 0.0, True)


@pytest.mark.parametrize("text,plain", [("A-b2C", "a b c"), ("  Été_x ", "été x"), ("1 2", "")])
def test_letters(text, plain):
    assert language.letters(text) == plain

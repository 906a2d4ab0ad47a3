import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gapwise.llm import op5_quality as quality
from gapwise.llm.common import keep_table
from gapwise.llm.queries import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 8))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_query_matches_brute_force(spark, tiny_dir, texts):
    found = queries()["op5_quality_rules"](spark, tiny_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        want = measures(texts[r["doc_id"]])
        assert tuple(r[m] for m in quality.MEASURES) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


ODD = ["a b c d e f g h " * 3, "x " * 30, "one\n\none\r\n one\none", "   ", "a\x0bb\x0cc", "|| a &&\n||", "a b c d e f g h i a b c d e f g h"]


@pytest.mark.parametrize("text", ODD)
def test_measures(spark, text):
    row = quality.measure(spark.createDataFrame([(text,)], "text string")).select("__m.*").first()
    assert tuple(row[m] for m in quality.MEASURES) == measures(text)


def labelled(spark, rows):
    """rows: (text, quality) as documents and labels."""
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    return docs, spark.createDataFrame([(i, q, 0) for i, (_, q) in enumerate(rows)], "doc_id bigint, quality int, toxic int")


def clean(i):
    return " ".join(f"w{(i * 31 + j * 7) % 997}q" for j in range(40 + i % 20))


def test_a_rule_is_found_and_explained(spark):
    rows = [(clean(i), 1) for i in range(300)]
    rows += [(" ".join(w + "###" for w in clean(i).split()), 0) for i in range(60)]
    docs, labels = labelled(spark, rows)
    stored, _ = keep_table(quality.measure(docs).select("doc_id", "__m.*"), "m")
    rules = quality.learn_rules(stored, labels)
    assert len(rules) == 1 and len(rules[0].conditions) == 1
    found = quality.judge(docs, labels).collect()
    assert all(r["kept"] == (r["doc_id"] < 300) for r in found)


def test_a_conjunction_is_found(spark):
    """Low quality only if long words meet symbols: neither alone tells."""
    def make(i, long, marks):
        words = [w + ("longer" if long else "") + ("#" if marks else "") for w in clean(i).split()]
        return " ".join(words)

    rows = [(make(i, long, marks), 0 if long and marks else 1) for i in range(90) for long in (0, 1) for marks in (0, 1)]
    docs, labels = labelled(spark, rows)
    stored, _ = keep_table(quality.measure(docs).select("doc_id", "__m.*"), "m")
    rules = quality.learn_rules(stored, labels)
    assert {c.feature for r in rules for c in r.conditions} >= {"symbol_rate", "mean_word"} or str(rules[0]).startswith("mean_word >")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}
    assert all(kept[i] == (q == 1) for i, (_, q) in enumerate(rows))


def test_noise_gives_no_rule(spark):
    docs, labels = labelled(spark, [(clean(i), int(i % 7 > 0)) for i in range(400)])
    found = quality.judge(docs, labels)
    assert found.where("not kept").count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 0, 0), (5, None, 1)], "doc_id bigint, quality int, toxic int")
    found = quality.judge(odd_docs, labels)
    assert found.count() == odd_docs.count()
    assert found.where("doc_id in (2, 3, 4) and not (base_failed and n_words = 0)").count() == 0
    kept = quality.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} <= {1, 5}
    assert quality.judge(no_docs, labels).count() == 0 and quality.keep_good(no_docs, labels).count() == 0
    assert quality.judge(odd_docs, labels.limit(0)).where("kept").count() == quality.judge(odd_docs, labels).where("not base_failed").count()


def test_the_list_is_one_native_expression(tiny_docs):
    rules = [quality.Rule((quality.Condition("n_words", True, 5.0), quality.Condition("symbol_rate", False, 0.5)))]
    row = tiny_docs.select(F.lit(9).alias("n_words"), F.lit(0.1).alias("symbol_rate")).select(quality.verdict(rules)).first()
    assert row[0] == 0 and str(rules[0]) == "n_words > 5 and symbol_rate <= 0.5"
    plan = quality.measure(tiny_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan

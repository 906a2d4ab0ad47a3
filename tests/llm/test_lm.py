import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwise.llm import op3_lm as lm
from gapwise.llm.gru import Model, Shape, Trainer
from gapwise.llm.queries import queries

SHAPE = Shape(hidden=5, bounds=(0, 1, 2, 5, 9), tails=3)


def random_model(seed=1):
    rng = np.random.default_rng(seed)
    return Model(SHAPE, rng.normal(0, 0.5, SHAPE.size()).astype(np.float32))


def test_probabilities_add_up_to_one():
    model = random_model()
    state = np.random.default_rng(2).normal(0, 1, (1, 5)).astype(np.float32)
    every = np.arange(SHAPE.symbols)
    total = np.exp(model.log_probability(np.repeat(state, len(every), 0), every)).sum()
    assert total == pytest.approx(1, abs=1e-5)


def test_scores_side_by_side_are_those_one_by_one():
    model, rng = random_model(), np.random.default_rng(3)
    documents = [rng.integers(0, SHAPE.symbols, n).astype(np.int32) for n in (1, 200, 7, 64, 65, 0, 7, 130)]
    together = model.score(documents, 0)
    for document, found in zip(documents, together):
        h, before, want = np.zeros((1, 5), np.float32), 0, 0.0
        for symbol in document:
            h = model.step(np.array([before]), h)[0]
            want += model.log_probability(h, np.array([symbol]))[0]
            before = symbol
        assert found == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_gradients_are_right():
    """Against differences of the loss, in the directions of single parameters of every kind."""
    rng = np.random.default_rng(4)
    flat = rng.normal(0, 0.5, SHAPE.size()).astype(np.float32)
    text = rng.integers(0, SHAPE.symbols, 2 * 6 + 1).astype(np.int32)
    inputs, targets = text[:-1].reshape(2, 6), text[1:].reshape(2, 6)

    def loss(values):
        model, total = Model(SHAPE, values), 0.0
        h = np.zeros((2, 5), np.float32)
        for t in range(6):
            h = model.step(inputs[:, t], h * (inputs[:, t] != 0)[:, None])[0]
            total -= model.log_probability(h, targets[:, t]).sum()
        return total / 12

    trainer, caught = Trainer(SHAPE, flat, 0.0, 2, 6), {}
    trainer._update = lambda gradient, tokens: caught.update(g=gradient / tokens)
    trainer._window(inputs, targets, np.zeros((2, 5), np.float32), 0)
    at = 0
    for name, shape in SHAPE.parts().items():
        size = int(np.prod(shape))
        places = at + np.argsort(-np.abs(caught["g"][at : at + size]))[:4]
        for place in places:
            up, down = flat.copy(), flat.copy()
            up[place] += 0.01
            down[place] -= 0.01
            assert caught["g"][place] == pytest.approx((loss(up) - loss(down)) / 0.02, rel=0.03, abs=2e-4), name
        at += size


@pytest.mark.parametrize("n", [7, 40, 43, 80, 87, 161, 1003])
def test_every_symbol_is_learned_from(n):
    rng = np.random.default_rng(5)
    text = rng.integers(0, SHAPE.symbols, n + 1).astype(np.int32)
    trainer, seen, steps = Trainer(SHAPE, SHAPE.start(np.ones(SHAPE.symbols), 1), 0.0, 8, 10), [], []
    output = trainer._output
    trainer._output = lambda states, targets, g: (seen.extend(targets.tolist()), output(states, targets, g))[1]
    trainer._update = lambda gradient, tokens: steps.append(tokens)
    trainer.feed(text, 0)
    assert Counter(seen) == Counter(text[1:].tolist())
    assert sum(steps) == trainer.tokens == n


def test_lanes_of_unequal_length_have_the_gradients_of_each_alone():
    rng = np.random.default_rng(6)
    flat = rng.normal(0, 0.5, SHAPE.size()).astype(np.float32)
    text = rng.integers(0, SHAPE.symbols, 14).astype(np.int32)  # a lane of seven and one of six

    def gradient(inputs, targets, rows=None):
        trainer, caught = Trainer(SHAPE, flat, 0.0, 2, 6), []
        trainer._update = lambda g, tokens: caught.append(g.copy())
        trainer._window(inputs, targets, np.zeros((len(inputs), 5), np.float32), 0, rows)
        return caught[0]

    both = gradient(*(Trainer._lanes(x, 2, 0) for x in (text[:-1], text[1:])), 1)
    alone = gradient(text[None, :7], text[None, 1:8]) + gradient(text[None, 7:13], text[None, 8:14])
    assert both == pytest.approx(alone, rel=1e-3, abs=1e-4)


def test_training_learns_an_order():
    text = np.tile(np.array([1, 4, 7, 2, 0], np.int32), 400)
    flat = SHAPE.start(np.ones(SHAPE.symbols), 1)
    trainer = Trainer(SHAPE, flat, 0.02, 8, 10)
    for _ in range(25):
        trainer.feed(np.concatenate(([0], text)).astype(np.int32), 0)
    before, after = (Model(SHAPE, x).score([text[:5]], 0)[0] for x in (flat, trainer.model.flat))
    assert after > before / 10


def brute(rows, folds=5, held=1):
    tokens = {k: [*((t or "").encode().lower().split()), b""] for k, (_, t) in enumerate(rows)}
    out = {k: i is not None and zlib.crc32(str(i).encode()) % folds == held for k, (i, _) in enumerate(rows)}
    counts = Counter(w for k, ws in tokens.items() if not out[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    found = []
    for k, (i, _) in enumerate(rows):
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[k])
        found.append((i, out[k], len(tokens[k]), sum(counts[w] > 0 for w in tokens[k]), n, base))
    return found


def key(row):
    return (row[0] is None, row[0] or 0, row[2], row[5])


def compare(found, want):
    rows = sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found], key=key)
    want = sorted(want, key=key)
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    assert np.allclose([r[5] for r in rows], [w[5] for w in want], rtol=1e-9)


def test_query_matches_brute_force_and_beats_it(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = queries()["op3_lm_scores"](spark, sf_dir).collect()
    compare(found, brute([(r["doc_id"], r["text"]) for r in docs]))
    held = [r for r in found if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain > 0.1 and np.mean([r["score"] > r["base_score"] for r in held]) > 0.9


SMALL = lm.LmParams(head_words=60, head_classes=8, tail_classes=4, hidden=6, warm_tokens=3000, lanes=8)


def test_joined_words_score_like_looked_up_ones(spark, tiny_docs):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    docs = tiny_docs.where("doc_id < 60")
    counts = lm._count_words(docs.where(~held))
    few = lm.fit_vocabulary(counts, lm.LmParams(**{**SMALL.__dict__, "lookup_words": 400}))
    many = lm.fit_vocabulary(counts, SMALL)
    assert len(few.words) <= 401 < len(many.words) and few.words[:60] == many.words[:60]
    assert np.allclose(few.mass, many.mass) and few.shape() == many.shape()
    one = lm.score_documents(docs, held, lm.LmParams(**{**SMALL.__dict__, "lookup_words": 400})).toPandas().set_index("doc_id")
    two = lm.score_documents(docs, held, SMALL).toPandas().set_index("doc_id")
    assert np.allclose(one.base_score, two.base_score[one.index]) and (one.n_known == two.n_known[one.index]).all()
    assert np.allclose(one.score, two.score[one.index], rtol=1e-3)


def test_tail_classes_agree(spark):
    words = [b"a", b"ab", b"abc.", "été,".encode(), "ß".encode(), b"...", b"word!?", b"x" * 50]
    rows = spark.createDataFrame([(bytearray(w),) for w in words], "word binary").select("word", lm._tail_class("word", 24).alias("t"))
    assert all(lm.tail_class(bytes(r["word"]), 24) == r["t"] for r in rows.collect())


def test_shares_of_a_tail_class_add_up(spark, tiny_docs):
    vocabulary = lm.fit_vocabulary(lm._count_words(tiny_docs), SMALL)
    mass = np.array(vocabulary.unknown)
    for w, c in zip(vocabulary.words[vocabulary.head :], vocabulary.counts[vocabulary.head :]):
        mass[lm.tail_class(w, 4)] += c
    assert np.allclose(mass, vocabulary.mass)


def test_odd_rows(odd_docs, no_docs):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = lm.score_documents(odd_docs, held, SMALL).collect()
    compare(found, brute(rows))
    assert all(math.isfinite(r["score"]) for r in found)
    assert lm.score_documents(no_docs, held, SMALL).count() == 0
    untrained = lm.score_documents(odd_docs, F.lit(True), SMALL).collect()
    assert len(untrained) == len(rows) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in untrained)

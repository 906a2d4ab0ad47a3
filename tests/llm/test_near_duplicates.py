import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gapwise.llm import op4_order_minhash as omh
from gapwise.llm.queries import queries

PARAMS = omh.OrderMinHashParams()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40), st.sampled_from([0.5, 0.8, 0.9]))
def test_similar_is_the_edit_distance(a, b, similarity):
    longer = max(len(a), len(b))
    want = edits(a, b) <= int(longer * (1 - similarity) + 1e-9)
    assert omh.similar(np.array(a, np.uint64), np.array(b, np.uint64), similarity) == want


def test_similar_on_long_texts():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 500, 3000).astype(np.uint64)
    kept = rng.random(3000) > 0.08
    b = np.insert(a[kept], rng.integers(0, kept.sum(), 200), rng.integers(500, 900, 200).astype(np.uint64))
    assert omh.similar(a, b, 0.8) and not omh.similar(a, b, 0.95)
    assert not omh.similar(a, np.sort(a), 0.8)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30), st.integers(0, 30))
def test_both_alignments_are_exact(a, b, limit):
    x, y, want = np.array(a, np.uint64), np.array(b, np.uint64), edits(a, b)
    for found in (omh._edits(x, y, limit), omh._by_rows(x, y, limit, 1)):
        assert found == want if want <= limit else found > limit


def test_wide_bands_go_by_rows(monkeypatch):
    monkeypatch.setattr(omh, "_CELLS", 5000)
    rng = np.random.default_rng(6)
    a = rng.integers(0, 50, 300).astype(np.uint64)
    b = np.delete(a, rng.integers(0, 300, 50))
    assert omh._edits(a, b, 60) == 300 - len(b) == edits(a.tolist(), b.tolist())


def test_sketches_keep_the_order():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    text, swapped = " ".join(words), " ".join(words[200:] + words[:200])
    for i in rng.sample(range(400), 6):
        words[i] = "other"
    one, near, far = (omh.sketch(omh.word_hashes(t), PARAMS) for t in (text, " ".join(words), swapped))
    near_hits, far_hits = (sum(x == y for x, y in zip(one, s)) for s in (near, far))
    assert near_hits > 8 and near_hits > far_hits
    assert omh.sketch(omh.word_hashes("A  b\nC d e"), PARAMS) == omh.sketch(omh.word_hashes("a b c d e"), PARAMS)


def test_repeated_kmers_are_told_apart():
    kmers = omh.labelled_kmers(omh.word_hashes("x " * 50), 5)
    assert len(kmers) == 46 == len(set(kmers.tolist()))
    one = omh.labelled_kmers(omh.word_hashes("a b c d e f g"), 5)
    two = omh.labelled_kmers(omh.word_hashes("a b c d e f g a b c d e f g"), 5)
    assert set(one.tolist()) <= set(two.tolist()) and len(set(two.tolist())) == 10


def union_find(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    edges += [(1000 + i, 1001 + i) for i in range(40)]  # a chain
    edges += [(2000 + i, 5000) for i in range(100)]  # a star round its greatest node
    edges = [(a, b) for a, b in edges if a != b]
    found = omh.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    nodes = {n for e in edges for n in e}
    assert {r["node"]: r["label"] for r in found.collect()} == union_find(nodes, edges)


def brute_classes(texts):
    """Connected components of all pairs whose edit similarity reaches the threshold."""
    words = {i: omh.word_hashes(t) for i, t in texts.items()}
    ids = sorted(texts)
    edges = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if omh.similar(words[a], words[b], PARAMS.similarity)]
    return union_find(ids, edges)


def test_query_matches_all_pairs(spark, tiny_dir, texts):
    found = {r["doc_id"]: r["class_id"] for r in queries()["op4_near_duplicates"](spark, tiny_dir).collect()}
    assert found == brute_classes(texts)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(120), 3):
            words[at] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[0][1]) for i in range(300)]
    rows += [(5000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for i in range(50)]
    found = omh.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["class_id"] for r in found if r["doc_id"] < 5000} == {0}
    assert all(r["class_id"] == r["doc_id"] and r["kept"] for r in found if r["doc_id"] >= 5000)
    assert sum(r["kept"] for r in found) == 51


@pytest.mark.parametrize("block", [50, omh._BLOCK])
def test_similar_members_of_a_bucket_are_in_one_class(spark, monkeypatch, block):
    """Many texts share a passage and lead its buckets; near copies among them, also in a large group."""
    monkeypatch.setattr(omh, "_BLOCK", block)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]

    def own(n=60):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    def edited(words, times):
        words = list(words)
        for at in rng.sample(range(len(words)), times):
            words[at] = f"new{rng.randrange(10**6)}"
        return words

    full = [passage + own() for _ in range(300)]
    full += [edited(w, 18) for w in full[:100]]
    full += [edited(full[200], 8) for _ in range(40)]
    params = omh.OrderMinHashParams(k=5, picked=2, sketches=24)
    texts = {i: " ".join(w) for i, w in enumerate(full)}
    words = {i: omh.word_hashes(t) for i, t in texts.items()}
    slots = {i: set(omh.sketch(w, params)) for i, w in words.items()}
    edges = [
        (a, b)
        for a in texts
        for b in range(a + 1, len(texts))
        if slots[a] & slots[b] and omh.similar(words[a], words[b], params.similarity)
    ]
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r["doc_id"]: r["class_id"] for r in omh.near_duplicates(rows, params).collect()}
    assert found == union_find(list(texts), edges)


def test_nothing_similar_is_left_out_before_verification():
    rng = np.random.default_rng(7)
    texts = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (5, 60, 60, 400)]
    texts.append(np.full(3000, 7, np.uint64))  # a bin that is full
    for t in list(texts):
        for _ in range(10):
            kept = np.flatnonzero(rng.random(len(t)) > 0.12)
            texts.append(np.insert(t[kept], len(kept) // 2, rng.integers(0, 2**63, len(t) // 20).astype(np.uint64)))
    names = [bytes([i]) * 16 for i in range(len(texts))]
    rows = [
        {"block": 0, "digest": d, "label": d, "words": len(t), "counts": omh.word_counts(t)} for d, t in zip(names, texts)
    ]
    whole, cut = omh._near(pa.array(rows), False, 0.8, 1000)
    want = {
        (names[a], names[b]) for a in range(len(texts)) for b in range(a) if omh.similar(texts[a], texts[b], 0.8)
    }
    assert want <= set(whole) and not cut
    some, cut = omh._near(pa.array(rows), False, 0.8, 2)
    assert cut and set(some) < set(whole)


def edited_pair(rng, length, times):
    a = [rng.randrange(10**9) for _ in range(length)]
    b = list(a)
    for at in rng.sample(range(length), times):
        b[at] = rng.randrange(10**9)
    return np.array(a, np.uint64), np.array(b, np.uint64)


def meet(a, b):
    a, b = (omh._mix(x) for x in (a, b))
    return bool(set(omh.sketch(a, PARAMS)) & set(omh.sketch(b, PARAMS)))


@pytest.mark.parametrize("length, times, least", [(200, 40, 0.95), (200, 30, 0.98), (200, 20, 0.99), (40, 8, 0.95), (20, 4, 0.9)])
def test_pairs_at_the_threshold_meet(length, times, least):
    rng = random.Random(8)
    assert sum(meet(*edited_pair(rng, length, times)) for _ in range(300)) >= 300 * least


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=14), st.lists(st.integers(0, 3), min_size=1, max_size=14))
def test_short_similar_texts_always_meet(a, b):
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    assert meet(x, y) or not omh.similar(x, y, PARAMS.similarity)
    for times in range(int(len(a) * 0.2 + 1e-9) + 1):
        near = list(a)
        near[:times] = [9] * times
        assert meet(x, np.array(near, np.uint64))


def test_odd_rows(odd_docs, no_docs):
    found = omh.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append((r["class_id"], r["class_size"], r["kept"]))
    assert by_id[2] == [(2, 3, True)] and by_id[3] == [(2, 3, False)]  # null counts as empty
    assert sorted(by_id[1]) == [(1, 1, True), (1, 2, True), (1, 2, True)]
    assert sorted(by_id[None], key=str) == sorted([(2, 3, False), (None, 2, True), (None, 2, True)], key=str)
    kept = omh.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 8
    assert omh.near_duplicates(no_docs).count() == 0 and omh.keep_one(no_docs).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=40))
def test_alignment_by_bits_is_exact(a, b):
    assert omh._by_bits(np.array(a, np.uint64), np.array(b, np.uint64)) == edits(a, b)


def test_long_texts_of_other_words_are_ruled_out_before_verification():
    """Three words of ten differ, but in 128 bins their counts look alike; as many bins as words tell them apart."""
    rng = np.random.default_rng(9)
    passage = omh._mix(rng.integers(0, 2**62, 560).astype(np.uint64))
    texts = [np.concatenate([passage, omh._mix(rng.integers(0, 2**62, 240).astype(np.uint64))]) for _ in range(40)]
    near = texts[0].copy()
    near[:100] = omh._mix(np.arange(1, 101).astype(np.uint64))
    texts += [near, near[:600]]
    names = [bytes([i]) * 16 for i in range(len(texts))]
    rows = [{"block": 0, "digest": d, "label": d, "words": len(t), "counts": omh.word_counts(t)} for d, t in zip(names, texts)]
    found, cut = omh._near(pa.array(rows), False, 0.8, 1000)
    want = {(names[a], names[b]) for a in range(len(texts)) for b in range(a) if omh.similar(texts[a], texts[b], 0.8)}
    assert want <= set(found) and not cut
    assert len(found) <= 60  # 820 with 128 bins


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=3000), st.integers(0, 3))
def test_counts_of_a_long_text_fold_into_those_of_few_bins(words, doublings):
    words = np.array(words, np.uint64) * np.uint64(257)
    counts = np.frombuffer(omh.word_counts(words), np.uint8)[None]
    bins = max(omh._BINS, counts.shape[1] >> doublings)
    plain = np.minimum(np.bincount((words % np.uint64(bins)).astype(np.int64), minlength=bins), 255)
    assert (omh._folded(counts, bins)[0] == plain).all()


def test_further_edges_join_the_classes_they_connect(spark):
    def named(pairs):
        return spark.createDataFrame([(x.encode(), y.encode()) for x, y in pairs], "a binary, b binary")

    first, more = [("b", "a"), ("d", "c"), ("f", "e")], [("d", "b"), ("g", "f"), ("i", "h"), ("b", "a")]
    found, _ = omh._joined(omh.components(named(first)), named(more))
    want = omh.components(named(first + more))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in want.collect()}

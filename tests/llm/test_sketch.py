import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gapwise.llm import op12_sketch as op
from gapwise.llm.queries import queries

MAKER = op.Sketcher()


def windows(text):
    """The windows themselves, as tuples of words."""
    words = text.lower().encode().split()
    padded = [None] * 4 + words
    return {tuple(padded[i : i + 5]) for i in range(len(words))}


def likeness(a, b):
    a, b = windows(a), windows(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(seed, n):
    made = random.Random(seed)
    return " ".join(f"w{made.randrange(3000)}" for _ in range(n))


TEXTS = st.lists(st.sampled_from(["a", "b", "C", "c", "é", " ", "\n"]), max_size=30).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(TEXTS, TEXTS)
def test_short_texts_are_compared_exactly(a, b):
    one, two = MAKER.sketch(a), MAKER.sketch(b)
    assert one.likeness(two) == likeness(a, b)
    assert one.contained(two) == (len(windows(a) & windows(b)) / len(windows(a)) if windows(a) else 1.0)
    assert str(op.parse(str(one))) == str(one)
    assert op.parse(str(one)).likeness(op.parse(str(two))) == one.likeness(two)


def test_every_hash_below_the_threshold_is_kept():
    text = prose(1, 5000)
    hashes = MAKER.shingles(text)
    assert len(hashes) == len(windows(text))
    sketch = MAKER.sketch(text)
    assert sketch.rest is None and sketch.low.tolist() == [h for h in hashes.tolist() if h < (1 << 48) // 8]
    assert 0.1 < len(sketch.low) / len(hashes) < 0.15


def test_merged_sketches_are_the_sketch_of_both():
    a, b = prose(1, 900), prose(2, 40)
    for x, y in ((a, b), (b, prose(3, 10)), (b, a)):
        union = MAKER.shingles(x), MAKER.shingles(y)
        merged = MAKER.sketch(x).merge(MAKER.sketch(y))
        distinct = sorted(set(union[0].tolist()) | set(union[1].tolist()))
        assert merged.low.tolist() == [h for h in distinct if h < (1 << 48) // 8]
        assert (merged.rest is None) == (len(distinct) > 64)
        assert MAKER.sketch(y).contained(merged) == 1.0


def test_containment_between_very_unequal_texts():
    errors = []
    for seed in range(40):
        long, other = prose(seed, 20_000), prose(1000 + seed, 300)
        words = long.split()
        excerpt = " ".join(words[5000:5600]) + " " + other
        truth = len(windows(excerpt) & windows(long)) / len(windows(excerpt))
        errors.append(abs(MAKER.sketch(excerpt).contained(MAKER.sketch(long)) - truth))
        assert MAKER.sketch(excerpt).likeness(MAKER.sketch(long)) < 0.1
    assert sum(errors) / len(errors) < 0.05


def test_estimates_of_long_texts():
    errors = []
    for seed in range(60):
        a = prose(seed, 800)
        b = " ".join(a.split()[: 800 - 10 * (seed % 40)]) + " " + prose(500 + seed, 10 * (seed % 40))
        errors.append(MAKER.sketch(a).likeness(MAKER.sketch(b)) - likeness(a, b))
    assert abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < 0.25


def expected(rows):
    """rows of (doc_id, text) in order -> what exact comparison says of each."""
    found = []
    for at, (doc_id, text) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        digest = hashlib.sha256(changed.encode()).hexdigest()
        prints = str(MAKER.sketch(text)), str(MAKER.sketch(changed))
        near = op.parse(prints[0]).likeness(op.parse(prints[1])), MAKER.sketch(text).likeness(MAKER.sketch(after))
        found.append((doc_id, len(text), digest, *prints, *near))
    return found


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def told(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


@pytest.mark.parametrize("partitions", [1, 8, 60])
def test_query_against_brute_force(spark, tiny_dir, texts, partitions):
    """In one range and in more of them, however few rows each has."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = queries()["op12_fingerprints"](spark, tiny_dir)
        found = told(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(found) == sorted(expected([(i, texts[i] or "") for i in sorted(texts)]))
    short = [r for r in found if len(windows(texts[r[0]] or "")) <= 64]
    for doc_id, *_, near_edited, near_next in short:
        text, after = texts[doc_id] or "", texts[(doc_id + 1) % len(texts)] or ""
        changed = op.edited(text, after, 4)
        assert len(windows(changed)) > 64 or near_edited == likeness(text, changed)
        assert len(windows(after)) > 64 or near_next == likeness(text, after)


def test_odd_documents(spark, odd_docs, no_docs):
    found = told(op.fingerprint_edits(odd_docs))
    rows = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    assert sorted(map(str, ((r[0], r[1]) for r in found))) == sorted(str((i, len(t))) for i, t in rows)
    for doc_id, n, _, own, *_ in found:
        assert own in {str(MAKER.sketch(t)) for i, t in rows if i == doc_id and len(t) == n}
    by_text = {}
    for doc_id, text in rows:
        by_text.setdefault(text, set()).add(str(MAKER.sketch(text)))
    assert all(len(prints) == 1 for prints in by_text.values())
    assert op.fingerprint_edits(no_docs).count() == 0


def test_neighbours_of_repeated_and_missing_ids(spark):
    """Equal rows follow each other, and the greatest id is followed by the least, which is a missing one."""
    rows = [(None, "none one two"), (3, "c d e f g h i j"), (3, "c d e f g h i j"), (9, "x y z u v w q r")]
    found = {(r[0], r[2]): r for r in told(op.fingerprint_edits(spark.createDataFrame(rows, "doc_id bigint, text string")))}
    last = op.edited(rows[3][1], rows[0][1], 4)
    assert (9, hashlib.sha256(last.encode()).hexdigest()) in found
    own = hashlib.sha256(op.edited(rows[1][1], rows[2][1], 4).encode()).hexdigest()
    assert found[3, own][6] == 1.0


def test_a_single_document_follows_itself(spark):
    row = told(op.fingerprint_edits(spark.createDataFrame([(1, "abcd efgh")], "doc_id bigint, text string")))[0]
    assert row[1:3] == (9, hashlib.sha256(b"abcd efab").hexdigest()) and row[6] == 1.0

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gapwise.llm import op7_packing as packing
from gapwise.llm.queries import queries
from gapwise.llm.tokens import encoder

TIERS = packing.PackingParams().tiers


def check(pieces, lengths):
    """pieces: (sequence, offset, document, start, length).  Every id once, sequences without gaps; returns their sizes."""
    by_doc, by_sequence = {}, {}
    for sequence, offset, doc, start, length in pieces:
        by_doc.setdefault(doc, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length))
    for doc, total in lengths.items():
        at = 0
        for start, length in sorted(by_doc[doc]):
            assert start == at and length > 0
            at += length
        assert at == total
    sizes = {}
    for sequence, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes[sequence] = at
    return sizes


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=30))
def test_windows_are_full(lengths):
    pieces = [p for doc, n in enumerate(lengths) for p in packing.cut_document(doc, n, TIERS[-1])]
    windows, rest = packing.pack(pieces, TIERS)
    assert all(sum(p.length for p in w) in TIERS for w in windows)
    assert sum(p.length for p in rest) < TIERS[-1]
    last = packing.pack_rest(rest)
    assert all(bin(sum(p.length for p in w)).count("1") == 1 for w in last)
    found = []
    for number, window in enumerate(windows + last):
        offset = 0
        for p in window:
            found.append((number, offset, p.doc, p.start, p.length))
            offset += p.length
    check(found, dict(enumerate(lengths)))


def test_short_documents_are_not_cut_to_fill_a_gap():
    lengths = [1500, 548, 700, 324, 200, 56]
    windows, rest = packing.pack([packing.Piece(i, 0, n) for i, n in enumerate(lengths)], TIERS)
    assert rest == [] and sorted(sorted(p.length for p in w) for w in windows) == [[56, 200], [324, 700], [548, 1500]]


def test_step_groups_are_balanced():
    sizes = [2048] * 40 + [1024] * 31 + [512] * 17 + [256] * 9
    groups = packing.step_groups(sizes, 16 * 1024)
    tokens = np.bincount(groups, sizes)
    assert tokens.max() - tokens.min() <= 256 and len(tokens) == round(sum(sizes) / (16 * 1024))


def test_query(spark, tiny_dir, texts):
    ids = {i: encoder().ids(t, 1) for i, t in texts.items()}
    rows = queries()["op7_packing"](spark, tiny_dir).collect()
    sizes = check([(r["sequence_id"], r["offset"], r["doc_id"], r["start"], r["length"]) for r in rows], {i: len(x) for i, x in ids.items()})
    assert max(sizes.values()) == 2048 and all(n & (n - 1) == 0 for n in sizes.values())
    assert sum(n not in TIERS for n in sizes.values()) <= 11  # the last sequences of the one task
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["context"] == sizes[r["sequence_id"]]
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())


@pytest.mark.parametrize("chunk", [1, 3000, 1 << 20])
def test_odd_rows_in_chunks_of_any_size(odd_docs, chunk):
    rows = packing.pack_documents(odd_docs, packing.PackingParams(chunk_tokens=chunk)).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd_docs.collect()}
    total = sum(len(encoder().ids(r["text"], 1)) for r in odd_docs.collect())
    assert sum(r["length"] for r in rows) == total == sum(len(r["ids"]) // 4 for r in rows)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        n = sum(length for _, length in parts)
        assert n & (n - 1) == 0 and n <= 2048
    nulls = [r for r in rows if r["doc_id"] == 2]
    assert len(nulls) == 1 and (nulls[0]["length"], nulls[0]["doc_tokens"]) == (1, 1)


def test_empty_table(no_docs):
    assert packing.pack_documents(no_docs).count() == 0

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gapwise.llm import op6_repair as repair
from gapwise.llm.queries import queries
from gapwise.llm.tokens import TOKENIZER, TokenEncoder, encoder, tokenizer_path

PARAMS = repair.RePairParams(least=2)


@pytest.fixture(scope="module")
def whole():
    coder = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    return lambda text: coder.encode(text or "", add_special_tokens=False).ids


PARTS = [" ", "  ", "\n", "\t", "\r\n", " ", "a", "Word", "word.", "it's", "'s", "12", "é", "###", "|", "<|endoftext|>", " ", "中文", ",", "don't,", "\x00", "🙂"]


TOGETHER = TokenEncoder(memo=30)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14))
def test_ids_are_the_tokenizers_own(parts):
    text = "".join(parts)
    coder = Tokenizer.from_file(tokenizer_path(TOKENIZER)) if not hasattr(test_ids_are_the_tokenizers_own, "c") else test_ids_are_the_tokenizers_own.c
    test_ids_are_the_tokenizers_own.c = coder
    assert encoder().ids(text, 0).tolist() == [*coder.encode(text, add_special_tokens=False).ids, 0]


def test_ids_of_the_documents(texts, whole):
    want = [[*whole(t), 1] for t in texts.values()]
    for memo in (0, 500, 400_000):
        found = TokenEncoder(memo=memo).ids_many([*texts.values()], 1, block=50)
        assert [ids.tolist() for ids in found] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=8), max_size=6))
def test_ids_of_texts_encoded_together(several):
    texts = ["".join(parts) for parts in several] + [None]
    found = [ids.tolist() for ids in TOGETHER.ids_many(texts, 7)]
    assert found == [[*TOGETHER.tokenizer.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_are_not_cut(name):
    coder = Tokenizer.from_file(tokenizer_path(name))
    assert not encoder(name).by_piece
    assert encoder(name).ids("Some  text, here", 5).tolist() == [*coder.encode("Some  text, here", add_special_tokens=False).ids, 5]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), min_size=1, max_size=6))
def test_any_shard_comes_back(documents):
    own = [np.array([*d, 0], np.uint32) for d in documents]
    data, counts = repair.encode_shard(list(range(len(own))), own, PARAMS)
    shard = repair.Shard(data)
    assert len(shard) == len(own) and counts["ids"] == sum(map(len, own))
    for i, d in enumerate(own):
        assert shard.document(i).tolist() == d.tolist()
        for start, stop in ((0, 3), (2, 9), (len(d) - 1, len(d) + 5), (5, 5)):
            assert shard.part(i, start, stop).tolist() == d[start:stop].tolist()
    assert [x.tolist() for x in shard.documents(block=7)] == [d.tolist() for d in own]


def test_the_grammar_shrinks_repetitive_ids():
    ids = np.tile(np.arange(1, 9, dtype=np.uint32), 500)
    data, counts = repair.encode_shard([None], [np.append(ids, np.uint32(0))], repair.RePairParams(rounds=8))
    shard = repair.Shard(data)
    assert counts["symbols"] < len(ids) / 4 and shard.lengths.max() >= 8
    assert shard.doc_id(0) is None
    with pytest.raises(ValueError):
        repair.Shard(b"other" + data[5:])
    with pytest.raises(ValueError):
        repair.Shard(data + b"x")


def test_query_matches_brute_force(spark, tiny_dir, texts, whole):
    want, start = {}, 0
    for doc_id in sorted(texts):
        ids = np.array([*whole(texts[doc_id]), 0], "<u4")
        want[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    found = queries()["op6_token_shards"](spark, tiny_dir).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in found} == want


def test_odd_rows_and_small_shards(spark, odd_docs, no_docs, whole, tmp_path):
    folder = str(tmp_path / "odd")
    manifest = repair.write_shards(odd_docs, folder, repair.RePairParams(shard_ids=50)).collect()
    assert sum(r["documents"] for r in manifest) == odd_docs.count() and len(manifest) > 3
    found = repair.read_shards(spark, folder).collect()
    rows = sorted(found, key=lambda r: r["start"])
    assert [r["doc_id"] is None for r in rows[:3]] == [True] * 3
    ids = [r["doc_id"] for r in rows[3:]]
    assert ids == sorted(ids)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    texts = sorted([*whole(r["text"]), 0] for r in odd_docs.collect())
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in rows) == texts
    empty = str(tmp_path / "empty")
    assert repair.write_shards(no_docs, empty).count() == 0 and repair.read_shards(spark, empty).count() == 0

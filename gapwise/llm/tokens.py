"""Token ids of whole texts by a public tokenizer, fast on text whose words come back."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np

TOKENIZER = "byte_bpe_50k.json"

#: White space after a space: there the pieces around the space are not independent.
_RUN = re.compile(r" \s")


def tokenizer_path(name: str) -> str:
    """``name`` itself if it is a path, else that file of the installed public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known(dict):
    """Ids, as bytes, of pieces that follow a space.

    A piece that is not remembered is made from its stem and a mark at its end, which are independent, or comes from
    the pieces just learned, or is noted as unknown.
    """

    def __init__(self) -> None:
        super().__init__()
        self.marks: dict[str, bytes] = {}
        self.learned: dict[str, bytes] = {}
        self.unknown: set[str] = set()
        self.misses = 0

    def __missing__(self, piece: str) -> bytes | None:
        mark = self.marks.get(piece[-1:])
        if mark is not None and piece[-2:-1].isalpha():
            stem = self.get(piece[:-1])
            if stem is not None:
                return stem + mark
        found = self.learned.get(piece)
        if found is None:
            self.unknown.add(piece)
            self.misses += 1
        return found


class TokenEncoder:
    """Ids of texts, equal to the tokenizer's own for the whole text.

    A byte-level tokenizer of this kind splits a text before every space that follows a letter, digit or
    mark, and encodes the parts independently.  So the parts between single spaces can be remembered, and
    those of many texts that are not known yet are encoded together.  Texts with longer runs of white space, and
    other kinds of tokenizer, are encoded in one go.  The memo is bounded and changes no result.
    """

    def __init__(self, name: str = TOKENIZER, memo: int = 1_200_000):
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.tokenizer, self.memo = Tokenizer.from_file(path), memo
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        split = kind.get("pre_tokenizer") or {}
        plain = not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] or not t["content"].isascii()
            for t in kind["added_tokens"]
        )
        self.by_piece = (
            plain
            and kind.get("normalizer") is None
            and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
        )
        self.known = _Known()
        if self.by_piece:
            # A character of a byte-level token stands for one byte.
            self.bytes_of = np.zeros(size, np.int64)
            for token, number in self.tokenizer.get_vocab().items():
                self.bytes_of[number] = len(token)
            self.known.marks = {mark: self.whole(mark) for mark in ".,;:!?"}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that follow a space, encoded together, and remembered while there is room."""
        ids = np.array(self.tokenizer.encode(" " + " ".join(pieces), add_special_tokens=False).ids, self.dtype)
        reached = np.cumsum(self.bytes_of[ids])
        ends = np.cumsum([len(p) + 1 if p.isascii() else len(p.encode()) + 1 for p in pieces])
        stops = np.searchsorted(reached, ends, "left") + 1
        if (reached[stops - 1] == ends).all():
            data, width = ids.tobytes(), self.dtype.itemsize
            cuts = [0, *(stops * width).tolist()]
            found = {piece: data[a:b] for piece, a, b in zip(pieces, cuts, cuts[1:])}
        else:  # never so for this kind of tokenizer; then no piece can be told apart
            found = {piece: self.whole(" " + piece) for piece in pieces}
        if len(self.known) + len(found) <= self.memo:
            self.known.update((piece, ids) for piece, ids in found.items() if len(piece) <= 64)
        return found

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian bytes of ``dtype``; none for a missing or empty one."""
        found: list[bytes] = [b""] * len(texts)
        known, waiting = self.known, []
        for at, text in enumerate(texts):
            if not text:
                continue
            if not self.by_piece or _RUN.search(text):
                found[at] = self.whole(text)
                continue
            head, *rest = text.split(" ")
            found[at] = self.whole(head) if head else b""
            before = known.misses
            ids = list(map(known.__getitem__, rest))
            if known.misses > before:
                waiting.append((at, rest))
            else:
                found[at] += b"".join(ids)
        if waiting:
            known.learned = self._learn(list(known.unknown))
            known.unknown = set()
            for at, rest in waiting:
                found[at] += b"".join(map(known.__getitem__, rest))
            known.learned = {}
        return found

    def ids_many(self, texts: list[str | None], end: int, block: int = 256) -> Iterator[np.ndarray]:
        """The ids of each text with ``end`` after them, as unsigned 32-bit integers."""
        for at in range(0, len(texts), block):
            for data in self.encode_many(texts[at : at + block]):
                ids = np.empty(len(data) // self.dtype.itemsize + 1, "<u4")
                ids[:-1] = np.frombuffer(data, self.dtype)
                ids[-1] = end
                yield ids

    def ids(self, text: str | None, end: int) -> np.ndarray:
        return next(self.ids_many([text], end))


_ENCODERS: dict[str, TokenEncoder] = {}


def encoder(name: str = TOKENIZER) -> TokenEncoder:
    """One encoder per Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if name not in _ENCODERS:
        _ENCODERS[name] = TokenEncoder(name)
    return _ENCODERS[name]

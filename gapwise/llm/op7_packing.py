"""Hierarchical packing of documents into sequences of several context sizes.

Documents are cut at the longest size; what is left of each goes to the smallest tier it fits.  Tiers are packed from
the longest down, and gaps are filled with whole pieces of shorter tiers before a piece is cut.
Every window is full, so nothing is padded.  Windows of all sizes are dealt to step groups of about equal tokens.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.llm.tokens import TOKENIZER, encoder

RESULT = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "context int, step_group bigint, ids binary"
)


@dataclass(frozen=True)
class PackingParams:
    """tiers: context sizes, powers of two, ascending.  end_id: closes every document.
    step_tokens: tokens of a step group.  chunk_tokens: tokens that a task packs at a time.
    """

    tiers: tuple[int, ...] = (256, 512, 1024, 2048)
    end_id: int = 1
    step_tokens: int = 32 * 1024
    chunk_tokens: int = 1 << 20
    tokenizer: str = TOKENIZER


@dataclass(frozen=True, slots=True)
class Piece:
    doc: int
    start: int
    length: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, at), Piece(self.doc, self.start + at, self.length - at)


class _Pool:
    """Pieces by length; ``mask`` has a bit for every length there is."""

    def __init__(self, longest: int):
        self.stacks: list[list[Piece]] = [[] for _ in range(longest + 1)]
        self.mask = 0

    def push(self, piece: Piece) -> None:
        self.stacks[piece.length].append(piece)
        self.mask |= 1 << piece.length

    def pop(self, length: int) -> Piece:
        stack = self.stacks[length]
        piece = stack.pop()
        if not stack:
            self.mask ^= 1 << length
        return piece

    def longest(self, most: int) -> int:
        """The greatest length up to ``most``; 0 if there is none."""
        return max(0, (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def shortest(self) -> int:
        return (self.mask & -self.mask).bit_length() - 1


def cut_document(doc: int, tokens: int, longest: int) -> list[Piece]:
    return [Piece(doc, at, min(longest, tokens - at)) for at in range(0, tokens, longest)]


def pack(pieces: list[Piece], tiers: tuple[int, ...]) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows, and the pieces of the one window that could not be filled."""
    pool = _Pool(tiers[-1])
    for piece in pieces:
        pool.push(piece)
    windows = []
    while pool.mask:
        window = [pool.pop(pool.longest(tiers[-1]))]
        gap = next(t for t in tiers if t >= window[0].length) - window[0].length
        while gap and pool.mask:
            if fits := pool.longest(gap):
                piece = pool.pop(fits)
            else:
                piece, rest = pool.pop(pool.shortest()).cut(gap)
                pool.push(rest)
            window.append(piece)
            gap -= piece.length
        if gap:
            return windows, window
        windows.append(window)
    return windows, []


def pack_rest(pieces: list[Piece]) -> list[list[Piece]]:
    """Windows of descending powers of two that hold exactly these pieces."""
    left, total, windows = pieces[::-1], sum(p.length for p in pieces), []
    for size in (1 << b for b in reversed(range(total.bit_length())) if total >> b & 1):
        window = []
        while size:
            piece = left.pop()
            if piece.length > size:
                piece, rest = piece.cut(size)
                left.append(rest)
            window.append(piece)
            size -= piece.length
        windows.append(window)
    return windows


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """A group for each window: the longest first, each to the group with the fewest tokens."""
    count = max(1, round(sum(sizes) / step_tokens))
    heap, found = [(0, g) for g in range(count)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        tokens, group = heapq.heappop(heap)
        found[i] = group
        heapq.heappush(heap, (tokens + sizes[i], group))
    return found


class _Packer:
    """Packs the documents of one task, a chunk at a time; an unfilled window waits for the next chunk."""

    def __init__(self, partition: int, params: PackingParams):
        self.params, self.base = params, partition << 32
        self.sequences = self.groups = self.tokens = 0
        self.docs: dict[int, tuple[int | None, np.ndarray]] = {}
        self.pieces: list[Piece] = []
        self.seen = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs[self.seen] = (doc_id, ids)
        self.pieces += cut_document(self.seen, len(ids), self.params.tiers[-1])
        self.seen += 1
        self.tokens += len(ids)

    def flush(self, last: bool) -> pa.RecordBatch:
        windows, rest = pack(self.pieces, self.params.tiers)
        if last:
            windows += pack_rest(rest)
            rest = []
        sizes = [sum(p.length for p in window) for window in windows]
        groups = step_groups(sizes, self.params.step_tokens)
        rows = []
        for window, size, group in zip(windows, sizes, groups):
            offset = 0
            for p in window:
                doc_id, ids = self.docs[p.doc]
                piece = ids[p.start : p.start + p.length].tobytes()
                rows.append(
                    (doc_id, p.start, p.length, len(ids), self.base + self.sequences, offset, size,
                     self.base + self.groups + group, piece)
                )
                offset += p.length
            self.sequences += 1
        self.groups += max(groups, default=-1) + 1
        waiting = {p.doc for p in rest}
        self.docs = {doc: self.docs[doc] for doc in waiting}
        self.pieces, self.tokens = rest, sum(p.length for p in rest)
        names = [part.split()[0] for part in RESULT.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def pack_documents(docs: DataFrame, params: PackingParams = PackingParams()) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and its ids.

    ``ids`` are little-endian unsigned 32-bit integers; ``context`` is the length of the sequence.  A null or empty text is
    the end id alone.  Every row of ``docs`` is a document of its own, repeated ids too.  Nothing is shuffled:
    a task packs what it reads, and the last sequences of a task are as short as needed, at powers of two.
    ``sequence_id`` and ``step_group`` carry the number of the task.  An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(params.tokenizer)
        packer = _Packer(TaskContext.get().partitionId(), params)
        for batch in batches:
            texts = coder.ids_many(batch.column("text").to_pylist(), params.end_id)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), texts):
                packer.add(doc_id, ids)
                if packer.tokens >= params.chunk_tokens:
                    yield packer.flush(False)
        yield packer.flush(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)

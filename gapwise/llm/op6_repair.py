"""Token ids as grammar-compressed binary shards (Re-Pair), decodable document by document.

Within a shard the most frequent pairs of neighbouring symbols are replaced by new symbols, again and again.  The file keeps
the rules, the length each symbol expands to, and where each document begins, so that any document, or any part of
one, is decoded alone.  Pairs never reach over the end of a document.

File format, all integers little-endian: the magic bytes, eight unsigned 64-bit counts (documents, ids, symbols,
terminals, rules, end id, bytes per symbol, 0), then the arrays
    doc_ids      int64 per document          missing   uint8 per document (1: the id is missing)
    id_starts    uint64 per document and one id_starts and symbol_starts: from the beginning of the shard
    symbol_starts uint64 per document and one
    terminals    uint32 per terminal         the ids that occur, ascending: symbols 0 to terminals - 1
    rules        2 x uint32 per rule         the two symbols of symbol ``terminals + rule``
    lengths      uint32 per rule             ids that the rule expands to
    symbols      uint16 or uint32 each
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapwise.llm import files
from gapwise.llm.tokens import TOKENIZER, encoder

MAGIC = b"REPAIR01"
WRITTEN = (
    "partition int, number int, temporary string, name string, documents bigint, ids bigint, "
    "symbols bigint, rules bigint, bytes bigint"
)
DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


@dataclass(frozen=True)
class RePairParams:
    """shard_ids: ids after which a shard ends, at the end of a document.  rounds: at most; each replaces up to
    ``pairs`` pairs that occur ``least`` times or more.  end_id: closes every document.
    """

    shard_ids: int = 2_000_000
    rounds: int = 6
    pairs: int = 1024
    least: int = 16
    end_id: int = 0
    tokenizer: str = TOKENIZER


# -- the grammar -----------------------------------------------------------------------------

_SLOTS = 20  # bits of the table in which pairs are counted
_NONE = 1 << _SLOTS  # slot of places without a pair of their own


def _frequent_pairs(symbols: np.ndarray, ends: np.ndarray, turn: int, params: RePairParams):
    """For each place the number of its pair among the chosen, or -1; and the chosen pairs.

    Pairs are counted in a hash table in which the last pair of a slot represents it, and are counted exactly.
    A pair that loses its slot this time has another slot next time.
    """
    half = 16 if int(symbols.max()) < 1 << 16 else 32
    wide = np.uint32 if half == 16 else np.uint64
    odd = wide((0x9E3779B97F4A7C15 + 2 * turn * 0x2545F4914F6CDD1D) % (1 << 2 * half) | 1)
    pair = symbols[:-1].astype(wide) << wide(half) | symbols[1:].astype(wide)
    slot = (pair * odd >> wide(2 * half - _SLOTS)).astype(np.int32)
    slot[ends[:-1]] = _NONE
    holder = np.zeros(_NONE + 1, wide)
    holder[slot] = pair
    slot[holder[slot] != pair] = _NONE
    counts = np.bincount(slot, minlength=_NONE + 1)
    counts[_NONE] = 0
    frequent = np.flatnonzero(counts >= params.least)
    frequent = frequent[np.argsort(-counts[frequent], kind="stable")][: params.pairs]
    number = np.full(_NONE + 1, -1, np.int32)
    number[frequent] = np.arange(len(frequent))
    chosen = holder[frequent]
    return number[slot], np.stack([chosen >> wide(half), chosen & wide((1 << half) - 1)], 1).astype(np.uint32)


def compress(symbols: np.ndarray, ends: np.ndarray, first_rule: int, params: RePairParams):
    """(symbols, ends, rules): ``ends`` marks the last symbol of each document, rule r makes symbol first_rule + r."""
    rules = np.empty((0, 2), np.uint32)
    symbols, ends = symbols.astype(np.uint32), ends.copy()
    for turn in range(params.rounds):
        if len(symbols) < 2:
            break
        chosen, pairs = _frequent_pairs(symbols, ends, turn, params)
        places = np.flatnonzero(chosen >= 0)
        if len(places) == 0:
            break
        # Of places that follow each other directly, every second one: pairs must not overlap.
        fresh = np.concatenate(([True], np.diff(places) != 1))
        at = np.arange(len(places))
        places = places[(at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0]
        symbols[places] = first_rule + len(rules) + chosen[places]
        ends[places] = ends[places + 1]
        gone = np.ones(len(symbols), bool)
        gone[places + 1] = False
        symbols, ends = symbols[gone], ends[gone]
        rules = np.concatenate([rules, pairs])
    return symbols, ends, rules


def expansions(terminals: np.ndarray, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols' ids one after another, where each symbol's begin, and how many they are."""
    parts = [terminals[i : i + 1] for i in range(len(terminals))]
    for left, right in rules.tolist():
        parts.append(np.concatenate([parts[left], parts[right]]))
    lengths = np.array([len(p) for p in parts], np.int64)
    pool = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    return pool, np.concatenate(([0], np.cumsum(lengths)))[:-1], lengths


# -- the file --------------------------------------------------------------------------------


def encode_shard(doc_ids: list[int | None], documents: list[np.ndarray], params: RePairParams) -> tuple[bytes, dict]:
    """The bytes of a shard, and counts for the manifest.  Every document has at least its end id."""
    ids = np.concatenate(documents)
    starts = np.concatenate(([0], np.cumsum([len(d) for d in documents]))).astype("<u8")
    seen = np.zeros(int(ids.max()) + 1, bool)
    seen[ids] = True
    terminals = np.flatnonzero(seen).astype("<u4")
    number = np.cumsum(seen) - 1
    ends = np.zeros(len(ids), bool)
    ends[starts[1:].astype(np.int64) - 1] = True
    symbols, ends, rules = compress(number[ids], ends, len(terminals), params)
    lengths = [1] * len(terminals)
    for left, right in rules.tolist():
        lengths.append(lengths[left] + lengths[right])
    width = 2 if len(lengths) <= 1 << 16 else 4
    symbol_starts = np.concatenate(([0], np.flatnonzero(ends) + 1)).astype("<u8")
    counts = [len(documents), len(ids), len(symbols), len(terminals), len(rules), params.end_id, width, 0]
    data = b"".join(
        [
            MAGIC,
            np.array(counts, "<u8").tobytes(),
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], "u1").tobytes(),
            starts.tobytes(),
            symbol_starts.tobytes(),
            terminals.tobytes(),
            rules.astype("<u4").tobytes(),
            np.array(lengths[len(terminals) :], "<u4").tobytes(),
            symbols.astype(f"<u{width}").tobytes(),
        ]
    )
    return data, {"documents": len(documents), "ids": len(ids), "symbols": len(symbols), "rules": len(rules)}


class Shard:
    """Random access to the documents of a shard."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        counts = np.frombuffer(data, "<u8", 8, 8)
        docs, ids, symbols, terminals, rules, self.end_id, width = (int(c) for c in counts[:7])
        at = 8 + 64

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        self.doc_ids, self.missing = take("<i8", docs), take("u1", docs)
        self.starts, self.symbol_starts = take("<u8", docs + 1).astype(np.int64), take("<u8", docs + 1).astype(np.int64)
        self.terminals = take("<u4", terminals)
        self.rules = take("<u4", 2 * rules).reshape(rules, 2)
        self.lengths = np.concatenate([np.ones(terminals, np.int64), take("<u4", rules).astype(np.int64)])
        self.symbols = take(f"<u{width}", symbols)
        if at != len(data):
            raise ValueError("a shard of another size than its header says")
        self.pool, self.begins, own = expansions(self.terminals, self.rules)
        if not np.array_equal(own, self.lengths):
            raise ValueError("stored lengths differ from the rules")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        lengths = self.lengths[symbols]
        total = int(lengths.sum())
        shift = self.begins[symbols] - (np.cumsum(lengths) - lengths)
        return self.pool[np.repeat(shift, lengths) + np.arange(total)].astype("<u4")

    def doc_id(self, i: int) -> int | None:
        return None if self.missing[i] else int(self.doc_ids[i])

    def document(self, i: int) -> np.ndarray:
        return self._expand(self.symbols[self.symbol_starts[i] : self.symbol_starts[i + 1]])

    def part(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of a document; only symbols that reach into the part are expanded."""
        symbols = self.symbols[self.symbol_starts[i] : self.symbol_starts[i + 1]]
        ends = np.cumsum(self.lengths[symbols])
        stop = min(stop, int(ends[-1]))
        if start >= stop:
            return np.empty(0, "<u4")
        first, last = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
        skipped = int(ends[first - 1]) if first else 0
        return self._expand(symbols[first : last + 1])[start - skipped : stop - skipped]

    def documents(self, block: int = 1 << 20) -> Iterator[np.ndarray]:
        """All documents in order, expanded some at a time."""
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + block, "right")) - 1)
            ids = self._expand(self.symbols[self.symbol_starts[i] : self.symbol_starts[j]])
            for k in range(i, j):
                yield ids[self.starts[k] - self.starts[i] : self.starts[k + 1] - self.starts[i]]
            i = j


# -- the jobs ----------------------------------------------------------------------------------


def write_shards(docs: DataFrame, folder: str, params: RePairParams = RePairParams()) -> DataFrame:
    """Encode every row of ``docs`` and write shards in ascending ``doc_id`` order; returns the committed manifest.

    A null or empty text is the end id alone.  Missing ids come first; rows with the same id are ordered by text.  A
    document longer than a shard makes a shard of its own.  An empty table gives an empty manifest.
    The manifest has the ids before each shard as ``start``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(params.tokenizer)
        writer, rows, doc_ids, documents, total = None, [], [], [], 0

        def close() -> None:
            data, counts = encode_shard(doc_ids, documents, params)
            temporary, name, number = writer.next()
            with writer.open(temporary) as stream:
                stream.write(data)
            rows.append((writer.partition, number, temporary, name, *counts.values(), len(data)))
            doc_ids.clear()
            documents.clear()

        for batch in batches:
            writer = writer or files.FileWriter(folder, ".ids")
            texts = coder.ids_many(batch.column("text").to_pylist(), params.end_id)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), texts):
                if documents and total + len(ids) > params.shard_ids:
                    close()
                    total = 0
                doc_ids.append(doc_id)
                documents.append(ids)
                total += len(ids)
        if documents:
            close()
        names = [part.split()[0] for part in WRITTEN.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string()] + [pa.int64()] * 5
        found = list(zip(*rows)) or [()] * len(names)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(found, kinds)], names=names)

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    files.commit(ranged.mapInArrow(run, WRITTEN), folder)
    return shards(docs.sparkSession, folder)


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """The committed manifest with ``start``; a row per file, so its running sum is small."""
    order = Window.orderBy("partition", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.manifest(spark, folder).withColumn("start", F.coalesce(F.sum("ids").over(order), F.lit(0)))


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: id, ids of all documents before it, and its ids as little-endian 32-bit integers."""

    def read(store: fs.FileSystem, path: str, row: dict) -> Iterator[pa.RecordBatch]:
        with store.open_input_stream(path, compression=None) as stream:
            shard = Shard(stream.readall())
        rows, held = [], 0
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            return pa.record_batch(columns, names=[part.split()[0] for part in DOCUMENTS.split(", ")])

        for i, ids in enumerate(shard.documents()):
            rows.append((shard.doc_id(i), row["start"] + int(shard.starts[i]), len(ids), ids.tobytes()))
            held += len(ids)
            if held >= 1 << 20:
                yield batch()
                rows.clear()
                held = 0
        if rows:
            yield batch()

    return files.each_file(shards(spark, folder), read, folder, DOCUMENTS)

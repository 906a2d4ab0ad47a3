"""Document fingerprints: sketches of all shingle hashes below a fixed threshold.

A shingle is the window of five lower-cased words that ends at a word; before the first word there is padding, so a
text of n words has n windows, however short it is.  A hash of 48 bits is kept if it lies below a fixed fraction of
their range.  Which hashes are kept does not depend on the document, so the union of two sketches is the sketch of the union, and
shared hashes over the hashes of one side estimate how much of it the other contains, whatever their lengths.
Below the threshold a short text has few hashes or none; texts of up to ``whole`` distinct shingles therefore keep the
others too, apart, and two such texts are compared exactly.

The next document in order is found by ranging the rows and walking through each range with the row before at hand.
The last row of a range waits for the first of the next: two rows a range are matched by a join afterwards.  Rows are
ranged by id, hash of the text and place in the input, so ids that are missing or repeated divide like others.

Nulls: a missing text is empty; missing ids come first.  A text without words has an empty sketch, which equals only other
empty ones.  Texts are taken whole and each row has a fingerprint of its own.  Rows of one id follow each other by the hash of their
texts; equal rows are neighbours of each other.  A single row is its own next document.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapwise.llm.common import keep_table

BITS = 48
#: Odd multiplier of the windows' polynomial, and the words that a task remembers.
FACTOR, REMEMBERED = 0x9E3779B97F4A7C15, 1 << 20


@dataclass(frozen=True)
class SketchParams:
    """shingle: words of a window.  fraction: one hash of so many is kept.  whole: distinct shingles up to
    which a text keeps all.  edit: the share (one of so many code points) that an edit replaces.
    """

    shingle: int = 5
    fraction: int = 8
    whole: int = 64
    edit: int = 4


class _Words(dict):
    """Hashes of words; those that recur are not hashed again."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED and len(word) < 64:
            self[word] = value
        return value


@dataclass(frozen=True)
class Sketch:
    """Ascending hashes below the threshold; the others of a text that keeps all, else None."""

    low: np.ndarray
    rest: np.ndarray | None

    def __str__(self) -> str:
        return f"{'s' if self.rest is None else 'c'}:{_text(self.low)}:{'' if self.rest is None else _text(self.rest)}"

    def shared(self, other: Sketch) -> tuple[int, int, int]:
        """Shingles of both, of this one and of the other, counted at what both sketches have."""
        a, b, both = len(self.low), len(other.low), _common(self.low, other.low)
        if self.rest is not None and other.rest is not None:
            a, b, both = a + len(self.rest), b + len(other.rest), both + _common(self.rest, other.rest)
        return both, a, b

    def likeness(self, other: Sketch) -> float:
        """Shared share of all shingles, 0 to 1."""
        both, a, b = self.shared(other)
        if a + b == 0:
            return float((self.rest is None) == (other.rest is None))
        return both / (a + b - both)

    def contained(self, other: Sketch) -> float:
        """Share of this one's shingles that the other has, 0 to 1."""
        both, a, _ = self.shared(other)
        return both / a if a else float(self.rest is not None and not len(self.rest))

    def merge(self, other: Sketch, params: SketchParams = SketchParams()) -> Sketch:
        """Sketch of the shingles of either."""
        low = np.union1d(self.low, other.low)
        if self.rest is not None and other.rest is not None:
            rest = np.union1d(self.rest, other.rest)
            if len(low) + len(rest) <= params.whole:
                return Sketch(low, rest)
        return Sketch(low, None)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True)) if len(a) and len(b) else 0


def _text(hashes: np.ndarray) -> str:
    """Six bytes a hash, eight characters."""
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return base64.b64encode(octets.tobytes()).decode()


def _hashes(text: str) -> np.ndarray:
    octets = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    padded = np.zeros((len(octets), 8), np.uint8)
    padded[:, 2:] = octets
    return padded.view(">u8").ravel().astype(np.uint64)


def parse(fingerprint: str) -> Sketch:
    """The sketch that a fingerprint states."""
    kind, low, rest = fingerprint.split(":")
    return Sketch(_hashes(low), _hashes(rest) if kind == "c" else None)


class Sketcher:
    """Makes sketches, and remembers words between them."""

    def __init__(self, params: SketchParams = SketchParams()):
        self.params = params
        self.words = _Words()
        self.limit = np.uint64((1 << BITS) // params.fraction)
        self.factors = [np.uint64(pow(FACTOR, i, 1 << 64)) for i in range(params.shingle)]

    def shingles(self, text: str) -> np.ndarray:
        """Distinct hashes of the windows, ascending."""
        words = text.lower().encode("utf-8", "surrogatepass").split()
        n, back = len(words), self.params.shingle - 1
        padded = np.zeros(n + back, np.uint64)
        padded[back:] = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        h = np.zeros(n, np.uint64)
        for i, factor in enumerate(self.factors):
            h += padded[back - i : back - i + n] * factor
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(odd)
        return np.unique((h ^ (h >> np.uint64(31))) >> np.uint64(64 - BITS))

    def sketch(self, text: str) -> Sketch:
        h = self.shingles(text)
        below = int(np.searchsorted(h, self.limit))
        return Sketch(h[:below], h[below:] if len(h) <= self.params.whole else None)


def edited(text: str, after: str, share: int) -> str:
    """``text`` with its last floor(n / share) code points replaced by as many of the start of ``after``."""
    n = len(text) // share
    return text[: len(text) - n] + after[:n]


#: A row of the result; ``prints`` holds both fingerprints, which share most of their hashes and so compress together.
COLUMNS = (
    "doc_id {id}, n_chars bigint, edited_sha256 string, prints string, near_edited double, near_next double, "
    "contained_edited double, contained_next double"
)
RESULT = (
    "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
    "near_edited", "near_next", "contained_edited", "contained_next",
)


@dataclass(frozen=True, slots=True)
class _Compared:
    """What a document's row says once the next document is known."""

    edited_sha256: str
    prints: str
    near_edited: float
    near_next: float
    contained_edited: float
    contained_next: float


def _compare(maker: Sketcher, text: str, own: Sketch, after: str, following: Sketch) -> _Compared:
    changed = edited(text, after, maker.params.edit)
    other = maker.sketch(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return _Compared(
        digest, f"{own}|{other}", own.likeness(other), own.likeness(following), own.contained(other), own.contained(following)
    )


class _Rows:
    """Columns of an Arrow batch in the making, sent off every so many rows."""

    def __init__(self, schema: pa.Schema, size: int = 2048):
        self.schema, self.size, self.rows = schema, size, []

    def add(self, row: dict) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        if len(self.rows) >= self.size:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, self.schema)
        self.rows = []


def _schema(id_type: pa.DataType, *extra: tuple[str, pa.DataType]) -> pa.Schema:
    kinds = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("prints", pa.string())]
    kinds += [(f.name, pa.float64()) for f in fields(_Compared)[2:]]
    return pa.schema([("doc_id", id_type), *kinds, *extra])


def _described(doc_id: object, text: str, compared: _Compared | None) -> dict:
    row = {"doc_id": doc_id, "n_chars": len(text)}
    return row if compared is None else row | {f.name: getattr(compared, f.name) for f in fields(compared)}


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, str]]:
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for at in range(len(batch)):
            yield ids[at].as_py(), texts[at].as_py()


def fingerprint_edits(docs: DataFrame, params: SketchParams = SketchParams()) -> DataFrame:
    """Fingerprints of every document and of its edit, and their likeness to each other and to the next document.

    Runs the job that stores them; what is returned is a scan of those rows and of the few that ended a range.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place")
    )
    order = ["doc_id", "hash", "place"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row but the last with all values; the first and the last with their texts."""
        part, maker, out, held = TaskContext.get().partitionId(), Sketcher(params), None, None
        first = True
        for batch in batches:
            if out is None:
                ends = (("part", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()), ("text", pa.string()))
                out = _Rows(_schema(batch.schema.field("doc_id").type, *ends))
            for doc_id, text in _documents([batch]):
                sketch = maker.sketch(text)
                if held is not None:
                    done = _described(held[0], held[1], _compare(maker, held[1], held[2], text, sketch))
                    done |= {"part": part, "first": first, "last": False, "text": held[1] if first else None}
                    first = False
                    yield from out.add(done)
                held = (doc_id, text, sketch)
        if held is not None:
            done = _described(held[0], held[1], None)
            yield from out.add(done | {"part": part, "first": first, "last": True, "text": held[1]})
            yield from out.flush()

    columns = COLUMNS.format(id=kind)
    walked, _ = keep_table(ranged.mapInArrow(walk, f"{columns}, part int, first boolean, last boolean, text string"), "sketches")

    # From here two rows a range: the last ones, each with the text that begins the next range (after the last: the first).
    firsts = walked.where("first")
    turn = Window.orderBy("part")
    after = F.coalesce(F.lead("part").over(turn), F.first("part").over(turn))
    following = firsts.select("part").select("part", after.alias("next"))
    starts = firsts.select(F.col("part").alias("next"), F.col("text").alias("after"))
    lasts = walked.where("last").select("doc_id", "part", "text").join(following, "part").join(starts, "next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Sketcher(params)
        for batch in batches:
            out = _Rows(_schema(batch.schema.field("doc_id").type))
            for (doc_id, text), after in zip(_documents([batch]), batch.column("after")):
                compared = _compare(maker, text, maker.sketch(text), after.as_py(), maker.sketch(after.as_py()))
                yield from out.add(_described(doc_id, text, compared))
            yield from out.flush()

    finished = lasts.select("doc_id", "text", "after").mapInArrow(finish, columns)
    both = walked.where("NOT last").select(finished.columns).unionByName(finished)
    prints = F.split("prints", r"\|")
    return both.withColumns({"fingerprint": prints[0], "edited_fingerprint": prints[1]}).select(*RESULT)

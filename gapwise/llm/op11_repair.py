"""Repair of the turn structure of conversations by lightest derivations.

A repaired conversation is empty, or alternates user and assistant and ends with the assistant, after one system turn at
most.  Edits keep, rerole or delete a turn, or insert an empty one.  The item [i, q] says that the rows from i on can be edited so
that the pattern, entered in state q, ends as wanted.  A deduction joins an edit of row i - 1, or an insertion, to an item; its
cost adds up and the edit's initial goes before the item's audit.  Knuth's agenda pops items by (cost, rows
taken, audit).  Every deduction raises cost or rows taken, so it is superior; a letter put before two audits leaves
their order, so it is monotone; hence an item is final when it is popped, and the agenda stops at its goal.

Rows are ranged by conversation and turn, and each range is cut into segments: whole conversations, and pieces of
those that are long or lie across ranges.  A whole one is repaired where it is.  Pieces, two a range unless conversations
are long, go an exact way that never brings a conversation's texts together: their rows' first occurrences are counted by Spark, each piece
is deduced for every pair of states, pieces are added up range by range and then conversation by conversation (audits
of one cost and piece are never prefixes of each other, so their order survives joining), and the states
found go back to the pieces.  Only the hash of a conversation needs its pieces in order, as a stream.

Nulls: a missing role or text is one space; missing turns come first and count in no gap; a missing conversation
id is a conversation.  Rows of one turn are ordered by role and text (their first characters, then a hash).  A role without an initial, or with any
but s, u and a, fits nowhere: its turn is reroled or deleted.  Texts may be of any length.  Conversations without a present row are
reported with zeros, an empty audit and the hash of nothing.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import attach, keep_table

# What counts as space, how a sentence ends, what edits cost.
SPACE = " \t\n\x0b\x0c\r"
ENDINGS = ".!?"
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3

# States of the pattern: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
#: The role that a state wants next, and where the turns that fit lead.
WANTED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
STEPS = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
ALLOWED = {"su", "ua", "au"}

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"

Weight = tuple[int, str]


#: Rows that a segment may have at most.
MOST_ROWS = 1 << 12


@dataclass(frozen=True)
class RepairParams:
    """Bounds of a segment; they change no result.  ``rows`` is at most ``MOST_ROWS``."""

    rows: int = 1024
    characters: int = 1 << 22


# -- deduction ------------------------------------------------------------------


def _entries() -> dict[tuple[str, int], list[int]]:
    """For a role's initial and a state, the states from which a turn of that role leads there."""
    found: dict[tuple[str, int], list[int]] = {}
    for (initial, before), after in STEPS.items():
        found.setdefault((initial, after), []).append(before)
    return found


ENTRIES = _entries()
#: States from which an inserted or reroled turn leads to a state.
MADE = {after: [q for q in WANTED if STEPS[WANTED[q][0], q] == after] for after in (USER, ASSISTANT)}


def lightest(
    rows: Sequence[tuple[str, str | None]], ends: Iterable[int], goals: Iterable[int]
) -> dict[int, Weight]:
    """The least (cost, audit) from each goal state over all ``rows`` to one of the states ``ends``.

    ``rows`` are (role's initial, fault).  States from which no end can be reached are left out.
    """
    n = len(rows)
    agenda = [(0, 0, "", q) for q in ends]
    heapq.heapify(agenda)
    final: set[tuple[int, int]] = set()
    missing, found = set(goals), {}
    while agenda and missing:
        cost, taken, audit, state = heapq.heappop(agenda)
        if (taken, state) in final:
            continue
        final.add((taken, state))
        if taken == n and state in missing:
            found[state] = (cost, audit)
            missing.discard(state)
        for before in MADE.get(state, ()):
            heapq.heappush(agenda, (cost + INSERT, taken, "I" + audit, before))
        if taken == n:
            continue
        initial, fault = rows[n - 1 - taken]
        heapq.heappush(agenda, (cost + DELETE, taken + 1, "D" + audit, state))
        if fault in (BLANK, DUPLICATE):
            continue
        more = UNFINISHED if fault == TRUNCATED else 0
        for before in ENTRIES.get((initial, state), ()):
            heapq.heappush(agenda, (cost + more, taken + 1, "K" + audit, before))
        for before in MADE.get(state, ()):
            heapq.heappush(agenda, (cost + more + REROLE, taken + 1, "R" + audit, before))
    return found


def apply_edits(audit: str, state: int, turns: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """The repaired turns (edit, role, text) that ``audit`` makes of (role, text), entered in ``state``."""
    left = iter(turns)
    for edit in audit:
        role, text = next(left) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = WANTED[state]
        state = STEPS[role[:1], state]
        yield edit, role, text


def faults(turns: Sequence[tuple[str, str]], repeated: Callable[[int], bool] | None = None) -> list[str | None]:
    """First fault of every (role, text).  ``repeated`` says whether a row occurred before; by default among ``turns``."""
    seen, found = set(), []
    for at, (role, text) in enumerate(turns):
        stripped = text.rstrip(SPACE)
        again = (role, text) in seen if repeated is None else repeated(at)
        if repeated is None:
            seen.add((role, text))
        if not stripped:
            found.append(BLANK)
        elif again:
            found.append(DUPLICATE)
        else:
            found.append(None if stripped[-1] in ENDINGS else TRUNCATED)
    return found


@dataclass
class Counts:
    """What is counted over rows in order; two of them add up."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0  # different ones
    least: int | None = None
    greatest: int | None = None
    first: str | None = None  # initials
    last: str | None = None

    @classmethod
    def of(cls, turns: Iterable[int | None], initials: Sequence[str], found: Sequence[str | None]) -> Counts:
        known = sorted({t for t in turns if t is not None})
        counts = cls(found.count(BLANK), found.count(DUPLICATE), found.count(TRUNCATED))
        counts.illegal = sum(a + b not in ALLOWED for a, b in zip(initials, initials[1:]))
        counts.turns = len(known)
        if known:
            counts.least, counts.greatest = known[0], known[-1]
        if initials:
            counts.first, counts.last = initials[0], initials[-1]
        return counts

    def then(self, other: Counts) -> Counts:
        """Counts over these rows and then the other's, whose turns are not smaller."""
        if other.first is None:
            return self
        if self.first is None:
            return other
        total = Counts(self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated)
        total.illegal = self.illegal + other.illegal + (self.last + other.first not in ALLOWED)
        touch = self.greatest is not None and self.greatest == other.least
        total.turns = self.turns + other.turns - touch
        total.least = other.least if self.least is None else self.least
        total.greatest = self.greatest if other.greatest is None else other.greatest
        total.first, total.last = self.first, other.last
        return total

    @property
    def gaps(self) -> int:
        return self.greatest - self.least + 1 - self.turns if self.turns else 0


@dataclass
class Piece:
    """A run of a conversation's rows, deduced between states: the lightest (cost, audit) and the pieces' states."""

    counts: Counts
    best: dict[tuple[int, int], tuple[int, str, str]] = field(default_factory=dict)

    def then(self, other: Piece) -> Piece:
        joined = Piece(self.counts.then(other.counts))
        for (start, middle), (cost, audit, states) in self.best.items():
            for (entered, end), (more, rest, others) in other.best.items():
                if entered == middle:
                    made = (cost + more, audit + rest, states + others)
                    known = joined.best.get((start, end))
                    if known is None or made[:2] < known[:2]:
                        joined.best[start, end] = made
        return joined


# -- rows, segments ---------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the hash of (conversation, turn); a dropped row stays as one that is not present."""
    space = F.lit(" ")
    key = F.concat_ws(
        ":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)
    )
    rows = conversations.select(
        "conv_id", "turn",
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(key) % 20).alias("kind"),
    )
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("present"), F.explode(copies).alias("copy")
    ).drop("copy")


SEGMENT = (
    "conv_id {id}, part int, chunk int, whole boolean, turns array<bigint>, roles array<string>, texts array<string>"
)


def _segment_schema(id_type: pa.DataType) -> pa.Schema:
    lists = [("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
    return pa.schema([("conv_id", id_type), ("part", pa.int32()), ("chunk", pa.int32()), ("whole", pa.bool_()), *lists])


class _Batches:
    """Rows of a result, sent off before they are many or large."""

    def __init__(self, schema: pa.Schema, rows: int = 512, characters: int = 1 << 23):
        self.schema, self.limit, self.most = schema, rows, characters
        self.rows, self.held = [], 0

    def add(self, row: dict, characters: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += characters
        if len(self.rows) >= self.limit or self.held >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, self.schema)
        self.rows, self.held = [], 0


def segments(rows: DataFrame, params: RepairParams = RepairParams()) -> DataFrame:
    """Stored runs of rows in order.  A conversation is one ``whole`` segment, or pieces that are not.

    ``rows`` have ``conv_id, turn, role, text, present``; rows that are not present only keep their conversation.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role_start", "text_start", "hash", "place"]
    # Bounded keys: the bounds of the ranges pass through the driver.  Equal rows are told apart by their place.
    keyed = rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", "present",
        F.substring("role", 1, 32).alias("role_start"), F.substring("text", 1, 96).alias("text_start"),
        F.xxhash64("role", "text").alias("hash"),
    ).withColumn("place", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, out = TaskContext.get().partitionId(), 0, None
        current, characters, continued, first = None, 0, False, True
        for batch in batches:
            if out is None:
                out = _Batches(_segment_schema(batch.schema.field("conv_id").type))
            ids, columns = batch.column("conv_id").to_pylist(), [batch.column(c).to_pylist() for c in ("turn", "role", "text")]
            for conv, turn, role, text, present in zip(ids, *columns, batch.column("present").to_pylist()):
                same = current is not None and current["conv_id"] == conv
                full = same and (len(current["turns"]) >= params.rows or characters >= params.characters)
                if current is not None and (full or not same):
                    whole = not (first or continued or full)
                    yield from out.add(current | {"part": part, "chunk": chunk, "whole": whole}, characters)
                    chunk, continued = chunk + 1, full
                    first = first and same
                    current = None
                if current is None:
                    current, characters = {"conv_id": conv, "turns": [], "roles": [], "texts": []}, 0
                if present:
                    current["turns"].append(turn)
                    current["roles"].append(role)
                    current["texts"].append(text)
                    characters += len(text)
        if current is not None:
            yield from out.add(current | {"part": part, "chunk": chunk, "whole": False})
            yield from out.flush()

    return keep_table(ranged.select("conv_id", "turn", "role", "text", "present").mapInArrow(cut, SEGMENT.format(id=kind)), "segments")[0]


# -- repair -----------------------------------------------------------------------

PLAN = "cost bigint, audit string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
_PLAN = [(name, pa.string() if name == "audit" else pa.int64()) for name in ("cost", "audit", "gaps", "blank", "duplicate", "truncated", "illegal")]


def _planned(weight: Weight, counts: Counts) -> dict:
    shown = {name: getattr(counts, name) for name in ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal")}
    return {"cost": weight[0], "audit": weight[1]} | shown


def _read(batch: pa.RecordBatch) -> Iterator[tuple[dict, list[tuple[str, str]]]]:
    for row in batch.to_pylist():
        yield row, list(zip(row["roles"], row["texts"]))


def _plan_whole(found: DataFrame) -> DataFrame:
    """Whole conversations: the plan, and ``lines``, the repaired turns."""
    kind = found.schema["conv_id"].dataType.simpleString()

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
            out = _Batches(pa.schema([("conv_id", batch.schema.field("conv_id").type), *_PLAN, ("lines", lines)]))
            for row, turns in _read(batch):
                wrong = faults(turns)
                initials = [role[:1] for role, _ in turns]
                weight = lightest(list(zip(initials, wrong)), ACCEPTED, [START])[START]
                kept = [dict(zip(("edit", "role", "text"), line)) for line in apply_edits(weight[1], START, turns)]
                shown = _planned(weight, Counts.of(row["turns"], initials, wrong))
                yield from out.add({"conv_id": row["conv_id"], "lines": kept} | shown, sum(len(t) for _, t in turns))
            yield from out.flush()

    columns = found.select("conv_id", "turns", "roles", "texts")
    return columns.mapInArrow(plan, f"conv_id {kind}, {PLAN}, lines array<struct<edit string, role string, text string>>")


def _repeats(pieces: DataFrame) -> DataFrame:
    """``part, chunk, repeats``: places in a piece of rows that occurred earlier in their conversation."""
    place = (F.col("part").cast("bigint") * (1 << 43)) + (F.col("chunk").cast("bigint") * MOST_ROWS) + F.col("at")
    told = F.to_json(F.struct("conv_id", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text")))
    rows = pieces.select("conv_id", "part", "chunk", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "turn"))
    rows = rows.select("part", "chunk", "at", place.alias("place"), F.sha2(told, 256).alias("digest"))
    firsts = rows.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    later = attach(rows, firsts.select("digest", "first"), "digest", F.col("place")).where(F.col("place") > F.col("first"))
    return later.groupBy("part", "chunk").agg(F.collect_list("at").alias("repeats"))


_COUNTS = [(f, pa.int64()) for f in ("blank", "duplicate", "truncated", "illegal", "turns", "least", "greatest")]
_COUNTS += [("first", pa.string()), ("last", pa.string())]
_BEST = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("states", pa.string())]))
PIECE = (
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, least bigint, greatest bigint, "
    "first string, last string, "
    "best array<struct<start int, end int, cost bigint, audit string, states string>>"
)


def _piece_row(piece: Piece) -> dict:
    best = [dict(zip(("start", "end", "cost", "audit", "states"), (*ends, *made))) for ends, made in piece.best.items()]
    return {name: getattr(piece.counts, name) for name, _ in _COUNTS} | {"best": best}


def _row_piece(row: dict) -> Piece:
    counts = Counts(**{name: row[name] for name, _ in _COUNTS})
    return Piece(counts, {(b["start"], b["end"]): (b["cost"], b["audit"], b["states"]) for b in row["best"]})


def _deduce_pieces(pieces: DataFrame) -> DataFrame:
    """Every piece between all pairs of states."""
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def deduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [("conv_id", batch.schema.field("conv_id").type), ("part", pa.int32()), ("chunk", pa.int32())]
            out = _Batches(pa.schema([*keys, *_COUNTS, ("best", _BEST)]), rows=64)
            for row, turns in _read(batch):
                repeats = set(row["repeats"] or ())
                wrong = faults(turns, repeats.__contains__)
                initials = [role[:1] for role, _ in turns]
                piece = Piece(Counts.of(row["turns"], initials, wrong))
                for end in WANTED:
                    for start, weight in lightest(list(zip(initials, wrong)), [end], WANTED).items():
                        piece.best[start, end] = (*weight, f"{row['part']}.{row['chunk']}.{start}.{end},")
                yield from out.add({"conv_id": row["conv_id"], "part": row["part"], "chunk": row["chunk"]} | _piece_row(piece))
            yield from out.flush()

    return pieces.mapInArrow(deduce, f"conv_id {kind}, part int, chunk int, {PIECE}")


def _join_pieces(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of each key joined in order, as a stream over sorted rows."""
    kinds = {"conv_id": pieces.schema["conv_id"].dataType.simpleString(), "part": "int"}
    order = ["conv_id", "part", *(["chunk"] if "chunk" in pieces.columns else [])]
    dealt = pieces.repartition(*keys).sortWithinPartitions(*order)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, out = None, None, None
        for batch in batches:
            if out is None:
                columns = [(k, batch.schema.field(k).type) for k in keys]
                out = _Batches(pa.schema([*columns, *_COUNTS, ("best", _BEST)]), rows=64)
            for row in batch.to_pylist():
                found = tuple(row[k] for k in keys)
                if total is not None and found != key:
                    yield from out.add(dict(zip(keys, key)) | _piece_row(total))
                    total = None
                piece = _row_piece(row)
                key, total = found, piece if total is None else total.then(piece)
        if total is not None:
            yield from out.add(dict(zip(keys, key)) | _piece_row(total))
            yield from out.flush()

    return dealt.mapInArrow(join, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {PIECE}")


def _plan_pieces(pieces: DataFrame) -> DataFrame:
    """Conversations in pieces: the plan, and ``states``, which states each piece is entered and left in."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    joined = _join_pieces(_join_pieces(_deduce_pieces(pieces), ["conv_id", "part"]), ["conv_id"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Batches(pa.schema([("conv_id", batch.schema.field("conv_id").type), *_PLAN, ("states", pa.string())]))
            for row in batch.to_pylist():
                piece = _row_piece(row)
                cost, audit, states = min(piece.best[START, end] for end in ACCEPTED if (START, end) in piece.best)
                shown = _planned((cost, audit), piece.counts)
                yield from out.add({"conv_id": row["conv_id"], "states": states} | shown)
            yield from out.flush()

    return joined.mapInArrow(choose, f"conv_id {kind}, {PLAN}, states string")


def _piece_lines(pieces: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired turns of every piece, ``lines``, by the states that its conversation's plan gives it."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    state = F.split("state", r"\.")
    states = plans.select(F.explode(F.split(F.rtrim("states", F.lit(",")), ",")).alias("state")).select(
        *[state[i].cast("int").alias(name) for i, name in enumerate(("part", "chunk", "start", "end"))]
    )

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
            keys = [("conv_id", batch.schema.field("conv_id").type), ("part", pa.int32()), ("chunk", pa.int32())]
            out = _Batches(pa.schema([*keys, ("lines", lines)]), rows=64)
            for row, turns in _read(batch):
                wrong = faults(turns, set(row["repeats"] or ()).__contains__)
                found = list(zip((role[:1] for role, _ in turns), wrong))
                audit = lightest(found, [row["end"]], [row["start"]])[row["start"]][1]
                kept = [dict(zip(("edit", "role", "text"), line)) for line in apply_edits(audit, row["start"], turns)]
                key = {k: row[k] for k in ("conv_id", "part", "chunk")}
                yield from out.add(key | {"lines": kept}, sum(len(t) for _, t in turns))
            yield from out.flush()

    entered = pieces.join(states, ["part", "chunk"]).select("conv_id", "part", "chunk", "roles", "texts", "repeats", "start", "end")
    return entered.mapInArrow(
        repair, f"conv_id {kind}, part int, chunk int, lines array<struct<edit string, role string, text string>>"
    )


def _hash_pieces(lines: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of conversations in pieces, as a stream over sorted pieces."""
    kind = lines.schema["conv_id"].dataType.simpleString()
    text = F.transform("lines", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    dealt = lines.select("conv_id", "part", "chunk", text.alias("lines")).repartition("conv_id")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, total, begun = None, None, None, False
        for batch in batches:
            if out is None:
                out = _Batches(pa.schema([("conv_id", batch.schema.field("conv_id").type), ("repaired_sha256", pa.string())]))
            for row in batch.to_pylist():
                if total is None or row["conv_id"] != key:
                    if total is not None:
                        yield from out.add({"conv_id": key, "repaired_sha256": total.hexdigest()})
                    key, total, begun = row["conv_id"], hashlib.sha256(), False
                for line in row["lines"]:
                    total.update((("\n" if begun else "") + line).encode("utf-8", "surrogatepass"))
                    begun = True
        if total is not None:
            yield from out.add({"conv_id": key, "repaired_sha256": total.hexdigest()})
            yield from out.flush()

    ordered = dealt.sortWithinPartitions("conv_id", "part", "chunk").select("conv_id", "lines")
    return ordered.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


REPORT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@dataclass(frozen=True)
class Repaired:
    """``report``: a row per conversation.  ``turns``: the repaired turns, in runs that ``part, chunk`` and their places order."""

    report: DataFrame
    turns: DataFrame


def repair(rows: DataFrame, params: RepairParams = RepairParams()) -> Repaired:
    """Counts faults and repairs; runs the jobs that store segments and, for conversations in pieces, the plan."""
    cut = segments(rows, params)
    pieces = cut.where("NOT whole")
    marked, _ = keep_table(pieces.join(_repeats(pieces), ["part", "chunk"], "left"), "pieces")
    plans, _ = keep_table(_plan_pieces(marked), "plans")
    lines = _piece_lines(marked, plans)

    whole = _plan_whole(cut.where("whole"))
    said = F.array_join(F.transform("lines", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    in_pieces = plans.join(
        _hash_pieces(lines).withColumnRenamed("conv_id", "hashed"), F.col("conv_id").eqNullSafe(F.col("hashed"))
    )
    report = whole.withColumn("repaired_sha256", F.sha2(said, 256)).select(*REPORT).union(in_pieces.select(*REPORT))
    runs = whole.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("chunk"), "lines").union(lines)
    turns = runs.select("conv_id", "part", "chunk", F.posexplode("lines").alias("place", "line"))
    return Repaired(report, turns.select("conv_id", "part", "chunk", "place", "line.*"))


def oracle() -> str:
    """The same by recursion over the turns: per state the least (cost, audit, repaired text) so far."""
    gap = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def edit(state: str, cost: str, letter: str, line: str | None = None) -> str:
        text = f"{state}.t" if line is None else f"{state}.t || CASE WHEN {state}.t = '' THEN '' ELSE chr(10) END || {line}"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {text}}}"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    # States as q0 to q3; before a turn and at the end a user or an assistant turn may be inserted.
    user = least("q2", *[edit(f"q{q}", str(INSERT), "I", "'user:'") for q in (0, 1, 3)])
    assistant = least("q3", edit("q2", str(INSERT), "I", "'assistant:'"))
    none = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"

    def keep(state: int, initial: str) -> str:
        return f"CASE WHEN usable AND initial = '{initial}' THEN {edit(f'q{state}', 'more', 'K', chr(114) + '.line')} ELSE {none} END"

    def rerole(state: int, role: str) -> str:
        made = edit(f"q{state}", f"more + {REROLE}", "R", f"'{role}:' || r.text")
        return f"CASE WHEN usable THEN {made} ELSE {none} END"

    into_user = [f(q) for q in (0, 1, 3) for f in (lambda q: keep(q, "u"), lambda q: rerole(q, "user"))]
    return f"""
WITH RECURSIVE crc AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS told,
         conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text
  FROM conversations
),
kinds AS (
  SELECT *, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(told, ''), lambda c: ascii(c)::BIGINT)),
    lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS kind
  FROM crc
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(2) copies(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)
),
placed AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, turn, role, text, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         rtrim(text, {gap}) AS stripped
  FROM damaged
),
faulty AS (
  SELECT *, CASE WHEN stripped = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(stripped, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
),
rows_ AS (
  SELECT conv, i, initial, text, role || ':' || text AS line, fault NOT IN ('blank', 'duplicate') AS usable,
         CASE WHEN fault = 'truncated' THEN {UNFINISHED} ELSE 0 END AS more
  FROM faulty
),
counts AS (
  SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv ORDER BY i) AS before FROM faulty) GROUP BY conv
),
walk AS (
  SELECT conv, n, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS q0, {none} AS q1, {none} AS q2, {none} AS q3 FROM counts
  UNION ALL
  SELECT w.conv, w.n, w.i + 1,
         {edit("q0", str(DELETE), "D")},
         {least(edit("q1", str(DELETE), "D"), keep(0, "s"))},
         {least(edit("q2", str(DELETE), "D"), *into_user)},
         {least(edit("q3", str(DELETE), "D"), keep(2, "a"), rerole(2, "assistant"))}
  FROM (SELECT conv, n, i, q0, q1, q2, {assistant} AS q3
        FROM (SELECT conv, n, i, q0, q1, {user} AS q2, q3 FROM walk)) w
  JOIN rows_ r ON r.conv = w.conv AND r.i = w.i + 1
),
ends AS (
  SELECT conv, list_min([q0, {assistant}]) AS best
  FROM (SELECT conv, q0, {user} AS q2, q3 FROM walk WHERE i = n)
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv = coalesce(o.conv_id::VARCHAR, ' ')
LEFT JOIN ends e ON e.conv = coalesce(o.conv_id::VARCHAR, ' ')
"""

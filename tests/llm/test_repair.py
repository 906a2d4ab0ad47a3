import hashlib
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gapwise.llm import op11_repair as op
from gapwise.llm.queries import queries

PATTERN = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost string, audit int, part string, lines int"


def damaged(rows):
    """(conv, turn, role, text) after damage, by conversation in order."""
    found = {}
    for conv, turn, role, text in rows:
        kept = found.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        told = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(told.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept.extend([(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    return {c: sorted(r, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])) for c, r in found.items()}


def flags(turns):
    found = []
    for at, (role, text) in enumerate(turns):
        seen = re.findall(r"[^\x20\x09-\x0D]", text)
        if not seen:
            found.append("blank")
        elif (role, text) in turns[:at]:
            found.append("duplicate")
        else:
            found.append(None if seen[-1] in ".!?" else "truncated")
    return found


def cheapest(turns, wrong, inserts):
    """All choices of edits with up to so many insertions at each place; the least (cost, audit, lines)."""
    best = None
    made = [c for n in range(inserts + 1) for c in itertools.product(("user", "assistant"), repeat=n)]
    choices = []
    for at in range(len(turns) + 1):
        choices.append([("I" * len(c), 3 * len(c), [(r, "") for r in c]) for c in made])
        if at < len(turns):
            (role, text), fault = turns[at], wrong[at]
            options = [("D", 4, [])]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                options += [("K", more, [(role, text)])] if role[:1] else []
                options += [("R", 3 + more, [(r, text)]) for r in ("user", "assistant")]
            choices.append(options)
    for chosen in itertools.product(*choices):
        lines = [line for _, _, part in chosen for line in part]
        if PATTERN.fullmatch("".join(role[:1] for role, _ in lines)):
            found = (sum(c for _, c, _ in chosen), "".join(a for a, _, _ in chosen), lines)
            best = found if best is None or found[:2] < best[:2] else best
    return best


def expected(rows, inserts=1):
    report = set()
    for conv, kept in damaged(rows).items():
        turns = [(role, text) for _, role, text in kept]
        wrong = flags(turns)
        cost, audit, lines = cheapest(turns, wrong, inserts)
        known = {t for t, _, _ in kept if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        counts = [wrong.count(f) for f in ("blank", "duplicate", "truncated")]
        report.add((conv, gaps, *counts, illegal, cost, audit, digest))
    return report


ROLES = st.sampled_from(["system", "user", "assistant", "tool", ""])
TURNS = st.lists(st.tuples(ROLES, st.sampled_from(["a.", "b!", "c", " ", "", "a.\n"])), max_size=3)


@settings(max_examples=150, deadline=None)
@given(TURNS)
def test_lightest_is_the_cheapest_of_all_edits(turns):
    wrong = op.faults(turns)
    assert wrong == flags(turns)
    found = op.lightest([(r[:1], f) for r, f in zip([r for r, _ in turns], wrong)], op.ACCEPTED, [op.START])[op.START]
    cost, audit, lines = cheapest(turns, wrong, 2)
    assert found == (cost, audit)
    assert [(r, t) for _, r, t in op.apply_edits(audit, op.START, turns)] == lines


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(ROLES, st.sampled_from(["a.", "b!", "c", " "])), max_size=24), st.integers(1, 7))
def test_pieces_join_to_the_whole(turns, size):
    wrong = op.faults(turns)
    rows = [(r[:1], f) for (r, _), f in zip(turns, wrong)]
    numbers = [None if n < 2 else n // 3 for n in range(len(turns))]
    total = op.Piece(op.Counts(), {(q, q): (0, "", "") for q in op.WANTED})
    for at in range(0, len(rows), size):
        piece = op.Piece(op.Counts.of(numbers[at : at + size], [i for i, _ in rows[at : at + size]], wrong[at : at + size]))
        for end in op.WANTED:
            for start, weight in op.lightest(rows[at : at + size], [end], op.WANTED).items():
                piece.best[start, end] = (*weight, f"{at}")
        total = total.then(piece)
    assert total.counts == op.Counts.of(numbers, [i for i, _ in rows], wrong)
    found = min(total.best[op.START, end][:2] for end in op.ACCEPTED if (op.START, end) in total.best)
    assert found == op.lightest(rows, op.ACCEPTED, [op.START])[op.START]


ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 2, "tool", "x"),
    (2, None, "user", "No turn."), (2, 5, "assistant", "Late."), (2, 9, "system", "What?"),
    (3, None, None, None), (None, None, None, None), (None, 1, "user", "No id."), (None, 2, "assistant", "None."),
    (4, 7, "", "No role."), (5, 3, "user", "w" * 300_000 + "."), (5, 4, "assistant", " "), (6, 0, "User", "Case."),
    (7, -3, "assistant", "\x00."), (7, 3, "\U0001f600", "rép\U0001f600"),
]


def report(spark, turns, **bounds):
    table = spark.createDataFrame([(*r, "c", 1, "p", 2) for r in turns], SCHEMA)
    found = op.repair(op.damage(table), op.RepairParams(**bounds))
    return found, [tuple(r[c] for c in op.REPORT) for r in found.report.collect()]


@pytest.mark.parametrize("bounds", [{}, {"rows": 1}, {"characters": 1}], ids=["whole", "row by row", "by characters"])
def test_odd_conversations(spark, bounds):
    _, rows = report(spark, ODD, **bounds)
    assert len(rows) == len(set(rows)) and set(rows) == expected(ODD)


def test_no_conversations(spark):
    found, rows = report(spark, [])
    assert rows == [] and found.turns.count() == 0


def test_conversations_that_are_dropped_stay(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    _, rows = report(spark, [(c, 0, "user", "Hi.") for c in gone])
    assert set(rows) == {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone}


def test_a_third_of_the_rows_in_one_conversation(spark):
    """Cut into pieces, with repeats far apart; as its rows deduced in one go."""
    hot = [(0, t, ("user", "assistant", "tool")[t % 7 % 3], f"text {t % 211}" + ".?x"[t % 3]) for t in range(3000)]
    rows = hot + [(c, t, "user", f"{c} {t}.") for c in range(1, 1001) for t in range(6)]
    found, got = report(spark, rows, rows=64)
    by_conv = {r[0]: r for r in got}
    kept = damaged(hot)[0]
    turns = [(r, t) for _, r, t in kept]
    wrong = op.faults(turns)
    cost, audit = op.lightest([(r[:1], f) for (r, _), f in zip(turns, wrong)], op.ACCEPTED, [op.START])[op.START]
    lines = [(r, t) for _, r, t in op.apply_edits(audit, op.START, turns)]
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    assert by_conv[0][6:] == (cost, audit, digest) and by_conv[0][3] == wrong.count("duplicate") > 1000
    runs = found.turns.where("conv_id = 0").orderBy("part", "chunk", "place").collect()
    assert [(r["role"], r["text"]) for r in runs] == lines
    assert len(got) == 1001


def test_query_against_brute_force(spark, tiny_dir):
    """Conversations short enough to try all edits; the SQL covers the others."""
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    short = {c for c, kept in damaged(rows).items() if len(kept) <= 3}
    found = queries()["op11_conversation_repair"](spark, tiny_dir)
    got = {tuple(r[c] for c in op.REPORT) for r in found.collect()}
    assert {r[0] for r in got} == {r[0] for r in rows} and len(short) > 2
    assert {r for r in got if r[0] in short} == expected([r for r in rows if r[0] in short], 2)

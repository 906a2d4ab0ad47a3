"""Near-duplicate classes by order MinHash, verified by banded alignment.

A text is a sequence of words; its k-mers are labelled with their occurrence number.  Each of several hash
functions picks the ``picked`` smallest k-mers and keeps them in text order, so texts meet in a bucket
only if they share k-mers in the same order: a signal for a small edit distance, not only for shared words.
Members of a bucket are linked to leaders, a link counts if the aligned texts are similar enough,
and linked texts form classes.  Members whom the leaders left in different classes are then compared with
each other, so every two similar texts of a bucket end in one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import SALTS, attach, discard, keep_table

#: Words of a text short enough to try every choice of the words that differ.
_SHORT = 14


@dataclass(frozen=True)
class OrderMinHashParams:
    """k: words in a k-mer.  picked: k-mers in a sketch.  sketches: hash functions per text.
    singles: further hash functions with one pick, for texts of fewer than ``few`` words.
    similarity: least 1 - edits / words of the longer text, over whole words, lower-cased.
    """

    k: int = 3
    picked: int = 2
    sketches: int = 40
    singles: int = 24
    few: int = 64
    similarity: float = 0.8


# -- words and sketches ------------------------------------------------------------------


class _Hashes(dict):
    """64-bit hash of a word, remembered up to a bound; a plain memo."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) < 300_000:
            self[word] = found
        return found


_HASHES = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word; none for a missing text."""
    if not text:
        return np.empty(0, np.uint64)
    found = text.lower().encode("utf-8", "surrogatepass").split()  # of bytes, at space and TAB to CR alone
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def labelled_kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-mer with its occurrence number; a shorter text is one k-mer."""
    k = min(k, len(words))
    if k == 0:
        return words
    found = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        found = found * np.uint64(0x100000001B3) + words[j : j + len(found)]
    found = _mix(found)
    order = np.argsort(found, kind="stable")
    ordered = found[order]
    same = np.concatenate(([False], ordered[1:] == ordered[:-1]))
    if same.any():
        place = np.arange(len(found), dtype=np.uint64)
        starts = np.maximum.accumulate(np.where(same, np.uint64(0), place))
        again = _mix(ordered + (place - starts) * np.uint64(0xD6E8FEB86659FD93))
        found[order] = np.where(same, again, ordered)  # first occurrences are the same in any text
    return found


def _picked(kmers: np.ndarray, seeds: np.ndarray, picked: int) -> np.ndarray:
    rows = np.arange(len(seeds))
    ranks = kmers[None, :] * (seeds | np.uint64(1))[:, None]
    picks = []
    for _ in range(min(picked, len(kmers))):
        at = ranks.argmin(axis=1)
        ranks[rows, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
        picks.append(at)
    chosen = kmers[np.sort(np.stack(picks), axis=0)]  # in text order
    key = seeds
    for row in chosen:
        key = _mix(key + row)
    return key


def _left_out(words: np.ndarray, limit: int) -> np.ndarray:
    """A bucket for the words in order with up to ``limit`` left out, each choice of them."""
    found = []
    for kept in range(max(1, len(words) - limit), len(words) + 1):
        chosen = words[np.array(list(combinations(range(len(words)), kept)))]
        key = np.full(len(chosen), kept, np.uint64)
        for at in range(kept):
            key = _mix(key + chosen[:, at])
        found.append(key)
    return np.unique(np.concatenate(found))


def sketch(words: np.ndarray, params: OrderMinHashParams) -> list[int]:
    """Signed 64-bit buckets, one per hash function; none for a text without words.

    Short texts have more.  Those of up to 14 words also have one for each choice of the words that may be left
    out: similar texts have a common subsequence as long as that, so two such texts always meet.
    """
    kmers = labelled_kmers(words, params.k)
    if len(kmers) == 0:
        return []
    seeds = _mix(np.arange(params.sketches + params.singles).astype(np.uint64) + np.uint64(1))
    found = [_picked(kmers, seeds[: params.sketches], params.picked)]
    if len(words) < params.few and params.singles:
        found.append(_picked(kmers, seeds[params.sketches :], 1))
    limit = int(len(words) * (1 - params.similarity) + 1e-9)
    if len(words) <= _SHORT and limit <= 2:
        found.append(_left_out(words, limit))
    return np.concatenate(found).view(np.int64).tolist()


#: Least and most bins of a text's word counts; most members of a bucket that one task compares with as many others.
_BINS, _MOST_BINS, _BLOCK = 128, 1024, 2048


def word_counts(words: np.ndarray) -> bytes:
    """How many words fall in each bin, at most 255; as many bins as words, in doublings."""
    bins = _BINS
    while bins < min(len(words), _MOST_BINS):
        bins *= 2
    found = np.bincount((words % np.uint64(bins)).astype(np.int64), minlength=bins)
    return np.minimum(found, 255).astype(np.uint8).tobytes()


def _folded(counts: np.ndarray, bins: int) -> np.ndarray:
    """Rows of word counts in fewer bins, as if they had been counted in those."""
    if counts.shape[1] == bins:
        return counts
    return np.minimum(counts.reshape(len(counts), -1, bins).sum(axis=1, dtype=np.uint16), 255).astype(np.uint8)


# -- alignment ------------------------------------------------------------------------------


#: Cells of the table of next differences, about 64 MB; wider bands are aligned row by row.
_CELLS = 16_000_000

#: Edits after which the whole table by bits costs less than more steps along diagonals; fewer for short texts.
_STEPS = 24


def _runs(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """For each i the first place from i on where a[i] and b[i + k] differ, or the end of the diagonal."""
    found = np.arange(len(a) + 1, dtype=np.int32)
    low, high = max(0, -k), min(len(a), len(b) - k)
    if high > low:
        own = found[low:high]
        next_one = np.where(a[low:high] != b[low + k : high + k], own, high)
        found[low:high] = np.minimum.accumulate(next_one[::-1])[::-1]
    return found


def _edits(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edit distance of a and b if it is at most ``limit``, else some number above it.

    Diagonal k is j = i + k.  With each further edit the diagonals of the band reach on: by a replaced, a
    deleted or an inserted word, and then as far as both texts agree.  Only diagonals from which the end is
    still near enough count, so near copies cost a few steps over a few diagonals.
    """
    n, m = len(a), len(b)
    end = m - n
    if abs(end) > limit:
        return limit + 1
    most = (limit + abs(end)) // 2 + 1
    below, above = min(most, n), min(most, m)
    room = min(max(8, abs(end)), max(below, above))
    table = np.empty((2 * room + 1, n + 1), np.int32)
    table[room] = _runs(a, b, 0)
    reach = np.full(2 * max(below, above) + 5, -(1 << 30), np.int64)
    middle = max(below, above) + 2
    reach[middle] = table[room][0]
    built = 0
    for edits in range(limit + 1):
        if reach[middle + end] >= n:
            return edits
        if edits == min(_STEPS, 2 + min(n, m) // 64) and (n + 1) * (m + 1) <= _BITS:
            return _by_bits(a, b)
        wide = edits + 1
        low, high = max(-wide, -below, end - (limit - wide)), min(wide, above, end + (limit - wide))
        if low > high:
            return limit + 1
        while built < max(-low, high):
            built += 1
            if built > room:
                if (4 * room + 1) * (n + 1) > _CELLS:
                    return _by_rows(a, b, limit, 2 * built)
                grown = np.empty((4 * room + 1, n + 1), np.int32)
                grown[room : 3 * room + 1] = table
                table, room = grown, 2 * room
            table[room + built], table[room - built] = _runs(a, b, built), _runs(a, b, -built)
        at = np.arange(low, high + 1)
        own = middle + at
        new = np.maximum(np.maximum(reach[own], reach[own + 1]) + 1, reach[own - 1])
        new = np.minimum(new, np.minimum(n, m - at))
        fit = new >= np.maximum(0, -at)
        new[fit] = table[room + at[fit], new[fit]]
        reach[own] = new
    return limit + 1


#: Cells of the whole table up to which it is done by bits; about two seconds.
_BITS = 2_000_000_000


def _by_bits(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of a and b, a column of the table at a time, its differences as the bits of whole numbers (Myers, Hyyro)."""
    if len(a) == 0:
        return len(b)
    places: dict[int, int] = {}
    bit = 1
    for word in a.tolist():
        places[word] = places.get(word, 0) | bit
        bit <<= 1
    full, last, found = bit - 1, bit >> 1, len(a)
    up, down = full, 0  # where the column rises and falls
    for word in b.tolist():
        equal = places.get(word, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        rise, fall = down | (full & ~(across | up)), up & across
        if rise & last:
            found += 1
        elif fall & last:
            found -= 1
        rise, fall = (rise << 1 | 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(vertical | rise)), rise & vertical
    return found


def _by_rows(a: np.ndarray, b: np.ndarray, limit: int, band: int) -> int:
    """The same, in bands that widen until the distance lies within."""
    while True:
        band = min(band, limit)
        found = _banded(a, b, band)
        if found <= band or band == limit:
            return found
        band *= 3


def _banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Edit distance of a and b if it is at most ``band``, else some number above it.

    Row by row over the diagonals -band to band; the insertions of a row are one running minimum.
    """
    n, m, far = len(a), len(b), len(a) + len(b) + 1
    width = 2 * band + 1
    slant = np.arange(width)
    padded = np.zeros(m + 2 * width, b.dtype)
    padded[width : width + m] = b
    row = np.where(slant >= band, slant - band, far)
    row[slant - band > m] = far
    for i in range(1, n + 1):
        # Cell (i, j) with j = i + slant - band compares a[i - 1] with b[j - 1].
        j = i - band + slant
        start = i - 1 - band + width
        differs = (padded[start : start + width] != a[i - 1]).astype(np.int64)
        new = row + differs
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new[(j < 1) | (j > m)] = far
        if 0 <= band - i:
            new[band - i] = i
        new = np.minimum.accumulate(new - slant) + slant
        new[(j < 0) | (j > m)] = far
        row = new
        if row.min() > band:
            return band + 1
    end = m - n + band
    return int(row[end]) if 0 <= end < width else far


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether 1 - edits / longer length reaches ``similarity``; two texts without words are."""
    longer = max(len(a), len(b))
    limit = int(longer * (1 - similarity) + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return False
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    front = int(differ[0]) if len(differ) else short
    a, b = a[front:], b[front:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    back = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - back], b[: len(b) - back]
    if max(len(a), len(b)) <= limit:
        return True
    if len(a) == len(b) and np.count_nonzero(a != b) <= limit:
        return True
    # Words that one text has more often than the other must be edited.
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    counts = np.bincount(place[: len(a)], minlength=len(names)) - np.bincount(
        place[len(a) :], minlength=len(names)
    )
    if max(counts[counts > 0].sum(), -counts[counts < 0].sum()) > limit:
        return False
    return _edits(a, b, limit) <= limit


# -- the job ----------------------------------------------------------------------------------


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _sketches(rows: DataFrame, params: OrderMinHashParams) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(word_hashes(t.as_py()), params) for t in batch.column("text")]
            yield pa.record_batch([batch.column("digest"), pa.array(found, pa.list_(pa.int64()))], names=["digest", "sketch"])

    return rows.mapInArrow(run, "digest binary, sketch array<bigint>")


def _profiles(rows: DataFrame) -> DataFrame:
    """Number of words and word counts by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [word_hashes(t.as_py()) for t in batch.column("text")]
            words, counts = [len(t) for t in texts], [word_counts(t) for t in texts]
            yield pa.record_batch(
                [batch.column("digest"), pa.array(words, pa.int64()), pa.array(counts, pa.binary())],
                names=["digest", "words", "counts"],
            )

    found = rows.mapInArrow(run, "digest binary, words bigint, counts binary").groupBy("digest")
    return found.agg(F.any_value("words").alias("words"), F.any_value("counts").alias("counts"))


#: Hashes of words that a task remembers, 16 MB.
_HELD = 2_000_000


def _verified(pairs: DataFrame, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}  # most texts are in several pairs
        room = 0

        def words(digest: pa.Scalar, text: pa.Scalar) -> np.ndarray:
            nonlocal room
            found = held.get(key := digest.as_py())
            if found is None:
                found = word_hashes(text.as_py())
                room += len(found)
                if room > _HELD:
                    held.clear()
                    room = len(found)
                held[key] = found
            return found

        for batch in batches:
            a, b, text_a, text_b = (batch.column(c) for c in ("a", "b", "text_a", "text_b"))
            kept = [similar(words(a[i], text_a[i]), words(b[i], text_b[i]), similarity) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.mapInArrow(run, "a binary, b binary")


def candidate_links(sketched: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Distinct (a, b) to verify, from ``digest`` and ``sketch``: as many per bucket as it has members.

    Members are dealt to salts by their digest.  Within a salt each goes to the salt's leader, the least
    digest; leaders go to the least digest of the bucket.  Nothing grows with a bucket but the number of its links.
    Also the members of shared buckets, for ``unsettled``, and the paths of both.
    """
    slots = sketched.select("digest", F.explode(F.array_distinct("sketch")).alias("bucket"))
    shared = slots.groupBy("bucket").agg(F.min("digest").alias("top"), F.max("digest").alias("end"))
    tops, p1 = keep_table(shared.where("top < end").select("bucket", "top"), "omh-buckets")
    salt = F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int").alias("salt")
    members, p2 = keep_table(slots.join(tops, "bucket").select("bucket", salt, "digest", "top"), "omh-members")
    led = members.groupBy("bucket", "salt").agg(F.min("digest").alias("lead"), F.min("top").alias("top"))
    leads, p3 = keep_table(led, "omh-leaders")
    within = members.drop("top").join(leads, ["bucket", "salt"]).select(F.col("digest").alias("a"), F.col("lead").alias("b"))
    across = leads.select(F.col("lead").alias("a"), F.col("top").alias("b"))
    links, p4 = keep_table(within.union(across).where("a != b").distinct(), "omh-links")
    discard(sketched.sparkSession, [p1, p3])
    return links, members.select("bucket", "digest"), [p2, p4]


def unsettled(members: DataFrame, label: DataFrame) -> tuple[DataFrame, list[str]]:
    """Members, with ``label`` and number of ``blocks``, of the buckets that have members of several classes.

    Buckets of two are left out: their members were compared.  Of buckets with the same members one stays; they are
    known by two 64-bit hashes.
    """
    of = label.select(F.col("node").alias("digest"), "label")
    own, p1 = keep_table(
        members.join(of, "digest", "left").select("bucket", "digest", F.coalesce("label", "digest").alias("label")),
        "omh-own",
    )
    sizes = own.groupBy("bucket").agg(
        F.count("*").alias("size"),
        F.min("label").alias("x"),
        F.max("label").alias("y"),
        F.bit_xor(F.xxhash64("digest")).alias("one"),
        F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("two"),
    )
    alike = sizes.where("size > 2 and x < y").groupBy("size", "one", "two").agg(F.min("bucket").alias("bucket"))
    mixed, p2 = keep_table(alike.select("bucket", F.ceil(F.col("size") / _BLOCK).cast("int").alias("blocks")), "omh-mixed")
    left, p3 = keep_table(attach(own, mixed, "bucket", F.col("digest")).where("blocks is not null"), "omh-left")
    return left, [p1, p2, p3]


def _blocks(left: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each bucket cut into blocks of about ``_BLOCK``, and each two of them (also i = j) one row with its ``members``."""
    full = left.join(profiles, "digest")
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    dealt = full.withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    member = F.struct("block", "digest", "label", "words", "counts")
    by = ["bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    return dealt.groupBy(*by).agg(F.collect_list(member).alias("members"))


def _near(members: pa.StructArray, across: bool, similarity: float, most: int) -> tuple[list[tuple[bytes, bytes]], bool]:
    """Pairs of different classes that may be similar, and whether a member has more than ``most`` of them.

    Of so many each member takes those that come first in an order that changes with ``most``, so large groups
    meet at a few members.  Texts are left out only if the words that one has more often than the other exceed
    the edits allowed, which bins and full bins can only understate: by few bins first, then by as many as both have.
    """
    digests, codes = members.field("digest").to_pylist(), {}
    lead = np.frombuffer(b"".join(d[:8] for d in digests), np.uint64)
    order = np.argsort(_mix(lead ^ np.uint64(most)), kind="stable")
    label = np.array([codes.setdefault(x, len(codes)) for x in members.field("label").to_pylist()])[order]
    block = members.field("block").to_numpy()[order]
    words = members.field("words").to_numpy()[order]
    counts = [np.frombuffer(c, np.uint8) for c in members.field("counts").to_pylist()]
    bins = np.array([len(c) for c in counts])[order]
    few, place, many = np.empty((len(order), _BINS), np.uint8), np.empty(len(order), np.int64), {}
    for size in np.unique(bins).tolist():
        rows = np.flatnonzero(bins == size)
        many[size] = np.stack([counts[i] for i in order[rows]])
        few[rows], place[rows] = _folded(many[size], _BINS), np.arange(len(rows))

    total = few.sum(axis=1, dtype=np.int64)

    def surplus(own: np.ndarray, others: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return np.maximum(others, own).sum(axis=1, dtype=np.int64) - np.minimum(sums, own.sum(dtype=np.int64))

    found, cut = [], False
    for x in range(1, len(order)):
        fit = label[:x] != label[x]
        if across:
            fit &= block[:x] != block[x]
        at = np.flatnonzero(fit)
        limit = (np.maximum(words[at], words[x]) * (1 - similarity) + 1e-9).astype(np.int64)
        close = np.abs(words[at] - words[x]) <= limit
        at, limit = at[close], limit[close]
        close = surplus(few[x], few[at], total[at]) <= limit
        at, limit = at[close], limit[close]
        close, common = np.ones(len(at), bool), np.minimum(bins[at], bins[x])
        for size in np.unique(bins[at][common > _BINS]).tolist():
            rows, least = np.flatnonzero(bins[at] == size), min(size, bins[x])
            own = _folded(many[bins[x]][place[x]][None], least)[0]
            theirs = _folded(many[size][place[at[rows]]], least)
            close[rows] = surplus(own, theirs, theirs.sum(axis=1, dtype=np.int64)) <= limit[rows]
        at = at[close]
        cut |= len(at) > most
        for y in at[:most]:
            a, b = digests[order[x]], digests[order[y]]
            found.append((max(a, b), min(a, b)))
    return found, cut


def pairs_apart(blocks: DataFrame, similarity: float, most: int) -> DataFrame:
    """(a, b) to verify from ``_blocks``, b the lesser; a null pair with its ``bucket`` for each block that has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, i, j, members in zip(*(batch.column(c) for c in ("bucket", "i", "j", "members"))):
                found, cut = _near(members.values, i.as_py() != j.as_py(), similarity, most)
                found = [(None, a, b) for a, b in found] + [(bucket.as_py(), None, None)] * cut
                yield pa.record_batch(
                    [pa.array([p[e] for p in found], k) for e, k in enumerate((pa.int64(), pa.binary(), pa.binary()))],
                    names=["bucket", "a", "b"],
                )

    return blocks.select("bucket", "i", "j", "members").mapInArrow(run, "bucket bigint, a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node it is connected with, for all nodes of ``edges`` (a, b).

    Each round every node joins its least neighbour and edges are rewritten between what was joined, until
    none is left.  Tables of a round go to the shared folder, none comes to the driver.
    """
    spark = edges.sparkSession
    names, spent, label = edges.columns, [], None
    left = edges
    while True:
        ends = left.select(F.col(names[0]).alias("node"), F.col(names[1]).alias("other"))
        both = ends.union(ends.select(F.col("other").alias("node"), F.col("node").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("other"))
        step, path = keep_table(least.select("node", F.least("node", "other").alias("label")), "cc-step")
        spent.append(path)
        if label is None:
            label = step
        else:
            onward = step.select(F.col("node").alias("label"), F.col("label").alias("onward"))
            moved = attach(label, onward, "label", F.col("node"))
            label, path = keep_table(
                moved.select("node", F.coalesce("onward", "label").alias("label")), "cc-label"
            )
            spent.append(path)
        here = ends.select(F.col("node").alias("x"), F.col("other").alias("y"))
        for end, other in (("x", "y"), ("y", "x")):
            to = step.select(F.col("node").alias(end), F.col("label").alias("to"))
            here = attach(here, to, end, F.col(other)).select(F.col("to").alias(end), other)
        left, path = keep_table(here.where("x != y").distinct(), "cc-edges")
        spent.append(path)
        names = left.columns
        if left.isEmpty():
            break
    label, _ = keep_table(label, "cc")
    discard(spark, spent)
    return label


def _joined(label: DataFrame, edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """``label`` of ``components`` after further ``edges`` (a, b), from the classes that these connect alone."""
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    fresh = ends.join(label, "node", "left_anti").select("node", F.col("node").alias("label"))
    base, p1 = keep_table(label.unionByName(fresh), "omh-labels")
    of = base.join(ends, "node", "left_semi")
    between = edges.join(of.select(F.col("node").alias("a"), F.col("label").alias("x")), "a")
    between = between.join(of.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
    between, p2 = keep_table(between.where("x != y").select("x", "y").distinct(), "omh-between")
    onward = components(between).select(F.col("node").alias("label"), F.col("label").alias("onward"))
    moved = attach(base, onward, "label", F.col("node")).select("node", F.coalesce("onward", "label").alias("label"))
    found, _ = keep_table(moved, "omh-labels")
    return found, [p1, p2]


def _classes(docs: DataFrame, params: OrderMinHashParams) -> DataFrame:
    """``digest``, and of its class: id, size in rows, and the (id, digest) of the document that stays."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(_digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    sketched = _sketches(texts, params).groupBy("digest").agg(F.any_value("sketch").alias("sketch"))
    sketched, sketch_path = keep_table(sketched, "omh-sketches")

    def texts_of(digests: DataFrame) -> tuple[DataFrame, str]:
        """Rows of the digests alone; those are stored, so that Spark knows whether they are few enough to go to the texts."""
        wanted, path = keep_table(digests.distinct(), "omh-wanted")
        return texts.join(wanted, "digest", "left_semi"), path

    def verified(links: DataFrame) -> tuple[DataFrame, list[str]]:
        ends = links.select(F.col("a").alias("digest")).union(links.select(F.col("b").alias("digest")))
        rows, p1 = texts_of(ends)
        # One text per digest; both joins read the same shuffle.
        one = rows.groupBy("digest").agg(F.any_value("text").alias("text"))
        first = links.join(one.select(F.col("digest").alias("b"), F.col("text").alias("text_b")), "b")
        first = first.repartition(partitions, "a")  # short pairs take long to compare: not into a few tasks
        both = first.join(one.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a")
        found, p2 = keep_table(_verified(both.select("a", "b", "text_a", "text_b"), params.similarity), "omh-edges")
        return found, [p1, p2]

    tested, members, spent = candidate_links(sketched)
    discard(spark, [sketch_path])
    edges, paths = verified(tested)
    label = components(edges)
    spent += paths
    most, among, profiles = 8, members, None
    while True:
        left, paths = unsettled(among, label)
        spent += paths
        if profiles is None:  # later rounds have no other members
            rows, path = texts_of(left.select("digest"))
            profiles, profile_path = keep_table(_profiles(rows), "omh-profiles")
            spent += [path, profile_path]
        pairs, path = keep_table(pairs_apart(_blocks(left, profiles), params.similarity, most), "omh-apart")
        spent.append(path)
        todo, path = keep_table(
            pairs.where("a is not null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "omh-todo"
        )
        spent.append(path)
        if not todo.isEmpty():
            more, paths = verified(todo)
            spent += paths
            tested = tested.union(todo)
            if not more.isEmpty():
                label, paths = _joined(label, more)
                spent += paths
        again = pairs.where("a is null").select("bucket").distinct()
        if again.isEmpty():
            break
        among = left.select("bucket", "digest").join(again, "bucket", "left_semi")
        most *= 8
    discard(spark, spent)

    ids = docs.select("doc_id", _digest(F.col("text")).alias("digest"))
    first_id = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("stays")
    alike = ids.groupBy("digest").agg(first_id, F.count("*").alias("rows"))
    of = label.select(F.col("node").alias("digest"), "label")
    grouped, _ = keep_table(
        alike.join(of, "digest", "left").withColumn("label", F.coalesce("label", "digest")), "omh-texts"
    )
    whole = grouped.groupBy("label").agg(F.min("stays").alias("stays"), F.sum("rows").alias("class_size"))
    classes = attach(grouped.select("digest", "label"), whole, "label", F.col("digest"))
    return classes.select(
        "digest",
        F.col("stays.doc_id").alias("class_id"),
        "class_size",
        F.col("stays.digest").alias("stays_digest"),
    )


def near_duplicates(docs: DataFrame, params: OrderMinHashParams = OrderMinHashParams()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``class_id`` (least id of its class), ``class_size``, ``kept``.

    Texts that are equal are one node; nulls count as empty.  A text without words is like other texts only if
    equal.  A text shorter than a k-mer is one k-mer.  Missing ids come after all others; a class of only
    such documents has a null id.  ``kept`` marks the document that stays (all its rows, if it is repeated).
    An empty table gives an empty result.  Runs jobs when called.
    """
    classes, _ = keep_table(_classes(docs, params), "omh-classes")
    ids = docs.select("doc_id", _digest(F.col("text")).alias("digest"))
    found = attach(ids, classes, "digest", F.xxhash64("doc_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("stays_digest"))
    return found.select("doc_id", "class_id", "class_size", kept.alias("kept"))


def keep_one(docs: DataFrame, params: OrderMinHashParams = OrderMinHashParams()) -> DataFrame:
    """One row of each class, with the columns it came with: the least id, and of repeated rows any one."""
    classes = _classes(docs, params)
    stays, _ = keep_table(
        classes.where("digest = stays_digest").select(
            F.col("digest").alias("__digest"), F.col("class_id").alias("__id")
        ),
        "omh-kept",
    )
    own = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(*own, _digest(F.col("text")).alias("__digest"), F.xxhash64("doc_id").alias("__key"))
    chosen = marked.join(
        stays.withColumn("__key", F.xxhash64("__id")), ["__digest", "__key"]
    ).where(F.col("doc_id").eqNullSafe(F.col("__id")))
    return chosen.dropDuplicates(["__digest", "__key"]).select(*own)

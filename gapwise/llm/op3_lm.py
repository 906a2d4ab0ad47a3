"""Log-likelihood of documents under a gated recurrent language model trained here.

Spark counts all words of the training documents.  The most frequent become the model's own words; all others fall into
tail classes by their spelling, and within such a class a word has its share of the class's training tokens.
The network learns from all training documents: tasks train copies side by side, their parameters are
averaged by Spark, and the next round goes on from there.  Scoring carries the state through a document.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import discard, keep_table
from gapwise.llm.gru import Model, Shape, Trainer

#: The end of a document; no word is empty.
END = b""
_MARKS = b".,;:!?"
SCORED = (
    "row_id bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, model double, "
    "rest_words array<binary>, rest_counts array<bigint>"
)


@dataclass(frozen=True)
class LmParams:
    """head_words: words that the network knows.  lookup_words: counts of at most so many words go to every task, about
    20 bytes each; others are joined.  head_classes, tail_classes, hidden: sizes of the network.
    warm_tokens: one task first trains on about so many tokens, since copies average well only once they agree on
    what their units mean.  rounds: shares of the training documents per averaged round; they make up all of them.
    warm_lanes, lanes, window: running texts side by side, and steps that gradients go back.
    """

    head_words: int = 2048
    lookup_words: int = 200_000
    head_classes: int = 40
    tail_classes: int = 24
    hidden: int = 16
    warm_tokens: int = 400_000
    rounds: tuple[int, ...] = (1, 3)
    warm_rate: float = 0.01
    rate: float = 0.004
    warm_lanes: int = 64
    lanes: int = 512
    window: int = 16
    seed: int = 7


# -- words ---------------------------------------------------------------------------------------


def tokens_of(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z lower-cased, without the end."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def tail_class(word: bytes, classes: int) -> int:
    """By the last letters, which tell languages and kinds of words apart."""
    return zlib.crc32(word.rstrip(_MARKS)[-3:]) % classes


def _tail_class(word: str, classes: int) -> Column:
    """``tail_class`` of a column."""
    stem = F.rtrim(F.col(word).cast("string"), F.lit(_MARKS.decode())).cast("binary")
    return F.pmod(F.crc32(F.substring(stem, -3, 3)), F.lit(classes)).cast("int")


def _count_words(docs: DataFrame) -> DataFrame:
    """``word`` and its count ``c`` over all rows, the end of a document included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            found = pa.record_batch(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
            )
            counts.clear()
            return found

        for batch in batches:
            for text in batch.column("text"):
                counts.update(tokens_of(text.as_py()))
                counts[END] += 1
                if len(counts) > 200_000:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


# -- the vocabulary --------------------------------------------------------------------------------


class Vocabulary:
    """What every task knows about words; ``lookup`` is bounded by the parameters.

    words: the looked-up words, the head words first, by falling count.  The end is always a head word.
    unknown: training tokens that the unknown words of each tail class are taken to stand for.
    mass: training tokens of each tail class, unknown included.
    """

    def __init__(self, words: list[tuple[bytes, int]], singles: list[int], tails: list[int], n: int, v: int, p: LmParams):
        self.params, self.n, self.v = p, n, v
        ordered = sorted(words, key=lambda x: (x[0] != END, -x[1], x[0]))
        if not ordered or ordered[0][0] != END:
            ordered.insert(0, (END, 0))
        self.words = [w for w, _ in ordered]
        self.counts = np.array([c for _, c in ordered], np.float64)
        self.head = min(p.head_words, len(ordered))
        self.unknown = np.maximum(0.5, np.array(singles, np.float64))
        head_tail = np.zeros(p.tail_classes)  # words of the head leave their spelling's class
        head_single = np.zeros(p.tail_classes)
        for w, c in ordered[: self.head]:
            if w != END:
                head_tail[tail_class(w, p.tail_classes)] += c
                head_single[tail_class(w, p.tail_classes)] += c == 1
        self.unknown = np.maximum(0.5, self.unknown - head_single)
        self.known_mass = np.array(tails, np.float64) - head_tail
        self.mass = self.known_mass + self.unknown

    def shape(self) -> Shape:
        """Head classes of about equal counts: the most frequent words are alone in theirs."""
        counts = self.counts[: self.head] + 1
        reached = np.cumsum(counts) / counts.sum() * self.params.head_classes
        bounds = [0]
        for i in range(1, self.head):
            if int(reached[i - 1]) > int(reached[i - 2] if i > 1 else 0):
                bounds.append(i)
        return Shape(self.params.hidden, (*bounds, self.head), self.params.tail_classes)

    def symbol_counts(self) -> np.ndarray:
        return np.concatenate([self.counts[: self.head], self.mass])

    def places(self) -> _Places:
        return _Places(self)


class _Places(dict):
    """Place of a word among those looked up, or -1 minus its tail class."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__((w, i) for i, w in enumerate(vocabulary.words))
        self.tails = vocabulary.params.tail_classes

    def __missing__(self, word: bytes) -> int:
        return -1 - tail_class(word, self.tails)


def _symbols(vocabulary: Vocabulary) -> np.ndarray:
    """Symbol of each looked-up word, then of each tail class from the last to the first, for negative places."""
    own = [i if i < vocabulary.head else vocabulary.head + tail_class(w, vocabulary.params.tail_classes) for i, w in enumerate(vocabulary.words)]
    tails = vocabulary.head + np.arange(vocabulary.params.tail_classes)[::-1]
    return np.concatenate([own, tails]).astype(np.int32)


def fit_vocabulary(counts: DataFrame, params: LmParams = LmParams()) -> Vocabulary:
    """Totals over all counted words, and as many of the most frequent ones as may be looked up."""
    spelled = counts.where(F.col("word") != F.lit(END)).groupBy(_tail_class("word", params.tail_classes).alias("t"))
    rows = spelled.agg(F.sum("c").alias("mass"), F.count(F.when(F.col("c") == 1, 1)).alias("singles"))
    tails, singles = [0] * params.tail_classes, [0] * params.tail_classes
    for r in rows.collect():
        tails[r["t"]], singles[r["t"]] = r["mass"], r["singles"]
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # The least count so that not too many words have it: from a histogram in steps of a sixteenth of a doubling.
    step = F.floor(F.log2("c") * 16).cast("int").alias("step")
    histogram = {r["step"]: r["n"] for r in counts.groupBy(step).agg(F.count("*").alias("n")).collect()}
    kept, least = 0, None
    for s in sorted(histogram, reverse=True):
        if kept + histogram[s] > params.lookup_words:
            break
        kept, least = kept + histogram[s], s
    words = []
    if least is not None:
        found = counts.where((F.floor(F.log2("c") * 16) >= least) | (F.col("word") == F.lit(END))).toArrow()
        words = list(zip(found.column("word").to_pylist(), found.column("c").to_pylist()))
    return Vocabulary(words, singles, tails, total["n"], total["v"], params)


# -- training ---------------------------------------------------------------------------------------


def _train(docs: DataFrame, vocabulary: Broadcast, flat: Broadcast, rate: float, lanes: int, epochs: int) -> DataFrame:
    """A row per task that had documents: its tokens in thousands, and its parameters in fixed point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Vocabulary = vocabulary.value
        places, symbols, params = own.places(), _symbols(own), own.params
        trainer = Trainer(own.shape(), flat.value, rate, lanes, params.window)
        for batch in batches:
            parts = [np.zeros(1, np.int32)]  # the end, before the first word
            for text in batch.column("text"):
                words = tokens_of(text.as_py())
                words.append(END)
                parts.append(np.fromiter(map(places.__getitem__, words), np.int64, len(words)))
            text = symbols[np.concatenate(parts)]
            for _ in range(epochs):
                trainer.feed(text, 0)
        if trainer.tokens:
            values = np.rint(np.clip(trainer.model.flat, -100, 100) * _FIXED).astype(np.int64)
            yield pa.record_batch(
                [pa.array([1 + trainer.tokens // 1000], pa.int64()), pa.array([values], pa.list_(pa.int64()))],
                names=["weight", "values"],
            )

    return docs.select("text").mapInArrow(run, "weight bigint, values array<bigint>")


_FIXED = 1 << 16


def _average(trained: DataFrame, before: np.ndarray) -> np.ndarray:
    """Mean of the tasks' parameters, weighted by their tokens; exact sums, so their order doesn't matter."""
    places = trained.select("weight", F.posexplode("values").alias("at", "value"))
    sums = places.groupBy("at").agg(F.sum(F.col("weight") * F.col("value")).alias("s"), F.sum("weight").alias("w"))
    found = sums.toArrow()  # as many rows as the model has parameters
    if found.num_rows == 0:
        return before
    after = before.copy()
    after[found.column("at").to_numpy()] = (
        found.column("s").to_numpy() / found.column("w").to_numpy() / _FIXED
    ).astype(np.float32)
    return after


def fit(docs: DataFrame, train: Column, vocabulary: Vocabulary) -> np.ndarray:
    """Parameters of the network after the warm-up and a pass over all training documents."""
    context, params = docs.sparkSession.sparkContext, vocabulary.params
    flat = vocabulary.shape().start(vocabulary.symbol_counts(), params.seed)
    if vocabulary.n == 0:
        return flat
    known = context.broadcast(vocabulary)
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.length("text")), F.lit(1 << 20))
    rows = docs.where(train).select("text", place.alias("place"))
    share = min(1.0, params.warm_tokens / vocabulary.n)
    warm = rows.where(F.col("place") < math.ceil(share * (1 << 20))).repartition(1)  # bounded by warm_tokens
    epochs = max(1, min(8, params.warm_tokens // max(1, vocabulary.n)))
    jobs = [(warm, params.warm_rate, params.warm_lanes, epochs)]
    slot, at = F.pmod(F.col("place"), F.lit(sum(params.rounds))), 0
    for size in params.rounds:
        jobs.append((rows.where((slot >= at) & (slot < at + size)), params.rate, params.lanes, 1))
        at += size
    for some, rate, lanes, times in jobs:
        sent = context.broadcast(flat)
        flat = _average(_train(some, known, sent, rate, lanes, times), flat)
        sent.unpersist()
    known.unpersist()
    return flat


# -- scoring ----------------------------------------------------------------------------------------


def _score(docs: DataFrame, vocabulary: Broadcast, flat: Broadcast) -> DataFrame:
    """Everything but the words that are not looked up, which go along with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Vocabulary = vocabulary.value
        places, symbols, model = own.places(), _symbols(own), Model(own.shape(), flat.value)
        known = own.counts > 0
        base = np.log10(own.counts + 0.5)
        share = np.zeros(len(symbols))  # within the tail class; the class's mass alone where the word is not known here
        mass = np.log10(own.mass)
        tail = np.arange(len(symbols)) >= own.head
        share[tail] = -mass[symbols[tail] - own.head]
        looked = np.arange(own.head, len(own.words))
        share[looked] += np.log10(np.maximum(own.counts[looked], 0.5))
        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                rows, texts = [], []
                for text in some.column("text"):
                    words = tokens_of(text.as_py())
                    words.append(END)
                    place = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
                    missing = np.flatnonzero(place < 0)
                    rest = Counter(words[i] for i in missing.tolist())
                    here = place[place >= 0]
                    rows.append(
                        (len(words), int(known[here].sum()), float(base[here].sum()), float(share[place].sum()),
                         list(rest), list(rest.values()))
                    )
                    texts.append(symbols[place])
                logs = model.score(texts, 0) / math.log(10)
                n_tokens, n_known, sums, shares, rest_words, rest_counts = zip(*rows)
                ids = np.arange(row_id, row_id + some.num_rows)
                row_id += some.num_rows
                yield pa.record_batch(
                    [
                        pa.array(ids, pa.int64()), some.column("doc_id"), some.column("held_out"),
                        pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums, pa.float64()),
                        pa.array(logs + np.array(shares), pa.float64()),
                        pa.array(rest_words, pa.list_(pa.binary())), pa.array(rest_counts, pa.list_(pa.int64())),
                    ],
                    names=[part.split()[0] for part in SCORED.split(", ")],
                )

    return docs.mapInArrow(run, SCORED)


def score_documents(docs: DataFrame, held_out: Column, params: LmParams = LmParams()) -> DataFrame:
    """``doc_id``, ``held_out``, token counts, ``base_score`` and ``score`` of each row of ``docs``, whole texts.

    The model learns from rows where ``held_out`` is not true.  A null or empty text is its end alone.  Words
    are compared with all training words: those beyond the look-up table by a join.  Each row is scored, repeated ids too;
    missing ids stay missing.  Without training rows every symbol is as likely as its class allows, and base_score
    is that of an empty table of counts.  Runs jobs when called.
    """
    spark = docs.sparkSession
    train = ~F.coalesce(held_out, F.lit(False))
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts, path = keep_table(_count_words(docs.where(train)), "lm-counts")
    vocabulary = fit_vocabulary(counts, params)
    flat = fit(docs, train, vocabulary)
    known, sent = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(flat)
    rows = own.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    scored, _ = keep_table(_score(rows, known, sent), "lm-scored")
    known.unpersist()
    sent.unpersist()

    pairs = scored.select("row_id", F.explode(F.arrays_zip("rest_words", "rest_counts")).alias("x"))
    pairs = pairs.select("row_id", F.col("x.rest_words").alias("word"), F.col("x.rest_counts").alias("n"))
    by_class = F.array(*[F.lit(float(x)) for x in np.log10(vocabulary.unknown)])
    unknown = F.get(by_class, _tail_class("word", params.tail_classes))
    joined = pairs.join(counts, "word", "left")
    rest = joined.groupBy("row_id").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rest_base"),
        F.sum(F.col("n") * F.coalesce(F.log10("c"), unknown)).alias("rest_model"),
    )
    all_rows = scored.drop("rest_words", "rest_counts").join(rest, "row_id", "left")
    whole = math.log10(vocabulary.n + 0.5 * (vocabulary.v + 1))
    return all_rows.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", F.lit(0.0)) - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("model") + F.coalesce("rest_model", F.lit(0.0))).alias("score"),
    )

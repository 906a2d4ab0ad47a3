"""Quality rules: text measures, fixed base rules and a learned decision list, all as Spark expressions.

Sequential covering: grow a conjunction of thresholds that finds low-quality texts among those no earlier rule
covers, prune it on rows it was not grown on, keep it if it is still precise, and go on with the rest.  Every
step asks Spark for counts by feature and bin over all labelled rows; the driver sees those counts only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import WORD, discard, keep_table, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class RuleParams:
    """quantiles: of each feature; thresholds are the middles between those that differ.  max_rules, max_conditions: size of the list.
    min_precision: least share of low-quality texts among those a rule covers, on the rows kept for pruning.
    min_support: low-quality rows a rule must cover there.
    """

    quantiles: int = 40
    max_rules: int = 8
    max_conditions: int = 4
    min_precision: float = 0.98
    min_support: int = 8


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def covers(self) -> Column:
        found = F.lit(True)
        for condition in self.conditions:
            found = found & condition.holds()
        return found

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:g}" for c in self.conditions)


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: 0-based number of the first rule that covers a row, else null."""
    found = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules))):
        found = F.when(rule.covers(), F.lit(number)).otherwise(found)
    return found


# -- measures ------------------------------------------------------------------------


def _repeated_words(windows: Column) -> Column:
    """Words in windows whose hash occurs at least twice, from the sorted (hash, place) pairs."""
    twice = F.filter(
        windows,
        lambda x, i: (x["hash"] == F.get(windows, i - 1)["hash"]) | (x["hash"] == F.get(windows, i + 1)["hash"]),
    )
    places = F.array_sort(F.transform(twice, lambda x: x["place"]))
    start = F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        places,
        start,
        lambda acc, p: F.struct(
            (acc["words"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("words"), p.alias("last")
        ),
        lambda acc: acc["words"],
    )


def measure(docs: DataFrame, text: str = "text", into: str = "__m") -> DataFrame:
    """``docs`` with a struct ``into`` of the measures and features of each whole text.

    A null text has no words.  Windows are compared by 64-bit hashes within a text.  Other columns are kept.
    Store the result before filtering it: a filter would move below the lists of words and windows, which are looked
    into element by element, and build them again for each element.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    split = docs.select(
        *own, F.coalesce(text, F.lit("")).alias("__t"), words(F.col(text)).alias("__w")
    )
    n = F.size("__w")
    windows = F.when(
        n > WINDOW,
        F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__w", i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("__t", "\n"), lambda line: line.rlike(WORD))
    hashed = split.select(*own, "__t", "__w", windows.alias("__h"), lines.alias("__l"))
    again = F.size(F.array_distinct("__h")) < F.size("__h")
    pairs = F.when(
        again,
        F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("hash"), i.alias("place")))),
    )
    counted = hashed.select(
        *own,
        n.alias("__n"),
        F.length(F.array_join("__w", "")).alias("__c"),
        F.regexp_count("__t", F.lit(SYMBOLS)).alias("__s"),
        F.size("__l").alias("__lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).alias("__d"),
        F.size(F.array_distinct("__w")).alias("__u"),
        pairs.alias("__p"),
    )
    repeated = F.coalesce(_repeated_words(F.col("__p")), F.lit(0))
    summed = counted.select(*own, "__n", "__c", "__s", "__lines", "__d", "__u", repeated.alias("__r"))

    def rate(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return summed.select(
        *own,
        F.struct(
            F.col("__n").cast("long").alias("n_words"),
            F.col("__c").cast("long").alias("word_chars"),
            F.col("__s").cast("long").alias("n_symbols"),
            F.col("__d").cast("long").alias("n_dup_lines"),
            F.col("__r").cast("long").alias("n_repeat_words"),
            rate("__c", "__n").alias("mean_word"),
            rate("__s", "__n").alias("symbol_rate"),
            rate("__d", "__lines").alias("dup_line_rate"),
            rate("__r", "__n").alias("repeat_rate"),
            rate("__u", "__n").alias("distinct_rate"),
        ).alias(into),
    )


#: What the learned rules may look at, besides the length.
FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate")


def base_failed() -> Column:
    few = F.col("n_words") < MIN_WORDS
    return few | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


# -- learning ------------------------------------------------------------------------


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    """FOIL's gain: low-quality rows kept, times the bits that each of them becomes less surprising."""
    if p1 == 0:
        return 0.0
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))


class _Learner:
    """Counts over the cells of binned features; ``bin > k`` is ``value > thresholds[k]``."""

    def __init__(self, cells: DataFrame, thresholds: dict[str, list[float]], params: RuleParams):
        self.cells, self.thresholds, self.params = cells, thresholds, params

    def _cell(self, condition: Condition) -> Column:
        place = self.thresholds[condition.feature].index(condition.threshold)
        column = F.col(condition.feature)
        return column > place if condition.above else column <= place

    def covered(self, conditions: tuple[Condition, ...]) -> Column:
        found = F.lit(True)
        for condition in conditions:
            found = found & self._cell(condition)
        return found

    def grow(self, left: Column) -> tuple[Condition, ...]:
        rule: tuple[Condition, ...] = ()
        while len(rule) < self.params.max_conditions:
            inside = self.cells.where(left & F.col("grow") & self.covered(rule))
            bins = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in self.thresholds])
            counts: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in self.thresholds}
            rows = inside.select(F.explode(bins).alias("x"), "low", "high").groupBy("x.f", "x.b")
            for r in rows.agg(F.sum("low").alias("p"), F.sum("high").alias("n")).collect():
                counts[r["f"]][r["b"]] = (r["p"], r["n"])
            p0 = sum(p for p, _ in counts[next(iter(counts))].values())
            n0 = sum(n for _, n in counts[next(iter(counts))].values())
            if p0 == 0 or n0 == 0:
                break
            best, most = None, 1e-9
            for f, values in self.thresholds.items():
                for k, value in enumerate(values):
                    p1 = sum(p for b, (p, _) in counts[f].items() if b > k)
                    n1 = sum(n for b, (_, n) in counts[f].items() if b > k)
                    for above, p, n in ((True, p1, n1), (False, p0 - p1, n0 - n1)):
                        if (gain := _gain(p0, n0, p, n)) > most:
                            best, most = Condition(f, above, value), gain
            if best is None:
                break
            rule += (best,)
        return rule

    def prune(self, rule: tuple[Condition, ...], left: Column) -> tuple[tuple[Condition, ...], int, int]:
        """The first conditions with the best (p - n) / (p + n) on the other rows, and their p and n."""
        sums = []
        for length in range(1, len(rule) + 1):
            inside = self.covered(rule[:length])
            for name in ("low", "high"):
                sums.append(F.coalesce(F.sum(F.when(inside, F.col(name))), F.lit(0)).alias(f"{name}{length}"))
        row = self.cells.where(left & ~F.col("grow")).agg(*sums).first()
        worth = [
            ((row[f"low{k}"] - row[f"high{k}"]) / max(1, row[f"low{k}"] + row[f"high{k}"]), -k)
            for k in range(1, len(rule) + 1)
        ]
        length = -max(worth)[1]
        return rule[:length], row[f"low{length}"], row[f"high{length}"]

    def learn(self) -> list[Rule]:
        rules: list[Rule] = []
        left = F.lit(True)
        while len(rules) < self.params.max_rules:
            grown = self.grow(left)
            if not grown:
                break
            kept, p, n = self.prune(grown, left)
            if p < self.params.min_support or p < self.params.min_precision * (p + n):
                break
            rules.append(Rule(kept))
            left = left & ~self.covered(kept)
        return rules


def _bin(feature: str, thresholds: list[float]) -> Column:
    """How many thresholds the feature is above."""
    return F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t < F.col(feature)))


def learn_rules(measured: DataFrame, labels: DataFrame, params: RuleParams = RuleParams()) -> list[Rule]:
    """The decision list for rows that pass the base rules; empty where no label of either kind is known.

    ``measured`` has ``doc_id`` and the features, ``labels`` has ``doc_id`` and ``quality`` (0 is low; null is
    no label; of several labels the lowest counts).  All labelled rows are counted.  Runs jobs when called.
    """
    spark = measured.sparkSession
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = measured.where(~base_failed()).select("doc_id", *FEATURES)
    labelled, path = keep_table(rows.join(known, "doc_id"), "labelled")
    steps = [(i + 0.5) / params.quantiles for i in range(params.quantiles)]
    tails = [0.001, 0.003, 0.997, 0.999]
    found = labelled.agg(
        *[F.percentile_approx(F.col(f).cast("double"), sorted(steps + tails), 2000).alias(f) for f in FEATURES]
    ).first()
    thresholds = {}
    for f in FEATURES:
        values = sorted(set(found[f] or []))
        if len(values) > 1:
            thresholds[f] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    if not thresholds:
        discard(spark, [path])
        return []
    bins = [_bin(f, values).alias(f) for f, values in thresholds.items()]
    low = F.col("quality") == 0
    grow = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("grow")), F.lit(3)) > 0).alias("grow")
    binned = labelled.select(*bins, grow, low.cast("long").alias("low"), (~low).cast("long").alias("high"))
    grouped = binned.groupBy(*thresholds, "grow").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    cells, cells_path = keep_table(grouped, "cells")
    rules = _Learner(cells, thresholds, params).learn()
    discard(spark, [path, cells_path])
    return rules


# -- what callers use ------------------------------------------------------------------


def judge(docs: DataFrame, labels: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the measures, ``base_failed``, ``rule`` and ``kept``.

    ``rule`` is the number of the learned rule that rejects a row which passes the base rules.  Null and empty
    texts fail the base rules.  An empty table, or one without labels, learns no rule.
    """
    measured, _ = keep_table(measure(docs.select("doc_id", "text")).select("doc_id", "__m.*"), "measured")
    rules = learn_rules(measured, labels, params)
    failed = measured.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    rule = F.when(~F.col("base_failed"), F.col("rule"))
    return failed.select(
        "doc_id", *MEASURES, "base_failed", rule.alias("rule"),
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """The rows of ``docs`` that the base rules and the learned rules keep, with the columns they came with."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")  # names may clash
    measured, _ = keep_table(measure(docs).select(row, "__m.*"), "measured")
    features = measured.select(F.col("__row.doc_id").alias("doc_id"), *MEASURES, *FEATURES[1:])
    rules = learn_rules(features, labels, params)
    return measured.where(~base_failed() & verdict(rules).isNull()).select("__row.*")

"""Benchmark decontamination with spaced seeds, in DataFrame expressions only.

A seed is a fixed mask over neighbouring words that ignores some of them, so a passage with replaced words
still shares seeds with its source.  The masks follow from what a window of an item may differ in, and miss no overlap.
Seeds of the documents are joined with those of the benchmark; around the
hits of one diagonal the words of both are compared, and a window with enough equal words is an overlap.
Items of very few words are looked for as whole lines and whole texts.

Texts of any length are taken whole.  A text and an item meet in one row, with all diagonals that have hits: a text that
repeats a word has as many of those as it has words, and each is compared over the item's length alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import GAP, attach, discard, keep_table

#: Letters and digits count, other marks do not.
MARKS = r"[^\p{L}\p{N}\x20\x09-\x0D]+"


@dataclass(frozen=True)
class SeedParams:
    """window: words compared around a hit (a shorter item is compared whole).  similarity: least share of equal
    words in the window.  weight: words of a mask at most.  min_words: items with fewer must be a whole line or a whole
    text, since as phrases they are plain language.  broadcast_rows: up to so many benchmark seeds go
    to every task (about 50 bytes each, counted first); more are joined by a shuffle.
    """

    window: int = 13
    similarity: float = 0.8
    weight: int = 4
    min_words: int = 5
    broadcast_rows: int = 1_000_000

    def least(self, words: int) -> int:
        """Equal words that a window of an item of so many words needs."""
        return math.ceil(min(words, self.window) * self.similarity - 1e-9)

    def mask(self, words: int) -> tuple[int, ...]:
        """Offsets of the words that count for an item of so many words.

        Where s words of a window may differ, the mask takes every (s + 1)-th word.  Put at the first s + 1
        words of a window it covers different words each time, and s replaced words leave one of them whole: every
        overlap has a hit.
        """
        wide = min(words, self.window)
        stride = wide - self.least(words) + 1
        return tuple(range(0, stride * min(self.weight, wide // stride), stride))


def plain_words(text: Column) -> Column:
    """Lower-cased words without punctuation; none for a missing text."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), MARKS, "")
    return F.array_remove(F.split(plain, GAP), "")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _seeds(words: str, masks: list[tuple[int, ...]]) -> Column:
    """Hashes of all masks at all places, place by place."""
    n = F.size(words)

    def at(i: Column) -> Column:
        return F.array(
            *[F.xxhash64(F.lit(m), *[F.get(words, i + o) for o in mask]) for m, mask in enumerate(masks)]
        )

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), at)))


def _verified(aligned: DataFrame, params: SeedParams) -> DataFrame:
    """Per text (``w``) and item (``iw``), the most equal words along a diagonal that has a similar window; else null."""
    length = F.size("iw")
    wide = F.least(F.lit(params.window), length)
    least = F.ceil(wide * params.similarity - 1e-9)

    def flags(d: Column) -> Column:
        def equal(j: Column) -> Column:
            at = j + d["shift"]
            return F.when((at >= 0) & (F.get("iw", j) == F.get("w", at)), 1).otherwise(0)

        return F.struct(
            F.transform(F.sequence(F.lit(0), length - 1), equal).alias("equal"),
            F.greatest(F.lit(0), d["first_end"] - wide).alias("low"),
            F.least(d["last_start"], length - wide).alias("high"),
        )

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)

    def score(e: Column) -> Column:
        similar = F.exists(F.sequence(e["low"], e["high"]), lambda s: total(F.slice(e["equal"], s + 1, wide)) >= least)
        return F.when((e["low"] <= e["high"]) & (total(e["equal"]) >= least), F.when(similar, total(e["equal"])))

    scores = F.transform(F.transform("diagonals", flags), score)
    return aligned.select("digest", "item_id", F.array_max(scores).alias("matched"))


def _whole(docs: DataFrame, items: DataFrame, params: SeedParams) -> DataFrame:
    """Texts that are, or have a line that is, an item of fewer than ``min_words`` words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    said = F.filter(
        F.transform(F.concat(F.array(text), F.split(text, "\n")), plain_words),
        lambda w: (F.size(w) > 0) & (F.size(w) < params.min_words),
    )
    lines = docs.select(_digest(F.col("text")).alias("digest"), F.explode(F.array_distinct(said)).alias("iw")).distinct()
    few = items.select("item_id", "iw")
    side = F.broadcast(few) if few.count() <= params.broadcast_rows else few
    return lines.join(side, "iw").select("digest", "item_id", F.size("iw").alias("matched"))


def overlapping_texts(docs: DataFrame, benchmark: DataFrame, params: SeedParams = SeedParams()) -> DataFrame:
    """``digest`` (of the text), ``item_id`` and ``matched_words`` of all verified overlaps, as a stored table."""
    spark = docs.sparkSession
    wanted = benchmark.select("item_id", plain_words(F.col("text")).alias("iw")).distinct()
    items, item_path = keep_table(
        wanted.where(F.size("iw") > 0).withColumn("item", F.monotonically_increasing_id()), "seed-items"
    )
    # Lengths up to the window, so at most as many as it has words.
    capped = items.select(F.least(F.size("iw"), F.lit(params.window)).alias("n")).distinct()
    lengths = sorted(r["n"] for r in capped.collect())
    masks = sorted({params.mask(n) for n in lengths if n >= params.min_words})
    found = []
    if any(n < params.min_words for n in lengths):
        found.append(_whole(docs, items.where(F.size("iw") < params.min_words), params))
    paths = [item_path]
    if masks:
        number = F.lit(None).cast("int")
        for n in lengths:
            if n >= params.min_words:
                number = F.when(F.least(F.size("iw"), F.lit(params.window)) == n, masks.index(params.mask(n))).otherwise(number)
        spans = F.array(*[F.lit(1 + mask[-1]) for mask in masks])
        own = items.where(F.size("iw") >= params.min_words).select(
            "item", F.size("iw").alias("n"), number.alias("own"), F.posexplode(_seeds("iw", masks)).alias("at", "h")
        )
        mask = F.pmod("at", F.lit(len(masks)))
        q = F.floor(F.col("at") / len(masks)).cast("int")
        span = F.get(spans, mask)
        inside = (mask == F.col("own")) & (q + span <= F.col("n"))
        seeds, seed_path = keep_table(own.where(inside).select("h", "item", q.alias("q"), span.alias("span")), "seeds")
        side = F.broadcast(seeds) if seeds.count() <= params.broadcast_rows else seeds

        split = docs.select(_digest(F.col("text")).alias("digest"), plain_words(F.col("text")).alias("w"))
        # The words stay behind: a row per place must be light.
        hashed = split.select("digest", _seeds("w", masks).alias("s"))
        places = hashed.select("digest", F.posexplode_outer("s").alias("at", "h"))
        hits = places.join(side, "h").select("digest", "item", (q - F.col("q")).alias("shift"), "q", "span")
        diagonals, hit_path = keep_table(
            hits.groupBy("digest", "item", "shift").agg(
                F.min(F.col("q") + F.col("span")).alias("first_end"), F.max("q").alias("last_start")
            ),
            "seed-hits",
        )
        suspects = diagonals.select("digest").distinct()
        texts = docs.select(_digest(F.col("text")).alias("digest"), "text").groupBy("digest").agg(
            F.any_value("text").alias("text")
        )
        words = texts.join(suspects, "digest").select("digest", plain_words(F.col("text")).alias("w"))
        # As many diagonals as the text and the item have words, at most.
        met = diagonals.groupBy("digest", "item").agg(
            F.collect_list(F.struct("shift", "first_end", "last_start")).alias("diagonals")
        )
        found.append(_verified(met.join(words, "digest").join(items, "item"), params))
        paths += [seed_path, hit_path]
    if not found:  # no item has a word
        found.append(items.select(F.lit(b"").alias("digest"), "item_id", F.size("iw").alias("matched")))
    # A filter of ``matched`` here would compute it twice; after the aggregate it does not.
    every = reduce(DataFrame.unionAll, found)
    best = every.groupBy("digest", "item_id").agg(F.max("matched").cast("long").alias("matched_words"))
    kept, _ = keep_table(best.where("matched_words is not null"), "seed-overlaps")
    discard(spark, paths)
    return kept


def contaminated(docs: DataFrame, benchmark: DataFrame, params: SeedParams = SeedParams()) -> DataFrame:
    """``doc_id``, ``item_id`` and ``matched_words`` for each document that overlaps a benchmark item.

    matched_words counts equal words along the best alignment of the whole item.  Null and empty texts overlap nothing,
    on either side; items under ``min_words`` words must be a whole line or text; repeated rows count once; rows with a
    missing id are one document.  Empty tables give an empty result.  Runs jobs when called.
    """
    texts = overlapping_texts(docs, benchmark, params)
    ids = docs.select("doc_id", _digest(F.col("text")).alias("digest"))
    found = attach(ids, texts, "digest", F.xxhash64("doc_id")).where(F.col("matched_words").isNotNull())
    return found.groupBy("doc_id", "item_id").agg(F.max("matched_words").alias("matched_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, params: SeedParams = SeedParams()) -> DataFrame:
    """The rows of ``docs`` whose text overlaps no item, with the columns they came with."""
    found = overlapping_texts(docs, benchmark, params).select(F.col("digest").alias("__digest")).distinct()
    marked = docs.withColumn("__digest", _digest(F.col("text")))
    flagged = attach(marked, found.withColumn("__found", F.lit(True)), "__digest", F.xxhash64("doc_id"))
    return flagged.where(F.col("__found").isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(params: SeedParams = SeedParams()) -> str:
    """The rule itself for DuckDB, without seeds: equal words of all diagonals, and windows with enough of them."""

    def words(text: str) -> str:
        return (
            f"list_filter(string_split_regex(regexp_replace(lower(coalesce({text}, '')), '{MARKS}', '', 'g'), '{GAP}'), "
            "lambda x: x <> '')"
        )

    wide = f"least({params.window}, len(iw))"
    least = f"ceil({wide} * {params.similarity} - 1e-9)::BIGINT"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents)),
items AS (
  SELECT row_number() OVER () AS item, item_id, iw FROM (SELECT DISTINCT item_id, {words("text")} AS iw FROM benchmark) WHERE len(iw) > 0
),
doc_words AS (
  SELECT d, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT d, {words("text")} AS w FROM docs)
),
item_words AS (
  SELECT item, {wide} AS wide, {least} AS least, unnest(iw) AS word, unnest(range(len(iw))) AS j FROM items WHERE len(iw) >= {params.min_words}
),
diagonals AS (
  SELECT d, item, wide, least, list_sort(js) AS js FROM (
    SELECT d, item, any_value(wide) AS wide, any_value(least) AS least, list(j) AS js
    FROM doc_words JOIN item_words USING (word) GROUP BY d, item, i - j
  ) WHERE len(js) >= least
),
alike AS (
  SELECT d, item, len(js) AS matched FROM diagonals
  WHERE len(list_filter(range(1, len(js) - least + 2), lambda k: js[k + least - 1] - js[k] < wide)) > 0
),
lines AS (
  SELECT DISTINCT d, {words("line")} AS iw
  FROM (SELECT d, unnest(list_prepend(coalesce(text, ''), string_split(coalesce(text, ''), chr(10)))) AS line FROM docs)
),
found AS (
  SELECT d, item, matched FROM alike
  UNION ALL
  SELECT d, item, len(iw) FROM lines JOIN items USING (iw) WHERE len(iw) < {params.min_words}
)
SELECT doc_id, item_id, max(matched)::BIGINT AS matched_words
FROM found JOIN docs USING (d) JOIN items USING (item) GROUP BY ALL
"""

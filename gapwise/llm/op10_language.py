"""Language identification by compression.

Each language has a dictionary of raw training text.  A document is encoded with every one of them by
zstandard; the language whose dictionary gives the fewest bytes is its own.  A narrow margin between
the best two, or a text without a letter, means rejection.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
RESULT = "lang_pred string, score double, margin double, rejected boolean"
_OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class LanguageParams:
    """dictionary_bytes: raw text kept per language.  sample_docs: whole training documents looked at per
    language to fill it, in an order by hash; both bound what the driver and the tasks hold.
    block_bytes: a text is encoded in blocks of this size, all of them, so that its own repetitions
    do not hide the dictionary.  min_margin: least share by which the best must beat the second.
    min_match, search_log: the coder looks for matches of so many bytes, over 2**search_log places.  Words share
    short pieces, which the shorthand levels of the library skip at this speed.
    """

    dictionary_bytes: int = 64 * 1024
    sample_docs: int = 150
    block_bytes: int = 8 * 1024
    min_margin: float = 0.002
    min_match: int = 3
    search_log: int = 3

    def coding(self) -> zstandard.ZstdCompressionParameters:
        return zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_GREEDY,
            min_match=self.min_match,
            search_log=self.search_log,
            window_log=18,
            hash_log=16,
            chain_log=16,
            write_checksum=0,
            write_content_size=0,
        )


def letters(text: str) -> str:
    """Lower-cased letters; everything else becomes single spaces."""
    return _OTHER.sub(" ", text.lower()).strip()


def fit_dictionaries(
    docs: DataFrame, train: Column, params: LanguageParams = LanguageParams()
) -> dict[str, bytes]:
    """One dictionary per non-null ``lang`` of the rows where ``train`` holds.

    A bounded sample: per language, about ``sample_docs`` documents with the lowest hash of id and text length
    are read whole, and joined until ``dictionary_bytes`` are full.  Languages whose training texts
    hold no letter get none.  An empty table gives no dictionary, and then every text is ``und``.
    """
    rows = docs.where(train & F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0)).select(
        F.col("lang").cast("string").alias("lang"),
        F.col("text").alias("text"),
        F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)).alias("h"),
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        most = (1 << 30) if n <= params.sample_docs else (params.sample_docs << 30) // n
        chosen = chosen | ((F.col("lang") == lang) & (F.col("h") < most))
    found: dict[str, list[tuple[int, str]]] = {}
    for r in rows.where(chosen).limit(2 * params.sample_docs * len(counts)).collect():
        found.setdefault(r["lang"], []).append((r["h"], r["text"]))
    dictionaries = {}
    for lang, texts in found.items():
        # Documents of middling length first: more voices in the same bytes.
        texts.sort(key=lambda x: (not 200 <= len(x[1]) <= 4000, x))
        joined = b""
        for _, text in dict.fromkeys(texts):
            if len(joined) < params.dictionary_bytes:
                joined += letters(text).encode()[: params.dictionary_bytes - len(joined)] + b" "
        if len(joined.strip()) >= 8:
            dictionaries[lang] = joined
    return dictionaries


class Encoder:
    """Bytes that a text takes with each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], params: LanguageParams):
        self.params, self.names, self.coders = params, sorted(dictionaries), []
        coding = params.coding()
        for name in self.names:
            own = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=coding)
            self.coders.append(zstandard.ZstdCompressor(dict_data=own, compression_params=coding))

    def sizes(self, plain: str) -> list[int]:
        data, step = plain.encode(), self.params.block_bytes
        blocks = [data[i : i + step] for i in range(0, len(data), step)]
        return [sum(len(coder.compress(b)) for b in blocks) for coder in self.coders]

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        plain = letters(text) if text is not None else ""
        if not plain or not self.names:
            return UNKNOWN, 0.0, 0.0, True
        sizes = self.sizes(plain)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], self.names[i]))
        best = sizes[order[0]]
        margin = (sizes[order[1]] - best) / sizes[order[1]] if len(order) > 1 else 1.0
        # Code lengths are overconfident, neighbouring words share context: one bit counts as a quarter.
        score = 1.0 / sum(math.exp(-2.0 * math.log(2) * min(s - best, 200)) for s in sizes)
        return self.names[order[0]], score, margin, margin < self.params.min_margin


def classify(
    text: Column, dictionaries: dict[str, bytes], params: LanguageParams = LanguageParams()
) -> Column:
    """Struct of ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``rejected`` of each text, read whole.

    A null, empty or letterless text is ``und`` with score 0, rejected.  Ties go to the first name, and
    are rejected for their margin of 0.  With one dictionary, its language takes every text with letters.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(dictionaries, params)
        for texts in batches:
            found = [encoder.classify(t) for t in texts]
            yield pd.DataFrame(found, columns=["lang_pred", "score", "margin", "rejected"])

    return F.pandas_udf(run, RESULT)(text)


def identify(docs: DataFrame, train: Column, params: LanguageParams = LanguageParams()) -> DataFrame:
    """``doc_id`` and the verdict on every row of ``docs``; fitting runs when this is called."""
    dictionaries = fit_dictionaries(docs, train, params)
    verdict = docs.select("doc_id", classify(F.col("text"), dictionaries, params).alias("verdict"))
    return verdict.select("doc_id", "verdict.*")


def keep_identified(docs: DataFrame, train: Column, params: LanguageParams = LanguageParams()) -> DataFrame:
    """The rows of ``docs`` whose language is clear, with the columns they came with."""
    dictionaries = fit_dictionaries(docs, train, params)
    verdict = docs.withColumn("__verdict", classify(F.col("text"), dictionaries, params))
    return verdict.where(~F.col("__verdict.rejected")).drop("__verdict")

"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile is the list of a language's ``PROFILE`` most frequent n-grams (1 to 3 letters, words
padded by one blank) over all training documents. A document is represented by its own most
frequent n-grams, at most ``PROFILE``; its distance to a language sums how far each of them is out
of place there, an n-gram that the profile lacks counting as ``PROFILE``. Ties in frequency are
broken by the n-gram's code, ties in distance by the language's name.

An n-gram is that of lower-case code points, packed into 64 bits, so none are confused whatever
their script. Letters and combining marks make words, all else is a blank. Only the text is looked
at. A text that is null or has no letter is ``und`` with score 0, as is any if nothing was learned.
The score of any other is 1 minus the ratio of its distance to the largest possible one.

The profiles, some 6 KB a language, go to the driver and to every worker, as sorted arrays; the
number of languages is not limited. Rows of equal doc_id are predicted one by one; learn() of an
empty table is no language, predict() of one is empty. predict() replaces the columns that it adds.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import release, steps

PROFILE = 400
UNKNOWN = "und"
#: A code point takes 21 bits; the first number beyond them stands for a blank.
_BITS, _BLANK = np.int64(21), np.int64(0x110000)
#: Different n-grams of all languages that a task counts before it hands them on.
_HELD = 1 << 20
_KINDS: list[np.ndarray] = []


def letter_kinds() -> np.ndarray:
    """For each code point 2 (a letter), 1 (a combining mark) or 0."""
    if not _KINDS:
        _KINDS.append(np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8))
    return _KINDS[0]


def grams(text: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of a text's words, padded by blanks; empty if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = letter_kinds()[points]
    if not (kind == 2).any():
        return np.zeros(0, np.int64)
    inside = kind > 0
    shown = inside.copy()
    shown[1:] |= inside[:-1]  # one blank for each run of other characters
    x = np.where(inside, points, _BLANK)[shown].astype(np.int64)
    x = np.concatenate([[_BLANK], x, [_BLANK]])
    two = x[:-1] << _BITS | x[1:]
    three = two[:-1] << _BITS | x[2:]
    word = x != _BLANK
    # a 3-gram across two words says nothing about either
    return np.concatenate([x[word], two[word[:-1] | word[1:]], three[word[1:-1]]])


def ranked(codes: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, at most size, by falling count and then by code."""
    values, counts = np.unique(codes, return_counts=True)
    if len(values) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        values, counts = values[counts >= least], counts[counts >= least]
    return values[np.lexsort((values, -counts))][:size]


class Profiles:
    """The profiles of the learned languages: all their n-grams, sorted, with language and rank."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted(profiles)
        sizes = [len(profiles[x]) for x in self.langs]
        code = np.array([c for x in self.langs for c in profiles[x]], np.int64)
        order = np.argsort(code, kind="stable")
        self.code = code[order]
        self.lang = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.rank = np.concatenate([np.arange(n) for n in sizes] or [np.zeros(0, np.int64)])[order]

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = ranked(grams(text), self.size) if text else ()
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        left = np.searchsorted(self.code, codes)
        count = np.searchsorted(self.code, codes, "right") - left
        place = np.repeat(np.arange(len(codes)), count)
        found = np.repeat(left - np.cumsum(count) + count, count) + np.arange(len(place))
        # what a shared n-gram saves against one that the profile lacks
        saved = np.bincount(self.lang[found], self.size - np.abs(self.rank[found] - place), len(self.langs))
        best = int(np.argmax(saved))
        return self.langs[best], float(saved[best] / (self.size * len(codes)))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values, inverse = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return values, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(values)).astype(np.int64)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each n-gram occurs in all texts of a language."""

    def run(batches):
        release()
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in steps(batches):
            parts: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                parts.setdefault(lang, []).append(grams(text))
            for lang, x in parts.items():
                new = np.unique(np.concatenate(x), return_counts=True)
                total[lang] = _summed([total[lang], new]) if lang in total else new
            if sum(len(v) for v, _ in total.values()) > _HELD:
                yield from rows(total)
                total = {}
        yield from rows(total)

    def rows(total):
        for lang, (codes, counts) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    known = labelled.select("text", "lang").where("text is not null and lang is not null")
    return known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles from all rows of (text, lang) with both; counts are summed per task, then by Spark.

    The top of a language is taken in two levels of limited windows, so that no task sorts a whole
    language and none holds one in memory.
    """
    order = (F.desc("n"), F.asc("gram"))
    counts = gram_counts(labelled).withColumn("_shard", F.pmod(F.xxhash64("gram"), F.lit(64)))
    for keys in (("lang", "_shard"), ("lang",)):
        counts = counts.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_at") <= size)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in counts.select("lang", "gram", "_at").collect():
        found.setdefault(r["lang"], []).append((r["_at"], r["gram"]))
    return {lang: [gram for _, gram in sorted(x)] for lang, x in found.items()}


def predict(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", size: int = PROFILE) -> DataFrame:
    """docs with lang_pred and score, replacing columns of those names."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    made: list[Profiles] = []

    def run(batches):
        release()
        if not made:
            made.append(Profiles(shared.value, size))
        for batch in steps(batches, text):
            langs, scores = zip(*map(made[0].predict, batch.column(text).to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = docs.limit(0).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    """Whether a document is for testing only: crc32 of doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))

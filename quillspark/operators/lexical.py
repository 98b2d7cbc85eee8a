"""Keyword search: BM25 over phrases, with phrase and prefix matching.

The score of a row is the sum over the query's distinct phrases of
``idf * f * (k1 + 1) / (f + k1 * (1 - b + b * length / average))`` with idf = ln((N - n + 0.5) /
(n + 0.5)), at least 1e-6; f counts a phrase's occurrences, n the rows that have it, N and the
average length are those of all rows, whatever is filtered later.

A search of plain rows is one scan, as no index is there: the phrase counts are array expressions over the tokens, the corpus figures
one aggregated row, and the best rows come from a top-k operator. What is exchanged is a row's id,
length and counts, never its text, so cost does not depend on how frequent the terms are. A stored index
(``postings``) is searched by ``search_postings`` instead, which reads the query's terms alone. Ids
are not null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions.text import tokens
from quillspark.operators.querylang import Phrase, Query


def occurrences(words: Column, phrase: Phrase) -> Column:
    """How often a phrase occurs in an array of tokens."""

    def at(place: Column) -> Column:
        tests = []
        for i, w in enumerate(phrase.words):
            here = F.get(words, place + i)
            tests.append(F.startswith(here, F.lit(w)) if phrase.prefix and i == len(phrase.words) - 1 else here == w)
        return reduce(lambda a, b: a & b, tests)

    first = phrase.words[0]
    if len(phrase.words) == 1:
        return F.size(F.filter(words, lambda w: F.startswith(w, F.lit(first)) if phrase.prefix else w == first)).cast("long")
    return F.size(F.filter(words, lambda w, i: F.when(w == first, at(i)).otherwise(F.lit(False)))).cast("long")


def idf(rows: Column, having: Column) -> Column:
    value = F.log((rows - having + 0.5) / (having + 0.5))
    return F.when(value <= 0, F.lit(V.BM25_LEAST_IDF)).otherwise(value)


def tokenised(rows: DataFrame, id_col: str, text: Column | str) -> DataFrame:
    """(id, words): what search() looks through; keep it to search more than once."""
    return rows.select(F.col(id_col).alias("id"), tokens(F.col(text) if isinstance(text, str) else text).alias("words"))


def scored(rows: DataFrame, query: Query) -> DataFrame:
    """(id, score) of the rows that match, from (id, words)."""
    phrases = query.phrases()
    if not phrases:
        return rows.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    counted = rows.select("id", F.size("words").cast("long").alias("length"), *[occurrences(F.col("words"), p).alias(f"f{i}") for i, p in enumerate(phrases)])
    # the few counts of a row are exchanged once and read by both branches, so texts are tokenised once
    counted = counted.repartition("id")
    figures = counted.agg(F.count("id").alias("_rows"), F.avg("length").alias("_average"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(phrases))])
    return _weighed(counted, query, phrases, figures)


def search(rows: DataFrame, query: Query, limit: int = V.KEYWORD_LIST) -> DataFrame:
    """The best rows: (id, score), ties by id."""
    return scored(rows, query).orderBy(F.col("score").desc(), "id").limit(limit)


def find_names(files: DataFrame, query: Query, limit: int = 20) -> DataFrame:
    """File-name search: (id, score) over name and path, all terms as prefixes."""
    rows = files.select("id", tokens(F.concat_ws(" ", "name", "path")).alias("words"))
    return search(rows, query, limit)


def placed(words: Column) -> Column:
    """The distinct words of a row in order, as (term, tf, positions from 0): sorted once, then cut where the word changes."""
    pairs = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("place"))))

    def runs(p: Column) -> Column:
        n = F.size(p)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(p, i)["term"] != F.get(p, i - 1)["term"]))

        def cut(starts: Column) -> Column:
            def run(start: Column, k: Column) -> Column:
                tf = F.coalesce(F.get(starts, k + 1), n) - start
                return F.struct(F.get(p, start)["term"].alias("term"), tf.cast("long").alias("tf"), F.transform(F.slice(p, start + 1, tf), lambda x: x["place"]).alias("positions"))

            return F.transform(starts, run)

        return _bound(starts, cut)

    return F.when(F.size(words) > 0, _bound(pairs, runs))


def _bound(value: Column, use) -> Column:
    """use(value), the value made once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def postings(rows: DataFrame) -> DataFrame:
    """The inverted index of (id, words, ...): term, id, tf, positions from 0, the row's length and its other columns.

    Words are counted within their row, so they are not exchanged; only rows of an id that stands twice are, to be counted together.
    """
    more = [c for c in rows.columns if c not in ("id", "words")]
    length = F.size("words").cast("long").alias("length")
    twice = F.broadcast(rows.groupBy("id").count().where("count > 1").select("id"))
    apart = rows.join(twice, "id", "left_anti").select("id", *more, length, F.explode(placed(F.col("words"))).alias("p")).select("p.term", "id", "length", *more, "p.tf", "p.positions")
    each = rows.join(twice, "id", "left_semi").select("id", *more, length, F.posexplode("words").alias("place", "term"))
    together = each.groupBy("term", "id", "length", *more).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("place")).alias("positions"))
    return apart.unionByName(together)


def corpus_figures(rows: DataFrame) -> tuple[int, float]:
    """The number of rows of (id, words), and their average length: what a stored index needs beside its terms."""
    r = rows.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("average")).first()
    return r["n"], r["average"] or 0.0


def term_stats(rows: DataFrame) -> DataFrame:
    """term, df and cf; counted within rows first, so a frequent term is no large group."""
    each = rows.select(F.explode("words").alias("term"), "id").groupBy("term", "id").agg(F.count("*").alias("tf"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def scored_postings(index: DataFrame, figures: tuple[int, float], query: Query) -> DataFrame:
    """(id, score) of the rows that match, from a stored inverted index (term, id, length, positions), with its other columns.

    Reads the query's terms only: the term filter reaches the scan, and files sorted by term are
    skipped. figures: corpus_figures() of all rows, kept when the index was made.
    """
    phrases = query.phrases()
    if not phrases:
        return index.drop("term", "tf", "positions", "length").withColumn("score", F.lit(0.0)).where(F.lit(False))
    wanted = sorted({w for p in phrases for w in (p.words[:-1] if p.prefix else p.words)})
    heads = sorted({p.words[-1] for p in phrases if p.prefix})
    wants = F.col("term").isin(wanted) if wanted else F.lit(False)
    for h in heads:
        wants = wants | F.startswith("term", F.lit(h))
    # a row's tokens at the query's words only: enough to count phrases by position
    entries = F.map_from_entries(F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p, F.col("term"))))))
    more = [c for c in index.columns if c not in ("term", "id", "tf", "positions", "length")]
    some = index.where(wants).groupBy("id", *more).agg(F.max("length").alias("length"), entries.alias("at"))

    def count(p: Phrase) -> Column:
        def fits(e: Column) -> Column:
            tests = []
            for i, w in enumerate(p.words):
                here = F.try_element_at("at", e["key"] + i)
                tests.append(F.coalesce(F.startswith(here, F.lit(w)) if p.prefix and i == len(p.words) - 1 else here == w, F.lit(False)))
            return reduce(lambda a, b: a & b, tests)

        return F.size(F.filter(F.map_entries("at"), fits)).cast("long")

    counted = some.select("id", *more, "length", *[count(p).alias(f"f{i}") for i, p in enumerate(phrases)])
    # exchanged once and read by both branches: the rows that match, and how many have each phrase
    counted = counted.repartition("id")
    having = counted.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(phrases))])
    rows, average = figures
    return _weighed(counted, query, phrases, having.select(F.lit(rows).cast("long").alias("_rows"), F.lit(float(average)).alias("_average"), "*"))


def _weighed(counted: DataFrame, query: Query, phrases: list[Phrase], figures: DataFrame) -> DataFrame:
    """(id, score) of counted (id, length, f0, f1, ...); figures is one row, whatever the data."""
    at = {p: i for i, p in enumerate(phrases)}
    has = [reduce(lambda a, b: a | b, [F.col(f"f{at[p]}") > 0 for p in g.phrases]) for g in query.terms]
    match = reduce(lambda a, b: (a & b) if query.mode == "AND" else (a | b), has)
    # no term matches a row of no words, so an empty corpus divides nothing by its average
    weight = F.lit(V.BM25_K1) * (1 - V.BM25_B + V.BM25_B * F.col("length") / F.col("_average"))
    parts = [F.when(F.col(f"f{i}") > 0, idf(F.col("_rows"), F.col(f"n{i}")) * F.col(f"f{i}") * (V.BM25_K1 + 1) / (F.col(f"f{i}") + weight)).otherwise(F.lit(0.0)) for i in range(len(phrases))]
    more = [c for c in counted.columns if c not in ("id", "length", *[f"f{i}" for i in range(len(phrases))])]
    return counted.where(match).crossJoin(F.broadcast(figures)).select("id", *more, reduce(lambda a, b: a + b, parts).alias("score"))


def search_postings(index: DataFrame, figures: tuple[int, float], query: Query, limit: int = V.KEYWORD_LIST) -> DataFrame:
    """The search of search() on a stored inverted index."""
    return scored_postings(index, figures, query).orderBy(F.col("score").desc(), "id").limit(limit)

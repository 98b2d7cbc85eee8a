"""Dense search, rank fusion and the hybrid search built of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions.text import hash_terms, snippet, strength, strip_accents
from quillspark.operators import lexical
from quillspark.operators.querylang import Query


def dot(vector: Column | str, other: list[float]) -> Column:
    """The dot product with a constant vector, in double precision."""
    pairs = F.zip_with(vector, F.array(*[F.lit(float(x)) for x in other]), lambda x, y: x.cast("double") * y)
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)


def dense_search(vectors: DataFrame, query: list[float], limit: int = V.DENSE_LIST, id_col: str = "vec_id", vector: str = "embedding", more: tuple[str, ...] = ()) -> DataFrame:
    """Exact search: (id, score) of the largest dot products, ties by id, and other columns. Filter vectors before, not after."""
    scored = vectors.select(F.col(id_col).alias("id"), *more, dot(vector, query).alias("score"))
    return scored.orderBy(F.col("score").desc(), "id").limit(limit)


def dense_search_many(vectors: DataFrame, queries: list[list[float]], limit: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, id, score) for a block of queries: one matrix product per Arrow batch.

    A task keeps the best of all its batches for each query, and hands them on once; the bests of the
    tasks are merged in two levels, so what one task sorts does not grow with the vectors.
    """
    wanted = np.asarray(queries, np.float64).T
    asked = wanted.shape[1]

    def best(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(ids) > 4 * limit:
            floor = np.partition(scores, len(scores) - limit)[len(scores) - limit]
            ids, scores = ids[scores >= floor], scores[scores >= floor]
        order = np.lexsort((ids, -scores))[:limit]
        return ids[order], scores[order]

    def run(batches):
        top = [(np.zeros(0, np.int64), np.zeros(0))] * asked
        for batch in batches:
            ids = batch.column(0).to_numpy()
            scores = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, len(wanted)) @ wanted
            top = [best(np.concatenate([i, ids]), np.concatenate([s, scores[:, q]])) for q, (i, s) in enumerate(top)]
        for q, (ids, scores) in enumerate(top):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q), pa.int32()), pa.array(ids, pa.int64()), pa.array(scores)], names=["query", "id", "score"])

    out = vectors.select(F.col(id_col).cast("long").alias("id"), vector).where(F.size(vector) == len(wanted)).mapInArrow(run, "query int, id long, score double")
    out = out.withColumn("_shard", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (("query", "_shard"), ("query",)):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id"))
        out = out.withColumn("_r", rank).where(F.col("_r") <= limit)
    return out.drop("_r", "_shard")


def dense_search_blocks(vectors: DataFrame, asked: DataFrame, limit: int, id_col: str = "vec_id", vector: str = "embedding", block: int = 256) -> DataFrame:
    """(query, id, score) for every row of asked, whose ids name the queries; at most ``block`` queries are in one matrix product."""
    out, names, wanted = None, [], []

    def searched() -> DataFrame:
        ids = F.array(*[F.lit(x).cast("long") for x in names])
        found = dense_search_many(vectors, wanted, limit, id_col, vector).withColumn("query", F.element_at(ids, F.col("query") + 1))
        return found if out is None else out.unionByName(found)

    for r in asked.where(F.col(vector).isNotNull()).select(id_col, vector).orderBy(id_col).toLocalIterator():
        names.append(r[0])
        wanted.append(list(r[1]))
        if len(names) == block:
            out = searched()
            names, wanted = [], []
    if names:
        out = searched()
    return vectors.sparkSession.createDataFrame([], "query long, id long, score double") if out is None else out


def similarity_of(vectors: DataFrame, ids: DataFrame, query: list[float], id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, score) of given ids, whether or not they were found by vector."""
    return vectors.select(F.col(id_col).alias("id"), vector).join(ids.select("id").distinct(), "id", "left_semi").select("id", dot(vector, query).alias("score"))


def hash_embedding(text: Column, dim: int = 256) -> Column:
    """A bag-of-words vector by hashed words, of unit length; an empty text has the zero vector."""
    words = F.regexp_extract_all(strip_accents(F.lower(F.coalesce(text, F.lit("")))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

    def spread(buckets: Column) -> Column:
        counts = F.aggregate(buckets, F.array_repeat(F.lit(0.0), dim), lambda a, b: F.transform(a, lambda x, i: F.when(i == b, x + 1).otherwise(x)))
        return counts

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))

    return unit(spread(hash_terms(words, dim)))


def hash_embedding_rows(rows: DataFrame, id_col: str, text: str, dim: int = 256) -> DataFrame:
    """(id, bucket, value): the same vectors as sparse rows, for long texts."""
    words = F.regexp_extract_all(strip_accents(F.lower(F.coalesce(F.col(text), F.lit("")))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    each = rows.select(F.col(id_col).alias("id"), F.explode(hash_terms(words, dim)).alias("bucket")).groupBy("id", "bucket").agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("id")))
    return each.select("id", "bucket", (F.col("n") / norm).alias("value"))


def ranked(found: DataFrame, name: str, order: int, weight: float = 1.0) -> DataFrame:
    """A result list as (id, list, list_order, rank from 1, weight). Lists are short: they come from a limit."""
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), "id"))
    return found.select("id", F.lit(name).alias("list"), F.lit(order).alias("list_order"), rank.alias("rank"), F.lit(weight).alias("weight"))


def fuse(lists: list[DataFrame], k: int = V.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion: (id, score, lists, first_list, first_rank); ties go to the earlier list, then rank."""
    every = lists[0]
    for one in lists[1:]:
        every = every.unionByName(one)
    grouped = every.groupBy("id").agg(
        F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"),
        F.array_sort(F.collect_list(F.struct("list_order", "rank", "list"))).alias("_from"),
    )
    first = F.get("_from", F.lit(0))
    return grouped.select("id", "score", F.transform("_from", lambda x: x["list"]).alias("lists"), first["list_order"].alias("first_list"), first["rank"].alias("first_rank"))


def cap_per_document(hits: DataFrame, most: int = V.MAX_HITS_PER_DOCUMENT, limit: int | None = None) -> DataFrame:
    """Hits (id, doc_id, score, first_list, first_rank) with at most so many of a document, best first."""
    order = [F.col("score").desc(), F.col("first_list"), F.col("first_rank"), F.col("id")]
    kept = hits.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col("_n") <= most).drop("_n").orderBy(*order)
    return kept if limit is None else kept.limit(limit)


def hybrid_search(
    chunks: DataFrame,
    query: Query,
    vectors: DataFrame | None = None,
    query_vector: list[float] | None = None,
    expanded: Query | None = None,
    visible: DataFrame | None = None,
    limit: int = 10,
    mode: str = "hybrid",
    index: tuple[DataFrame, tuple[int, float]] | None = None,
) -> DataFrame:
    """Keyword, thesaurus and dense lists fused, filtered, capped per document and limited.

    chunks: (chunk_id, doc_id, chunk); vectors: (chunk_id, embedding); visible: the doc_ids that
    filters and exclusions leave. Filters apply before the dense list, so it is never too short.
    mode: hybrid, keyword or semantic.

    index: a stored inverted index of the chunks with their doc_ids, and its figures; then vectors
    have a doc_id too. Without it all chunks are scanned. With it, the postings of the query's terms
    and the vectors are read, the lists (of bounded length) come to the driver, and of the chunks
    only those of the hits are read, 30 at most.
    """
    limit = min(max(limit, 1), 30)
    spark = chunks.sparkSession
    shown = None if visible is None else visible.select("doc_id").distinct()
    only = lambda rows: rows if shown is None else rows.join(shown, "doc_id", "left_semi")
    owners = chunks.select(F.col("chunk_id").alias("id"), "doc_id")
    words = None if index is not None else lexical.tokenised(chunks, "chunk_id", "chunk")
    known: list = []

    def listed(found: DataFrame) -> DataFrame:
        if index is None:
            return found
        rows = found.select("id", "doc_id", "score").collect()
        known.extend((r["id"], r["doc_id"]) for r in rows)
        return spark.createDataFrame(rows, "id long, doc_id long, score double")

    def keyword(q: Query) -> DataFrame:
        if index is not None:
            found = only(lexical.scored_postings(index[0], index[1], q))
        else:
            found = lexical.scored(words, q)
            found = found if shown is None else only(found.join(owners, "id")).drop("doc_id")
        return listed(found.orderBy(F.col("score").desc(), "id").limit(V.KEYWORD_LIST))

    lists = []
    if mode in ("hybrid", "keyword"):
        lists.append(ranked(keyword(query), "keyword", 0))
        if expanded is not None and expanded.expanded:
            lists.append(ranked(keyword(expanded), "thesaurus", 1, V.THESAURUS_WEIGHT))
    if mode in ("hybrid", "semantic") and vectors is not None and query_vector is not None:
        some = only(vectors) if index is not None else vectors.join(only(chunks.select("chunk_id", "doc_id")), "chunk_id", "left_semi")
        near = dense_search(some, query_vector, V.DENSE_LIST if visible is None else V.DENSE_LIST_FILTERED, "chunk_id", more=("doc_id",) if index is not None else ())
        lists.append(ranked(listed(near), "semantic", 2))
    if not lists:
        raise ValueError("no list to search: dense search needs vectors and a query vector")
    if index is not None:
        owners = spark.createDataFrame(sorted(set(known)), "id long, doc_id long")
    hits = cap_per_document(fuse(lists).join(owners, "id"), limit=limit)
    texts = chunks.select(F.col("chunk_id").alias("id"), "doc_id", "chunk")
    if index is not None:
        few = hits.collect()
        hits = spark.createDataFrame(few, hits.schema)
        ids = [r["id"] for r in few]
        # chunks and vectors are sorted by document, so both conditions skip files
        texts = texts.where(F.col("doc_id").isin([r["doc_id"] for r in few]) & F.col("id").isin(ids))
        vectors = None if vectors is None else vectors.where(F.col("doc_id").isin([r["doc_id"] for r in few]) & F.col("chunk_id").isin(ids))
    texts = texts.drop("doc_id")
    words = [w for p in query.phrases() for w in p.words]
    out = hits.join(texts, "id").withColumn("snippet", snippet(F.col("chunk"), words)).drop("chunk")
    if vectors is not None and query_vector is not None:
        near = similarity_of(vectors, hits, query_vector, "chunk_id").withColumnRenamed("score", "similarity")
        out = out.join(near, "id", "left").withColumn("strength", strength(F.col("similarity")))
    return out.orderBy(F.col("score").desc(), "first_list", "first_rank", "id")


def query_vector(spark: SparkSession, text: str, dim: int = 256) -> list[float]:
    """The hash embedding of one query text."""
    return list(spark.range(1).select(hash_embedding(F.lit(text), dim).alias("v")).first().v)

"""Enrichment ledgers: pages to recognise, pictures to describe, texts to embed."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions.text import filter_lines


def ocr_candidates(docs: DataFrame, page_chars: DataFrame, ledger: DataFrame, version: int, max_pages: int, retry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, page_no, first): pages to recognise, scans first.

    docs: (doc_id, ext, status, n_pages); page_chars: (doc_id, page_no, chars) of native text. A page
    is wanted if it is not done at this version and is in the ledger, or has almost no text.
    """
    some = docs.where((F.lower("ext") == ".pdf") & F.col("status").isin("ok", "no_text") & (F.col("n_pages") > 0))
    pages = some.select("doc_id", "status", F.explode(F.sequence(F.lit(1), F.least(F.col("n_pages"), F.lit(max_pages)).cast("int"))).alias("page_no"))
    seen = ledger.select("doc_id", "page_no", F.col("status").alias("_status"), F.col("version").alias("_version"))
    joined = pages.join(seen, ["doc_id", "page_no"], "left").join(page_chars, ["doc_id", "page_no"], "left")
    done = (F.col("_version") == version) & (~F.col("_status").isin(*retry) if retry else F.lit(True))
    wanted = ~F.coalesce(done, F.lit(False)) & (F.col("_version").isNotNull() | (F.coalesce("chars", F.lit(0)) < V.OCR_CANDIDATE_CHARS))
    return joined.where(wanted).select("doc_id", "page_no", (F.col("status") == "no_text").alias("first"))


def recognised(pages: DataFrame, engine: Callable[[bytes], str]) -> DataFrame:
    """(doc_id, page_no, status, text): an engine's text, noise lines removed; text, empty or error.

    pages: (doc_id, page_no, image). The engine runs in Python workers; it is made once a worker by
    what it closes over, and an error concerns its page only.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts, errors = [], []
            for image in batch.column("image").to_pylist():
                try:
                    texts.append(engine(image))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - any failure of an engine is a result
                    texts.append("")
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page_no"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["doc_id", "page_no", "raw", "error"])

    raw = pages.select("doc_id", "page_no", "image").mapInArrow(run, "doc_id long, page_no int, raw string, error string")
    text = raw.withColumn("text", filter_lines(F.col("raw")))
    status = F.when(F.col("error").isNotNull(), "error").when(F.length("text") < V.OCR_LEAST_CHARS, "empty").otherwise("text")
    return text.select("doc_id", "page_no", status.alias("status"), "text", "error")


def run_in_batches(work: DataFrame, call: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame], None], batch: int, minutes: float | None = None, most_failures: int | None = None) -> dict[str, int]:
    """Does ordered work in batches and keeps each before the next; how many rows had which status.

    call: rows to results with a status, ``error`` for a failure; save: keeps a batch's results. The
    run ends when the time is up, or when all of the last ``most_failures`` results (or of a whole
    batch, if that is smaller) are failures: then the engine is down, not a page bad. What is not
    done is found again by the next run. Work is fixed when the run begins.
    """
    end = None if minutes is None else time.monotonic() + 60 * minutes
    order = work.withColumn("_place", F.monotonically_increasing_id()).persist()
    counts: dict[str, int] = {}
    failures, after = 0, -1
    try:
        while end is None or time.monotonic() < end:
            some = order.where(F.col("_place") > after).orderBy("_place").limit(batch).persist()
            last = some.agg(F.max("_place")).first()[0]
            if last is None:
                break
            done = call(some.drop("_place")).persist()
            each = {r["status"]: r["count"] for r in done.groupBy("status").count().collect()}
            save(done)
            for k, n in each.items():
                counts[k] = counts.get(k, 0) + n
            done.unpersist()
            some.unpersist()
            after = last
            failures = failures + each["error"] if set(each) == {"error"} else 0
            if most_failures is not None and failures >= min(most_failures, batch):
                break
    finally:
        order.unpersist()
    return counts


def is_picture_page(share: Column, native_chars: Column, ocr_chars: Column, ocr_enabled: bool) -> Column:
    """Whether a page is to be described: by its picture share if it has text, else if recognition found little."""
    little = ocr_chars < V.PICTURE_TEXT_CHARS
    waiting = F.lit(False) if ocr_enabled else F.lit(True)
    return F.when(native_chars > 0, share >= V.PICTURE_SHARE).otherwise(F.coalesce(little, waiting))


def picture_state(longer_side: Column) -> Column:
    return F.when(longer_side < V.PICTURE_MIN_SIDE, "small").otherwise("todo")


def described(occurrences: DataFrame, cache: DataFrame, describe: Callable[[bytes], str], model: str, version: int) -> tuple[DataFrame, DataFrame]:
    """Occurrences with their answers, and the new cache rows: one call for each distinct picture.

    occurrences: (doc_id, page_no, image_no, sha1, image); cache: (sha1, model, version, answer).
    """
    known = cache.where((F.col("model") == model) & (F.col("version") == version)).select("sha1", "answer")
    todo = occurrences.join(known, "sha1", "left_anti").groupBy("sha1").agg(F.first("image").alias("image"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            answers = []
            for image in batch.column("image").to_pylist():
                try:
                    answers.append(describe(image))
                except Exception:  # noqa: BLE001 - a failed call is tried again by a later run
                    answers.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("sha1"), pa.array(answers, pa.string())], names=["sha1", "answer"])

    new = todo.mapInArrow(run, "sha1 string, answer string")
    every = known.unionByName(new)
    return occurrences.drop("image").join(every, "sha1", "left"), new.where("answer is not null").select("sha1", F.lit(model).alias("model"), F.lit(version).alias("version"), "answer")


def answered(pictures: DataFrame, describe: Callable[[bytes], str]) -> DataFrame:
    """Adds answer and status (described or error) to pictures (..., image), one call each; image goes."""
    names = [c for c in pictures.columns if c != "image"]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            answers = []
            for image in batch.column("image").to_pylist():
                try:
                    answers.append(describe(image))
                except Exception:  # noqa: BLE001 - a failed call is a result, and is tried again by a later run
                    answers.append(None)
            states = ["error" if a is None else "described" for a in answers]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(answers, pa.string()), pa.array(states, pa.string())], names=[*names, "answer", "status"])

    return pictures.mapInArrow(run, pictures.drop("image").limit(0).withColumn("answer", F.lit(None).cast("string")).withColumn("status", F.lit("")).schema)


def picture_jobs(candidates: DataFrame, chunks: DataFrame, picture_chunks: DataFrame, ocr_pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text, native_chars, ocr_chars): what goes along with the pictures of a page.

    text: the page's chunks in order, without those that describe pictures; native_chars: without
    recognised ones too. chunks: (chunk_id, doc_id, page_no, seq, chunk); picture_chunks: (chunk_id);
    ocr_pages: (doc_id, page_no, first_seq): from which chunk on the page's text was recognised.
    """
    texts = chunks.join(picture_chunks.select("chunk_id"), "chunk_id", "left_anti").join(ocr_pages, ["doc_id", "page_no"], "left")
    is_ocr = F.coalesce(F.col("seq") >= F.col("first_seq"), F.lit(False))
    each = texts.groupBy("doc_id", "page_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "").alias("text"),
        F.sum(F.when(is_ocr, F.lit(0)).otherwise(F.length("chunk"))).alias("native_chars"),
        F.sum(F.when(is_ocr, F.length("chunk")).otherwise(F.lit(0))).alias("ocr_chars"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return candidates.select("doc_id", "page_no").distinct().join(each, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text"), zero("native_chars"), zero("ocr_chars"))


def first_uses(occurrences: DataFrame, order: list[str]) -> DataFrame:
    """Adds use: described for the first occurrence of a picture, reused for later ones."""
    rank = F.row_number().over(Window.partitionBy("sha1").orderBy(*order))
    return occurrences.withColumn("use", F.when(rank == 1, "described").otherwise("reused"))


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(chunk_id, embedding): vectors of unit length from a model that takes a list of texts."""

    def run(batches: Iterator[pa.RecordBatch]):
        import numpy as np

        for batch in batches:
            vectors = np.asarray(embed(batch.column("text").to_pylist()), np.float64)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(unit.astype(np.float32).tolist(), pa.list_(pa.float32()))], names=["chunk_id", "embedding"])

    return chunks.select("chunk_id", F.col("text")).mapInArrow(run, "chunk_id long, embedding array<float>")


def sampled(pictures: DataFrame, seed: int, per_document: int, limit: int) -> DataFrame:
    """A repeatable sample: at most so many pictures of a document, in the order of a seeded hash."""
    key = F.xxhash64("sha1", F.lit(seed))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(key, "sha1"))
    return pictures.withColumn("_r", rank).where(F.col("_r") <= per_document).drop("_r").orderBy(key, "sha1").limit(limit)


def compare_models(calls: DataFrame) -> DataFrame:
    """(model, n, failures, median_seconds) of a comparison's calls (model, seconds, error)."""
    return calls.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("failures"), F.median("seconds").alias("median_seconds"))

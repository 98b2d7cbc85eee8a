"""From raw documents to token ids: language, near copies, benchmark passages, personal data, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet
to the shared folder and reads it for the next. All stages but the last return the columns that
they got, whatever their names. A stage learns from its own input only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontam, langid, minhash, pii
from quillspark.llm.common import keep, read, shielded
from quillspark.llm.queries import pii_key, tokenizer_path

#: Near copies: words of a shingle, and percent of Jaccard similarity.
SHINGLE_WORDS, SIMILARITY = 5, 80
#: Benchmark items of which a document may have no window: with one it goes.
BENCHMARK_ITEMS = 1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language (no letter at all, or no text)."""
    profiles = langid.learn(docs.where(~langid.held_out()))
    return shielded(docs, ("lang_pred", "score"), lambda d: langid.predict(d, profiles).where(F.col("lang_pred") != langid.UNKNOWN))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies; rows of one doc_id stay or go together."""
    found = minhash.near_duplicates(docs, SHINGLE_WORDS, SIMILARITY)
    stay = keep(found.where("kept").select(F.col("doc_id").alias("__quill_id")).distinct(), "kept-ids")
    # a merge join at every size: the ids grow with the data, so they are never broadcast
    return docs.join(stay.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__quill_id")), "left_semi")


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars (if there) of the new texts."""
    return (out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out).select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document with a window of a benchmark item."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"), least_items=BENCHMARK_ITEMS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms of the same format."""
    return _counted(shielded(docs, ("pii_kinds",), lambda d: pii.pseudonymise(d, pii_key(spark))), docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of every text, and their number (in place of columns ids and n_tokens)."""
    out = bpe.encode(docs.drop("n_tokens"), tokenizer_path("byte_bpe_50k.json"))
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_dedup", near_copies),
    ("decontaminate", benchmark),
    ("pii", personal_data),
    ("bpe", token_ids),
]

#: A learned model and BPE cannot be written as SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs

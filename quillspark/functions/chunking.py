"""Lossless chunking of page texts.

A chunk ends at the last of the best separators between half the target size and the largest
size. Where the next chunk begins depends on the cut before, so one pattern goes from cut to cut:
the rest of a text that is short enough, else as much as ends in the best separator, else the most.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V


def chunk_pattern(breaks: tuple[str, ...] = V.CHUNK_BREAKS, target: int = V.CHUNK_TARGET, most: int = V.CHUNK_MAX) -> str:
    """The chunk that begins where the last one ends; characters are code points. A rest that is too long is told at one place."""
    least = target // 2
    ends = [rf".{{0,{most - least - len(s)}}}{re.escape(s)}" for s in breaks]
    return rf"(?s)\G(?:.{{1,{most}}}+\z|.{{{least}}}(?:" + "|".join([*ends, rf".{{{most - least}}}"]) + "))"


def cut_points(text: str, target: int = V.CHUNK_TARGET, most: int = V.CHUNK_MAX) -> list[int]:
    """The ends of the chunks of a text; the last is its length. The pattern's rule step by step, for one text in Python."""
    ends, at = [], 0
    while len(text) - at > most:
        window = text[at + target // 2 : at + most]
        found = ((window.rfind(s), len(s)) for s in V.CHUNK_BREAKS)
        place, size = next(((p, n) for p, n in found if p >= 0), (len(window), 0))
        at += target // 2 + place + size
        ends.append(at)
    if at < len(text):
        ends.append(len(text))
    return ends


def chunks_of(text: Column) -> Column:
    """The chunks of a text, in order; their concatenation is the text."""
    # most texts lack the first separator, and no chunk of theirs is searched for it
    first, *others = V.CHUNK_BREAKS
    cut = lambda breaks: F.regexp_extract_all(text, F.lit(chunk_pattern(breaks)), F.lit(0))
    return F.when(F.contains(text, F.lit(first)), cut(V.CHUNK_BREAKS)).otherwise(cut(tuple(others)))


def chunk_rows(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """One row per chunk: the other columns of docs, seq from 0, and chunk."""
    text = F.col(text) if isinstance(text, str) else text
    return docs.withColumn("_chunks", chunks_of(text)).select(*[c for c in docs.columns if c != "text"], F.posexplode("_chunks").alias("seq", "chunk"))


def chunk_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) to (doc_id, page_no, seq, chunk)."""
    return chunk_rows(pages.select("doc_id", "page_no", "text"))


def rebuilt(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """The texts again, from their chunks in the order of seq."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    return chunks.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["chunk"]), "").alias("text"))

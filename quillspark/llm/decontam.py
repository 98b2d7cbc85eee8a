"""Benchmark decontamination by a broadcast hash set of normalised word n-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z. A window is ``n`` consecutive
words of an item; an item of fewer words, but not none, is one window. The hashes of all windows
are a sorted array that is sent to every executor; documents are scanned at byte level with numpy,
and each hash hit is verified against the words of the window.

The set is made and sent in blocks of at most ``BLOCK_BYTES`` of item text (or one item, if that is
longer): about four times as much in arrays. A larger benchmark has more blocks, all of which look
at the documents in the same single pass; a worker holds one block at a time.

Null text has no words, nor has an item without text. Items with the same words each count; one
without item_id counts as an item, comes first in item_ids and is not named in digests. Rows are
kept one by one, also those with equal doc_id. scan() replaces columns of the names that it adds;
decontaminate() returns the columns that it got, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import flat, mix, prefix_hash, release, runs, shielded, span_hash, steps

WINDOW = 8
#: Item text of one block of windows.
BLOCK_BYTES = 16 << 20
ADDED = ("n_words", "hit_spans", "item_ids")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True
_STEP = np.uint64(0x9FB21C651E98DF25)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, and the starts and ends of their words."""
    low = _LOWER[data]
    start, end = runs(_WORD[low], offsets)
    return low, start, end


def window_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words, in order."""
    m = len(words) - n + 1
    out = np.zeros(max(m, 0), np.uint64)
    for i in range(n):
        out = mix(out * _STEP + words[i : i + m]) if m > 0 else out
    return out


class Words:
    """The words of a column of texts: lower-cased bytes, spans, rows and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low, self.start, self.end = word_spans(data, offsets)
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.hash = span_hash(prefix_hash(self.low), self.start, self.end)

    def window(self, first: int, size: int) -> bytes:
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.start[first : first + size].tolist(), self.end[first : first + size].tolist()))


class WindowSet:
    """The windows of a block of items.

    Their words are one text with single blanks; for each length the windows are sorted by hash, and
    each has its place in that text, its end and its item.
    """

    def __init__(self, items: list[tuple[object, str]], n: int = WINDOW):
        self.items = [i for i, _ in items]
        texts = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for _, t in items]
        offsets = np.cumsum([0, *map(len, texts)])
        words = Words(np.concatenate(texts) if texts else np.zeros(0, np.uint8), offsets)
        size = words.end - words.start
        ends = np.cumsum(size + 1)  # a blank after each word
        begins = ends - size - 1
        text = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
        inside = np.repeat(begins - words.start, size)
        source = np.concatenate([np.arange(a, b) for a, b in zip(words.start.tolist(), words.end.tolist())]) if len(size) else np.zeros(0, np.int64)
        text[source + inside] = words.low[source]
        self.text = text.tobytes()
        counts = np.bincount(words.row, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted(set(np.minimum(counts, n).tolist()) - {0}):
            first = np.arange(len(words.hash) - k + 1)
            own = words.row[first]
            fits = (own == words.row[first + k - 1]) & ((counts[own] >= n) if k == n else (counts[own] == k))
            first = first[fits]
            h = window_hash(words.hash, k)[first]
            order = np.lexsort((own[fits], h))
            first = first[order]
            self.by_size[k] = (h[order], begins[first], ends[first + k - 1] - 1, words.row[first])

    def hits(self, words: Words) -> Iterator[tuple[int, int, int, list]]:
        """(row, first word, words, item ids) of each verified window of the texts."""
        for size, (known, begin, end, item) in self.by_size.items():
            if len(words.hash) < size:
                continue
            h = window_hash(words.hash, size)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for i in np.flatnonzero((known[at] == h) & (words.row[: len(h)] == words.row[size - 1 :])).tolist():
                text = words.window(i, size)
                left, right = int(at[i]), int(np.searchsorted(known, h[i], "right"))
                found = [self.items[item[j]] for j in range(left, right) if self.text[begin[j] : end[j]] == text]
                if found:
                    yield int(words.row[i]), i, size, found


def _blocks(benchmark: DataFrame, n: int) -> Iterator[WindowSet]:
    """The items as sets of at most BLOCK_BYTES of text; the driver holds one at a time."""
    items, size = [], 0
    for r in benchmark.where("text is not null").select("item_id", "text", F.octet_length("text").alias("_bytes")).toLocalIterator():
        if items and size + r["_bytes"] > BLOCK_BYTES:
            yield WindowSet(items, n)
            items, size = [], 0
        items.append((r["item_id"], r["text"]))
        size += r["_bytes"]
    yield WindowSet(items, n)


def _ordered(ids: set) -> list:
    return sorted(ids, key=lambda x: (x is not None, x if x is not None else 0))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text") -> DataFrame:
    """docs with n_words, hit_spans (maximal runs of hit words) and item_ids (sorted, distinct).

    hit_spans has (start, end, first, words): byte offsets in the UTF-8 text, the index of the first
    hit word and the number of hit words.
    """
    blocks = [docs.sparkSession.sparkContext.broadcast(b) for b in _blocks(benchmark, n)]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    item = benchmark.schema["item_id"].dataType
    long = T.LongType()
    span = T.StructType([T.StructField(c, long) for c in ("start", "end", "first", "words")])
    added = [T.StructField("n_words", long), T.StructField("hit_spans", T.ArrayType(span)), T.StructField("item_ids", T.ArrayType(item))]
    spans_type = pa.list_(pa.struct([(c, pa.int64()) for c in span.names]))
    items_type = pa.list_(pa.int64() if isinstance(item, T.LongType) else pa.int32() if isinstance(item, T.IntegerType) else pa.string())

    def mark(known: WindowSet, words: Words, seen: list[set], marks: list[tuple[int, int]]) -> None:
        for row, i, size, ids in known.hits(words):
            seen[row].update(ids)
            marks.append((i, size))

    def done(part: pa.RecordBatch, words: Words, offsets: np.ndarray, seen: list[set], marks: list[tuple[int, int]]) -> pa.RecordBatch:
        first_word = np.searchsorted(words.start, offsets)
        hit = np.zeros(len(words.start) + 1, np.int64)
        for i, size in marks:
            hit[i] += 1
            hit[i + size] -= 1
        spans: list[list] = [[] for _ in range(part.num_rows)]
        for i, j in zip(*(x.tolist() for x in runs(np.cumsum(hit[:-1]) > 0, first_word))):
            r = int(words.row[i])
            spans[r].append({"start": int(words.start[i] - offsets[r]), "end": int(words.end[j - 1] - offsets[r]), "first": i - int(first_word[r]), "words": j - i})
        new = [pa.array(np.diff(first_word), pa.int64()), pa.array(spans, spans_type), pa.array([_ordered(s) for s in seen], items_type)]
        return pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *ADDED])

    def run(batches):
        release()
        for batch in batches:
            parts = [(p, [set() for _ in range(p.num_rows)], []) for p in steps([batch], text)]
            for block in blocks if len(blocks) > 1 else ():
                for part, seen, marks in parts:
                    mark(block.value, Words(*flat(part.column(text))), seen, marks)
                block.__dict__.pop("_value", None)  # the next block takes its place in memory
            for part, seen, marks in parts:
                data, offsets = flat(part.column(text))
                words = Words(data, offsets)
                if len(blocks) == 1:
                    mark(blocks[0].value, words, seen, marks)
                yield done(part, words, offsets, seen, marks)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, least_items: int = 2) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs.select("doc_id", "text"), benchmark, n)
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("item_ids") >= least_items).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, least_items: int = 2, remove: str = "documents", text: str = "text") -> DataFrame:
    """Drops documents with windows of ``least_items`` items or more, or (``spans``) cuts the hit spans out of every text.

    Cutting brings the words around a span together; what they form is not looked at again.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")

    def work(docs: DataFrame) -> DataFrame:
        found = scan(docs, benchmark, n, text)
        if remove == "documents":
            return found.where(F.size("item_ids") < least_items)
        body, hits = F.encode(F.col(text), "utf-8"), F.col("hit_spans")
        starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(hits, lambda s: s["end"]))
        ends = F.concat(F.transform(hits, lambda s: s["start"]), F.array(F.octet_length(text).cast("long")))
        # substring counts from 1; hit spans begin and end at whole characters
        left = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.decode(F.substring(body, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")), "utf-8"))
        return found.withColumn(text, F.when(F.size(hits) > 0, F.array_join(left, "")).otherwise(F.col(text)))

    return shielded(docs, [c for c in ADDED if c != text], work)

"""Token ids in binary files: canonical, length-limited Huffman codes from global counts.

A file is a sequence of blocks, each of which can be decoded alone. All integers are
little-endian. A block is

    magic b"QTB2", then uint64: size of the rest up to the final newline, documents, ids,
    checkpoints, bits, code book fingerprint;
    int64 doc_id and uint8 "has an id" of each document, uint64 ids of each document,
    uint64 bit offset of every ``STRIDE``-th id (the checkpoints), the bits, b"\\n"

Codes have at most ``LIMIT`` bits (package-merge over the counts of all documents), or as many as
the ids in use need, if that is more; so one table of 2**LIMIT entries decodes any id, and decoding
runs from all checkpoints of a block at once. The code book is its list of code lengths by id,
written beside the files as ``codebook``.

Files are sorted by doc_id (null first, then equal ids by their tokens); a document never spans
blocks. Spark's text writer writes them, one block a line, so any file system will do. Where a file
begins in the whole sequence is a sum over the tables of its writing task and of the tasks before,
joined to the files; neither goes through the driver.

The tokenizer is that of the tokenizers library; text is cut at spaces and line ends, each distinct chunk is
encoded once and kept in a bounded cache. That needs a tokenizer whose pre-tokenizer never joins
text across them and ignores them: the loader tries that with ``TRIALS`` random texts of awkward
characters, for each of the short cuts, and leaves out those that are not exact. Null text is
empty: only the end id.
"""

from __future__ import annotations

import json
import os
import random
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.bpe import Alphabet, load
from quillspark.llm.common import Remembered, keep, resident, scratch, steps

LIMIT = 16
#: Random texts, and their characters, on which a loaded tokenizer's short cuts are held against the library.
TRIALS, TRIAL_CHARS = 300, 40
STRIDE = 128
#: Ids after which a block ends.
BLOCK_IDS = 1 << 16
#: Blocks of a file, at most.
FILE_BLOCKS = 64
#: Entries of each generation of a worker's cache.
CACHE = 400_000
MAGIC = b"QTB2"


def pieces(text: str) -> list[str]:
    """The chunks between spaces and line ends."""
    text = text.replace("\n", " ")
    # of all blanks only the space is printable
    return text.split() if text.isprintable() else text.split(" ")


def apart(text: str) -> str:
    """text with full stops and commas cut off, unless one stands in a run of punctuation."""
    # the information separators are blanks to Python, but not to a tokenizer
    marks = [c for c in set(text) if not c.isalnum() and (not c.isspace() or c in "\x1c\x1d\x1e\x1f")]
    if any(m + x in text or x + m in text for m in marks for x in ".,"):
        return text
    return text.replace(".", " .").replace(",", " ,")


class _Packers(dict):
    """For each number of ids the function that packs so many."""

    def __init__(self, kind: str):
        self.kind = kind

    def __missing__(self, n: int):
        self[n] = struct.Struct(f"<{n}{self.kind}").pack
        return self[n]


class ChunkEncoder:
    """Ids of texts by a tokenizers file, as packed bytes, through a cache of the chunks between spaces and line ends.

    A text that is in normal form, has no special
    token and no capital sigma (whose lower case depends on its place) is lower-cased first, if the
    tokenizer does that anyway; then full stops and commas that stand alone are cut off, and a
    chunk's pieces go straight to the BPE model. All else goes through the whole tokenizer.
    """

    def __init__(self, data: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(data)
        self.kind = kind
        self.alphabet, self.packers = Alphabet(), _Packers("H" if kind == "<u2" else "I")
        self.tokenizer = Tokenizer.from_str(data)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        probe = "ab, c'd\n12 é <|x|>  y\n"
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.by_chunk = self._whole(probe) == b"".join(map(self._whole, pieces(probe))) and not any(" " in t["content"] or "\n" in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        pattern = split[0].get("pattern", {}).get("Regex", "") if len(split) == 2 else ""
        #: Whether letters, digits and punctuation are always apart, and case is folded after NFC.
        self.by_letter = self.by_chunk and normal == ["NFC", "Replace", "Lowercase"] and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and split[0]["behavior"] == "Removed" and split[0]["invert"]
        self.cut = regex.compile(pattern).findall if self.by_letter else None
        self._forget()
        texts = self._trials()
        whole = [self._whole(t) for t in texts]
        for cut in ("by_letter", "by_chunk"):
            if getattr(self, cut) and [self.encode(t) for t in texts] != whole:
                setattr(self, cut, False)
                if cut == "by_chunk":
                    self.by_letter = False
            self._forget()

    def _forget(self) -> None:
        self.plain, self.other = Remembered(self._plain_chunk, CACHE), Remembered(self._whole, CACHE)

    def _trials(self) -> list[str]:
        """The same random texts for every load: words, marks, digits, blanks of all kinds, special tokens, accents apart."""
        draw = random.Random(20240611)
        alphabet = [*"aabcdeeiillmnorsttuvBEIRSTÉŒß' '  \n.,.,!?-_/()<|>#@&12308½²", *"\t\r\u00a0\u3000\x85\x0b\x1c", *"éñüΣςσжяИ中国あ한עمक\u093f\u0301\u0327\u200d😀ﬁ", "'s", "'ll", "'T", " '", *self.special]
        return ["".join(draw.choices(alphabet, k=draw.randrange(1, TRIAL_CHARS))) for _ in range(TRIALS)]

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _packed(self, ids: list[int]) -> bytes:
        return self.packers[len(ids)](*ids)

    def _piece(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.translate(self.alphabet))]

    def _plain_chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that is ready for the model."""
        if chunk.isalpha():
            # ASCII letters stand for themselves in the alphabet of bytes
            return self._packed([t.id for t in self.model.tokenize(chunk)] if chunk.isascii() else self._piece(chunk))
        return self._packed([i for x in self.cut(chunk) for i in self._piece(x)])

    def encode(self, text: str) -> bytes:
        if not self.by_chunk:
            return self._whole(text)
        if self.by_letter and not any(x in text for x in self.special) and (text.isascii() or "Σ" not in text and unicodedata.is_normalized("NFC", text)):
            return b"".join(map(self.plain.__getitem__, pieces(apart(text.lower()))))
        return b"".join(map(self.other.__getitem__, pieces(text)))


def id_kind(path: str, end_id: int | None = None) -> str:
    """The smallest of uint16 and uint32, little-endian, that holds all ids of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), end_id or 0])
    return "<u2" if top < 1 << 16 else "<u4"


def tokenise(docs: DataFrame, path: str, end_id: int | None = 1, text: str = "text") -> DataFrame:
    """(doc_id, ids, counts): ids as bytes of id_kind(), with the end id.

    The last row of each task has no ids, but how often each id occurs in the task: pairs of int64.
    """
    spark = docs.sparkSession
    shared = load(spark, path)
    kind = id_kind(path, end_id)
    end = b"" if end_id is None else np.array([end_id], kind).tobytes()

    def run(batches):
        name, data = shared.value
        coder = resident(f"chunks {name} {kind}", lambda: ChunkEncoder(data, kind))
        total = np.zeros(1, np.int64)
        names = ["doc_id", "ids", "counts"]
        for batch in steps(batches, text):
            ids = [coder.encode(t or "") + end for t in batch.column(text).to_pylist()]
            n = np.bincount(np.frombuffer(b"".join(ids), kind), minlength=len(total))
            n[: len(total)] += total
            total = n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names=names)
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([np.stack([used, total[used]]).tobytes()], pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, ids binary, counts binary")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents; the vocabulary bounds what reaches the driver."""

    def run(batches):
        for batch in batches:
            for packed in batch.column("counts"):
                used, n = np.frombuffer(packed.as_py(), np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n)], names=["id", "n"])

    rows = tokens.where("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r.id for r in rows], default=0) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that do not occur.

    More ids than codes of that many bits take as many bits as they need.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n == 0:
        return lengths
    if n == 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, (n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    # levels[k] marks which of the merged items of level k are leaves; the first 2n - 2 of the last are taken
    levels, weights = [], leaf
    is_leaf = np.ones(n, bool)
    levels.append(is_leaf)
    for _ in range(limit - 1):
        even = len(weights) // 2 * 2
        packages = weights[0:even:2] + weights[1:even:2]
        both = np.concatenate([leaf, packages])
        kind = np.concatenate([np.ones(n, bool), np.zeros(len(packages), bool)])
        at = np.argsort(both, kind="stable")
        weights, is_leaf = both[at], kind[at]
        levels.append(is_leaf)
    take, bits = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = bits
    return lengths


class CodeBook:
    """Canonical codes by (length, id), the encoder and the table-driven decoder."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.limit = limit = max(LIMIT, int(self.lengths.max(initial=0)))
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        size = self.lengths[order].astype(np.int64)
        span = np.int64(1) << (limit - size)
        first = np.concatenate([[0], np.cumsum(span)[:-1]]) if len(order) else np.zeros(0, np.int64)
        self.codes = np.zeros(len(self.lengths), np.uint32)
        self.codes[order] = first >> (limit - size)
        self.symbol = np.zeros(1 << limit, np.uint32)
        self.step = np.zeros(1 << limit, np.int64)
        self.symbol[: int(span.sum())] = np.repeat(order, span)
        self.step[: int(span.sum())] = np.repeat(size, span)
        self.fingerprint = zlib.crc32(self.lengths.tobytes()) << 8 | limit

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray, int]:
        """The bits, the offsets of the checkpoints and the number of bits."""
        size = self.lengths[ids].astype(np.int64)
        if len(ids) and not size.all():
            raise ValueError("an id without a code")
        end = np.cumsum(size)
        start = end - size
        total = int(end[-1]) if len(end) else 0
        word, bit = start >> 5, start & 31
        wide = self.codes[ids].astype(np.uint64) << (64 - bit - size).astype(np.uint64)
        n = (total + 31) // 32 + 1
        high, low = (wide >> np.uint64(32)).astype(np.float64), (wide & np.uint64(0xFFFFFFFF)).astype(np.float64)
        # codes do not overlap, so sums are unions; they stay below 2**32 and are exact
        out = np.bincount(word, high, n) + np.bincount(word + 1, low, n + 1)[:n]
        return out.astype(np.uint64).astype(">u4").tobytes()[: (total + 7) // 8], start[::STRIDE].astype("<u8"), total

    def decode(self, data: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """n ids, read from all checkpoints side by side."""
        raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
        peek = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        lanes = len(checkpoints)
        out = np.zeros((lanes, STRIDE), np.uint32)
        at = checkpoints.astype(np.int64)
        most = (len(peek) - 1) * 8
        for i in range(STRIDE):
            key = (peek[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - self.limit)
            out[:, i] = self.symbol[key]
            at = np.minimum(at + self.step[key], most)
        return out.reshape(-1)[:n]

    def block(self, docs: list[tuple[int | None, np.ndarray]]) -> bytes:
        ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.uint32)
        bits, checkpoints, total = self.encode(ids)
        head = np.array([len(docs), len(ids), len(checkpoints), total, self.fingerprint], "<u8").tobytes()
        names = np.array([d or 0 for d, _ in docs], "<i8").tobytes() + np.array([d is not None for d, _ in docs], np.uint8).tobytes() + np.array([len(x) for _, x in docs], "<u8").tobytes()
        body = head + names + checkpoints.tobytes() + bits
        return MAGIC + np.array([len(body)], "<u8").tobytes() + body


def parse(data: bytes) -> Iterator[dict]:
    """The blocks of a file, not decoded: doc_ids (with None), counts, checkpoints, bits, fingerprint."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        size = int.from_bytes(data[at + 4 : at + 12], "little")
        body = data[at + 12 : at + 12 + size]
        if len(body) != size or data[at + 12 + size : at + 13 + size] != b"\n":
            raise ValueError(f"block at byte {at} is cut short")
        n_docs, n_ids, n_points, _, fingerprint = np.frombuffer(body, "<u8", 5).tolist()
        names = np.frombuffer(body, "<i8", n_docs, 40).tolist()
        known = np.frombuffer(body, np.uint8, n_docs, 40 + 8 * n_docs)
        counts = np.frombuffer(body, "<u8", n_docs, 40 + 9 * n_docs).astype(np.int64)
        p = 40 + 17 * n_docs
        yield {
            "doc_ids": [d if k else None for d, k in zip(names, known)], "counts": counts, "n_ids": n_ids, "fingerprint": fingerprint,
            "checkpoints": np.frombuffer(body, "<u8", n_points, p), "bits": body[p + 8 * n_points :],
        }
        at += 13 + size


def write(tokens: DataFrame, path: str, lengths: np.ndarray, kind: str) -> None:
    """Writes the rows of tokenise() that have ids as sorted block files under path/data and the code book under path/codebook."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(np.asarray(lengths, np.uint8))

    def run(batches):
        book = CodeBook(shared.value)
        docs, n = [], 0
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                docs.append((doc, np.frombuffer(ids.as_py() or b"", kind)))
                n += len(docs[-1][1])
                if n >= BLOCK_IDS:
                    yield one(book, docs)
                    docs, n = [], 0
        if docs:
            yield one(book, docs)

    def one(book, docs):
        return pa.RecordBatch.from_arrays([pa.array([book.block(docs)], pa.binary())], names=["block"])

    ordered = tokens.where("ids is not null").select("doc_id", "ids").repartitionByRange("doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", "ids")
    blocks = ordered.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value"))
    blocks.write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_BLOCKS).text(f"{path}/data")
    book = spark.createDataFrame([(shared.value.tobytes(),)], "lengths binary")
    book.coalesce(1).write.parquet(f"{path}/codebook")


def _starts(files: DataFrame) -> DataFrame:
    """(file, base): how many ids all files before have, from (file, n).

    A file's name has the number of the task that wrote it, in the order of doc_id, and its number
    there. Files are added up by task, tasks by thousands, and those in order: three short sums.
    """
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("long")
    files = files.select("file", "n", number(r"^part-(\d+)-").alias("task"), number(r"-c(\d+)[^-]*$").alias("at"))
    tasks = files.groupBy("task").agg(F.sum("n").alias("n")).withColumn("group", F.floor(F.col("task") / 1000))
    groups = tasks.groupBy("group").agg(F.sum("n").alias("n"))

    def before(keys: tuple[str, ...], order: str) -> Column:
        return F.sum("n").over(Window.partitionBy(*keys).orderBy(order)) - F.col("n")

    groups = groups.select("group", before((), "group").alias("_g"))
    tasks = tasks.select("task", "group", before(("group",), "task").alias("_t")).join(groups, "group")
    return files.select("file", "task", before(("task",), "at").alias("_f")).join(tasks, "task").select("file", (F.col("_f") + F.col("_t") + F.col("_g")).alias("base"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): decoded from the files; start counts the ids of all documents before.

    A first pass reads block heads only and adds up where each file begins.
    """
    lengths = np.frombuffer(spark.read.parquet(f"{path}/codebook").first().lengths, np.uint8)
    # path-free file names: the folder may be read by another scheme than it was written by
    files = spark.read.format("binaryFile").load(f"{path}/data").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def heads(batches):
        for batch in batches:
            n = [sum(b["n_ids"] for b in parse(content.as_py())) for content in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(n, pa.int64())], names=["file", "n"])

    starts = keep(_starts(keep(files.mapInArrow(heads, "file string, n long"), "token-file-sizes")), "token-file-starts")
    shared = spark.sparkContext.broadcast(lengths)

    def run(batches):
        book = CodeBook(shared.value)
        for batch in batches:
            for name, at, content in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), batch.column("content")):
                for b in parse(content.as_py()):
                    if b["fingerprint"] != book.fingerprint:
                        raise ValueError(f"{name} was written with another code book")
                    ids = book.decode(b["bits"], b["checkpoints"], b["n_ids"]).astype("<u4")
                    ends = np.cumsum(b["counts"])
                    parts = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), b["counts"].tolist())]
                    first = at + ends - b["counts"]
                    at += b["n_ids"]
                    yield pa.RecordBatch.from_arrays([pa.array(b["doc_ids"], pa.int64()), pa.array(first, pa.int64()), pa.array(b["counts"]), pa.array(parts, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    # Spark broadcasts the starts if they are few, by its own check of their size
    return files.join(starts, "file").select("file", "base", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int | None = 1) -> DataFrame:
    """Encodes documents, writes the files and reads them back; ids_crc32 is native."""
    spark = docs.sparkSession
    tokens = keep(tokenise(docs, tokenizer, end_id), "token-ids")
    path = scratch(spark, "token-files")
    kind = id_kind(tokenizer, end_id)
    write(tokens, path, code_lengths(count_ids(tokens)), kind)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

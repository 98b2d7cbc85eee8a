"""Byte-level BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a piece of text exactly one token can be the last one of its BPE encoding. An
automaton over the vocabulary (with suffix links) delivers all tokens that end at a position; a
token t of length l is the last one of prefix i if the last token u of prefix i - l and t are
compatible, that is if the BPE encoding of their joined bytes is u, t. Following the back-pointers
from the end gives the exact ids in time linear in the piece, however long it is.

Texts are split into pieces as the tokenizer file says (special tokens, then its pattern). Text
between two single spaces, with the runs of white space in it, is split and encoded once and kept
in a bounded cache.

Null text is empty text: no ids. Rows of equal doc_id are encoded one by one, and an empty table
gives an empty result; encode() and decode() replace the column that they add and keep all others.
"""

from __future__ import annotations

import hashlib
import json
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import Remembered, resident, steps

#: The pre-tokenizer pattern that a ByteLevel tokenizer file stands for; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of each generation of a worker's caches of pieces and chunks (later: those behind a blank), and pairs of tokens whose compatibility it keeps.
CACHE = 60_000
LATER_CACHE = 150_000
PAIRS = 300_000


def byte_alphabet() -> list[str]:
    """The printable character by which a byte-level vocabulary writes each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Alphabet(dict):
    """For each code point its UTF-8 bytes in the alphabet that byte-level vocabularies are written in."""

    def __init__(self):
        self.letters = byte_alphabet()

    def __missing__(self, point: int) -> str:
        self[point] = "".join(self.letters[b] for b in chr(point).encode("utf-8", "surrogatepass"))
        return self[point]


class PrefixBpe:
    """An encoder and decoder for a byte-level BPE tokenizer file of the tokenizers library."""

    def __init__(self, spec: dict):
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or model["end_of_word_suffix"]:
            raise ValueError("not a plain byte-level BPE file")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.alphabet = Alphabet()
        byte_of = {c: b for b, c in enumerate(self.alphabet.letters)}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for word, i in self.vocab.items():
            self.bytes[i] = bytes(map(byte_of.__getitem__, word))
        for word, i in self.special.items():
            self.bytes[i] = word.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, whole = (self.vocab[a], self.vocab[b]), self.vocab[a + b]
            self.rank.setdefault(pair, r)
            self.made.setdefault(pair, whole)
            self.parts.setdefault(whole, pair)
        self.birth = {whole: self.rank[pair] for whole, pair in self.parts.items()}
        self.words = ahocorasick.Automaton()
        for word, i in self.vocab.items():
            if len(word) == 1 or self._stands_alone(i):
                self.words.add_word(word, (len(word), i))
        self.words.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.runs = _has_runs
        self.single = regex.compile(r"(?<=\S) (?=\S)").split
        self.size = size
        self.fits: dict[int, bool] = {}
        self.pieces = Remembered(self._packed_piece, CACHE)
        self.first = Remembered(self._packed, CACHE)
        self.later = Remembered(lambda x: self._packed(" " + x), LATER_CACHE)
        self.text = [str(i) for i in range(size)]

    def _stands_alone(self, token: int) -> bool:
        """Whether a token's own bytes encode to it: its two parts do not combine earlier in another way."""
        if token not in self.parts:
            return False
        left, right = self.parts[token]
        return self._compatible(left, right, self.birth[token])

    def _compatible(self, left: int, right: int, limit: int | None = None) -> bool:
        """Whether no merge across the border of two tokens comes before a merge inside them that undoes it.

        The border is looked at as it was at any time: the token on the right of ``left`` and the one
        on the left of ``right`` are taken apart in the reverse order of their merges. A merge of the
        two that stand there, which comes before the merge that hides one of them, breaks the pair.
        ``limit``: merges of this rank and later do not matter.
        """
        rank, birth, parts = self.rank, self.birth, self.parts
        until = float("inf") if limit is None else limit
        while True:
            across = rank.get((left, right))
            if across is not None and across < until:
                return False
            a, b = birth.get(left, -1), birth.get(right, -1)
            if a < 0 and b < 0:
                return True
            # Of equal births the merge on the left comes first, so the right one is undone first.
            if a > b:
                until, left = a, parts[left][1]
            else:
                # A merge across with the left part at the same rank would come first, from left to right.
                until, right = b + 1, parts[right][0]

    def compatible(self, left: int, right: int) -> bool:
        key = left * self.size + right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one piece, by the dynamic programming over its prefixes."""
        word = piece.translate(self.alphabet)
        n = len(word)
        # the length of the last token of each prefix, and the token
        sizes, last = [0] * (n + 1), [-1] * (n + 1)
        known, count, compatible = self.fits.get, self.size, self.compatible
        for end, (size, token) in self.words.iter(word):
            at = end + 1
            if sizes[at]:
                continue
            before = at - size
            if before:
                if not sizes[before]:
                    continue
                fits = known(last[before] * count + token)
                if not (compatible(last[before], token) if fits is None else fits):
                    continue
            sizes[at], last[at] = size, token
        out = []
        at = n
        while at:
            if not sizes[at]:
                raise ValueError(f"no encoding of {piece!r}")
            out.append(last[at])
            at -= sizes[at]
        out.reverse()
        return out

    def _packed_piece(self, piece: str) -> bytes:
        ids = self.encode_piece(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _packed(self, text: str) -> bytes:
        """Ids, as uint32, of a text without special tokens."""
        body = text[1:] if text[:1] == " " else text
        # letters alone are one piece, and so is a mark behind them
        if body.isalpha():
            return self._packed_piece(text)
        if body[:-1].isalpha() and body[-1] in ".,;:!?":
            return self._piece(text[:-1]) + self.pieces[text[-1]]
        return b"".join(map(self._piece, self.split(text)))

    def _piece(self, piece: str) -> bytes:
        # letters behind a blank are a chunk as well, so they are kept once
        return self.later[piece[1:]] if piece[:1] == " " and piece[1:].isalpha() else self.pieces[piece]

    def _spaced(self, text: str) -> bytes:
        # a piece never goes across a single blank between others; it begins with it
        first, *rest = self.single(text) if self.runs(text) else text.split(" ")
        return self.first[first] + b"".join(map(self.later.__getitem__, rest))

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as little-endian uint32."""
        if self.cut is None:
            return self._spaced(text)
        parts = self.cut(text)
        return b"".join(self.special[part].to_bytes(4, "little") if i % 2 else self._spaced(part) for i, part in enumerate(parts))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _has_runs(text: str) -> bool:
    """Whether text may begin or end with white space, or have a blank beside other white space."""
    if not text.replace("\n", " ").isprintable():  # other white space, perhaps
        return True
    return "  " in text or " \n" in text or "\n " in text or text[:1].isspace() or text[-1:].isspace()


def worker_encoder(shared) -> PrefixBpe:
    """The encoder of this worker process, made once from the broadcast tokenizer file."""
    name, data = shared.value
    return resident(f"bpe {name}", lambda: PrefixBpe(json.loads(data)))


def load(spark: SparkSession, path: str):
    """The tokenizer file (a few megabytes, of fixed size) and its digest as a broadcast."""
    with open(path, encoding="utf-8") as f:
        data = f.read()
    return spark.sparkContext.broadcast((hashlib.sha256(data.encode()).hexdigest(), data))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256 of the ids decoded again."""
    spark = docs.sparkSession
    shared = load(spark, path)

    def run(batches):
        coder = worker_encoder(shared)
        text_of = coder.text.__getitem__
        for batch in steps(batches):
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids = coder.encode(text or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(text_of, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, text: str = "text", column: str = "ids") -> DataFrame:
    """docs with an array of ids (replacing a column of that name)."""
    spark = docs.sparkSession
    shared = load(spark, path)
    docs = docs.drop(column)
    names = docs.columns

    def run(batches):
        coder = worker_encoder(shared)
        for batch in steps(batches, text):
            packed = [coder.encode_packed(x or "") for x in batch.column(text).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*names, column])

    return docs.mapInArrow(run, _with(docs, column, "array<int>"))


def decode(rows: DataFrame, path: str, column: str = "ids", text: str = "text") -> DataFrame:
    """rows with the text of their ids (null ids: empty text)."""
    spark = rows.sparkSession
    shared = load(spark, path)
    rows = rows.drop(text)
    names = rows.columns

    def run(batches):
        coder = worker_encoder(shared)
        for batch in batches:
            texts = pa.array([coder.decode(x or []) for x in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*names, text])

    return rows.mapInArrow(run, _with(rows, text, "string"))


def _with(df: DataFrame, column: str, kind: str):
    from pyspark.sql import functions as F

    return df.limit(0).withColumn(column, F.lit(None).cast(kind)).schema

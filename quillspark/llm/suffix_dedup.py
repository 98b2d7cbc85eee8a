"""Exact removal of long repeated strings by blockwise suffix sorting with a difference cover.

A byte is removed if a string of ``length`` bytes that covers it starts anywhere else too, in the
same document or another. Suffixes never reach beyond their document.

Which suffixes can share their first ``length`` bytes is narrowed first, without loss: every string
of that length is filed under the smallest hash among its ``ANCHOR``-byte substrings (its anchor),
so equal strings have equal anchors at equal offsets, and a suffix whose anchor occurs once in the
corpus is settled. Documents are dealt into buckets of bounded text, whose number follows the bytes
of the corpus; a bucket tells each anchor once, however many copies it holds, in packed arrays, and
gets back those that others have too.

The rest are sorted, one block of suffix buckets (all suffixes with the same anchor) at a time. In
a block the ranks of a difference cover sample (the positions whose remainder modulo 7 is 0, 1 or
3) by their first ``span`` bytes are precomputed by doubling. The suffixes of a bucket are sorted by
their first and last words; ties are resolved by the cover ranks: for any two suffixes there is a
shift below 7 that brings both to sample positions, so first word, cover rank and last words decide
equality over the full length, and no comparison is longer than that.

Anchors with more than ``HOT`` different contexts would make one bucket large. Their suffixes are
told apart by 128-bit names of their first ``length`` bytes instead, which spread over all tasks;
equal ones are told once for each bucket of documents.

Contexts are merged and sorted by their bytes. Answers go back to a bucket under the 64-bit name of
a context (or of a hot suffix's two names), so a context of the same bucket with the same name by
chance, 1e-8 for a bucket of 32 MB, would lose bytes that occur once; no repeat is ever missed.

Null text is empty. Rows are handled one by one, also those with equal or null doc_id (equal rows
repeat each other). Texts below ``length`` bytes lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import flat, mix, prefix_hash, shuffle_parts, span_hash

LENGTH = 200
ANCHOR = 72
#: Different contexts of an anchor from which on its suffixes are named one by one.
HOT = 1024
#: Bytes that one vectorised step looks at, and bytes of the texts of one sorted block.
STEP, SORT_BLOCK = 1 << 18, 1 << 17
#: Text of a bucket of documents, and text whose anchors and contexts come together in a shard; a task has one of each in memory at a time.
BUCKET_BYTES, SHARD_BYTES = 32 << 20, 64 << 20
_PLACE_BITS = np.uint64(22)
#: The difference cover modulo 7: each remainder is a difference of two of its members.
PERIOD, COVER = 7, (0, 1, 3)


def shift_of(r: int, s: int) -> int:
    """The least d for which r + d and s + d are both in the cover."""
    return next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER)


class Step:
    """The anchors of some pieces of text that stand one after another."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.length = length
        self.prefix = prefix_hash(data)
        width = length - ANCHOR + 1
        n = len(data) - length + 1
        empty = np.zeros(0, np.int64)
        self.place = self.low = self.high = empty
        self.name = self.context = np.zeros(0, np.uint64)
        if n <= 0:
            return
        at = np.arange(len(data) - ANCHOR + 1)
        gram = span_hash(self.prefix, at, at + ANCHOR)
        least = (gram >> _PLACE_BITS << _PLACE_BITS) | at.astype(np.uint64)
        reach = 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: reach - width], least[width - reach :])
        place = (least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        valid = np.ones(n + 1, np.int64)
        for o in offsets[1:].tolist():  # starts too near to the end of their piece
            valid[max(o - length + 1, 0) : min(o, n)] = 0
        starts = np.flatnonzero(valid[:n])
        if not len(starts):
            return
        place = place[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        self.place, self.low, self.high = place[first], starts[first], starts[np.r_[first[1:] - 1, len(starts) - 1]]
        self.name = gram[self.place]
        # what identifies the suffixes of an anchor's range: their joint text and where the anchor stands in it
        joint = span_hash(self.prefix, self.low, self.high + length)
        self.context = mix(joint ^ mix(self.name + (self.place - self.low).astype(np.uint64)))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The starts under the chosen anchors, and two 64-bit names of their strings."""
        count = self.high[which] - self.low[which] + 1
        start = np.repeat(self.low[which] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        return start, np.repeat(self.name[which], count), span_hash(self.prefix, start, start + self.length)


def pieces(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Bytes, offsets and (row, first byte) of pieces that together have every suffix of full length once."""
    data, offsets = flat(column)
    parts: list[np.ndarray] = []
    where: list[tuple[int, int]] = []
    size = 0

    def out():
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)]), where

    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for at in range(0, b - a - length + 1, STEP):
            part = data[a + at : min(a + at + STEP + length - 1, b)]
            if size and size + len(part) > 2 * STEP:
                yield out()
                parts, where, size = [], [], 0
            parts.append(part)
            where.append((row, at))
            size += len(part)
    if parts:
        yield out()


def _unpack(table: pa.Table, column: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """The joined arrays in a binary column, and the row that each element is from."""
    each = [np.frombuffer(x, kind) for x in table.column(column).to_pylist()]
    joined = np.concatenate(each) if each else np.zeros(0, kind)
    return joined, np.repeat(np.arange(len(each)), [len(x) for x in each])


def _cut(order: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Groups of equal keys: the key and the indices, given an order by key."""
    if len(order):
        sorted_key = key[order]
        for part in np.split(order, np.flatnonzero(sorted_key[1:] != sorted_key[:-1]) + 1):
            yield int(key[part[0]]), part


def _shards(name: np.ndarray, n: int) -> np.ndarray:
    return (mix(name) % np.uint64(n)).astype(np.int64)


def _told(table: pa.Table, length: int, shards: int) -> list[tuple]:
    """Each anchor of a bucket once: (shard, names, occurrences up to 2 and contexts up to HOT + 1 as a number)."""
    names, contexts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for data, offsets, _ in pieces(table.column("text").combine_chunks(), length):
        step = Step(data, offsets, length)
        names.append(step.name)
        contexts.append(step.context)
    names, contexts = np.concatenate(names), np.concatenate(contexts)
    order = np.lexsort((contexts, names))
    names, contexts = names[order], contexts[order]
    if not len(names):
        return []
    first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
    fresh = np.r_[True, (names[1:] != names[:-1]) | (contexts[1:] != contexts[:-1])]
    count = np.diff(np.r_[first, len(names)])
    kinds = np.add.reduceat(fresh.astype(np.int64), first)
    names = names[first]
    note = (np.minimum(count, 2) | np.minimum(kinds, HOT + 1) << 2).astype(np.uint16)
    shard = _shards(names, shards)
    return [(s, names[i].tobytes(), note[i].tobytes()) for s, i in _cut(np.argsort(shard, kind="stable"), shard)]


def _shared(table: pa.Table) -> list[tuple]:
    """For each bucket the anchors that occur twice or more in all, and which of them are hot."""
    names, row = _unpack(table, "names", np.uint64)
    note, _ = _unpack(table, "notes", np.uint16)
    bucket = table.column("bucket").to_numpy()[row]
    order = np.argsort(names, kind="stable")
    sorted_names = names[order]
    if not len(order):
        return []
    first = np.flatnonzero(np.r_[True, sorted_names[1:] != sorted_names[:-1]])
    size = np.diff(np.r_[first, len(order)])
    total = np.repeat(np.add.reduceat((note[order] & 3).astype(np.int64), first), size)
    kinds = np.repeat(np.add.reduceat((note[order] >> 2).astype(np.int64), first), size)
    keep = order[total >= 2]
    hot = (kinds > HOT)[total >= 2]
    back = np.zeros(len(names), bool)
    back[keep] = hot
    return [(b, names[i].tobytes(), back[i].tobytes()) for b, i in _cut(keep[np.argsort(bucket[keep], kind="stable")], bucket)]


def _lookup(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The names in a column of all rows, sorted, and the order that sorts them."""
    names, _ = _unpack(table, column, np.uint64)
    order = np.argsort(names)
    return names[order], order


def _contexts(docs: pa.Table, known: pa.Table, length: int, shards: int) -> list[tuple]:
    """The contexts of a bucket's shared anchors, each once: (shard, packed contexts, packed window names)."""
    names, order = _lookup(known, "names")
    hot = _unpack(known, "hot", np.uint8)[0][order].astype(bool)
    found: dict[int, dict[bytes, int]] = {}
    cold: dict[int, list] = {}
    window_a, window_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for data, offsets, _ in pieces(docs.column("text").combine_chunks(), length) if len(names) else ():
        step = Step(data, offsets, length)
        at = np.minimum(np.searchsorted(names, step.name), len(names) - 1)
        is_known = names[at] == step.name
        is_hot = is_known & hot[at]
        if is_hot.any():
            _, a, b = step.windows(np.flatnonzero(is_hot))
            window_a.append(a)
            window_b.append(b)
        for i in np.flatnonzero(is_known & ~is_hot).tolist():
            key = int(step.context[i])
            low, high = int(step.low[i]), int(step.high[i])
            text = data[low : high + length].tobytes()
            same = found.setdefault(key, {})
            if text in same:
                same[text] = 2
                continue
            same[text] = 1
            cold.setdefault(int(step.name[i]), []).append((key, int(step.place[i]) - low, high - low + 1, text))
    out: dict[int, list] = {}
    cold_names = sorted(cold)
    for name, shard in zip(cold_names, _shards(np.array(cold_names, np.uint64), shards).tolist()):
        for key, offset, count, text in cold[name]:
            out.setdefault(shard, []).append(np.array([name, key], "<u8").tobytes() + bytes([offset, count, found[key][text]]) + len(text).to_bytes(4, "little") + text)
    a, b = np.concatenate(window_a), np.concatenate(window_b)
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    twice = (np.diff(np.r_[first, len(a)]) > 1).astype(np.uint64)
    a, b = a[first], b[first]
    shard = _shards(b, shards)
    hot_rows = {s: np.stack([a[i], b[i], twice[i]]).tobytes() for s, i in _cut(np.argsort(shard, kind="stable"), shard)}
    return [(s, b"".join(out.get(s, [])), hot_rows.get(s, b"")) for s in sorted({*out, *hot_rows})]


def words_at(text: np.ndarray) -> np.ndarray:
    """For each position the eight bytes from there as a big-endian number (zeros beyond the end)."""
    out = np.zeros(len(text), np.uint64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    for k in range(8):
        out |= padded[k : k + len(text)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 0 of rows of keys, each of which is dense or any word."""
    out = np.unique(keys[0], return_inverse=True)[1].astype(np.int64)
    for k in keys[1:]:
        r = np.unique(k, return_inverse=True)[1].astype(np.int64)
        out = np.unique(out * (int(r.max(initial=0)) + 1) + r, return_inverse=True)[1].astype(np.int64)
    return out


def cover_ranks(text: np.ndarray, words: np.ndarray, span: int) -> np.ndarray:
    """Ranks of all sample positions by their first ``span`` bytes, a multiple of the period; others have 0."""
    n = len(text)
    at = np.arange(n)
    at = at[np.isin(at % PERIOD, COVER)]
    rank = np.zeros(n + span + PERIOD, np.int64)
    rank[at] = _rank(words[at] >> np.uint64(8)) + 1
    have = PERIOD
    while have < span:
        by = have if 2 * have <= span else span - have  # the second half may overlap the first
        new = _rank(rank[at], rank[at + by]) + 1
        rank = np.zeros_like(rank)
        rank[at] = new
        have += by
    return rank


def repeated_suffixes(text: np.ndarray, starts: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes share their first ``length`` bytes with another one of their bucket.

    Every suffix must have that many bytes before its text ends. The buckets are sorted by first
    and last words, and ties are resolved by cover ranks.
    """
    out = np.zeros(len(starts), bool)
    span = (length - PERIOD + 1) // PERIOD * PERIOD
    words = words_at(text)
    group = _rank(bucket, words[starts], words[starts + length - 8], words[starts + length - 16])
    tied = np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else np.zeros(0, np.int64)
    if not len(tied):
        return out
    rank = cover_ranks(text, words, span)
    top = int(rank.max()) + 1
    rest = starts[tied] % PERIOD
    for r in range(PERIOD):
        for s in range(r, PERIOD):
            some = tied[(rest == r) | (rest == s)]
            if len(some) < 2:
                continue
            key = group[some] * top + rank[starts[some] + shift_of(r, s)]
            order = np.argsort(key)
            key = key[order]
            same = key[1:] == key[:-1]
            twin = np.zeros(len(some), bool)
            twin[1:] = same
            twin[:-1] |= same
            out[some[order[twin]]] = True
    return out


def _decided(table: pa.Table, length: int) -> list[tuple]:
    """For each bucket of documents the runs of repeated starts by context, and the repeated window names."""
    # contexts that are equal to the byte are one; its suffixes are repeated if it occurs twice
    unique: dict[tuple[int, int, bytes], list] = {}
    for b, packed in zip(table.column("bucket").to_pylist(), table.column("contexts").to_pylist()):
        at = 0
        while at < len(packed):
            name, key = np.frombuffer(packed, "<u8", 2, at).tolist()
            offset, count, times = packed[at + 16 : at + 19]
            size = int.from_bytes(packed[at + 19 : at + 23], "little")
            text = packed[at + 23 : at + 23 + size]
            entry = unique.setdefault((name, offset, text), [0, key, count, []])
            entry[0] += times
            entry[3].append(b)
            at += 23 + size
    keys, lows, highs, buckets = [], [], [], []

    def tell(entry: list, flags: np.ndarray) -> None:
        edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):
            for b in entry[3]:
                keys.append(entry[1])
                lows.append(low)
                highs.append(high)
                buckets.append(b)

    def sort_block(block: list[tuple[tuple[int, int, bytes], list]]) -> None:
        text = np.frombuffer(b"".join(k[2] for k, _ in block), np.uint8)
        base = np.cumsum([0, *(len(k[2]) for k, _ in block)])[:-1]
        counts = np.array([e[2] for _, e in block])
        own = np.repeat(np.arange(len(block)), counts)
        inner = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
        names = _rank(np.array([k[0] for k, _ in block], np.uint64))
        offset = np.array([k[1] for k, _ in block])[own] - inner + LENGTH
        hit = repeated_suffixes(text, base[own] + inner, names[own] * (2 * LENGTH + 1) + offset, length)
        for i, (_, e) in enumerate(block):
            flags = hit[own == i] if len(block) < 3 else hit[int(counts[:i].sum()) : int(counts[: i + 1].sum())]
            tell(e, np.ones(e[2], bool) if e[0] > 1 else flags)

    block: list = []
    size = 0
    group: list = []
    for item in [*sorted(unique.items(), key=lambda x: x[0][0]), None]:
        if group and (item is None or item[0][0] != group[0][0][0]):
            if len(group) == 1:
                if group[0][1][0] > 1:
                    tell(group[0][1], np.ones(group[0][1][2], bool))
                # a context may repeat itself: overlapping equal strings under one anchor have one offset, so they are equal only if they are the same
            else:
                block += group
                size += sum(len(k[2]) for k, _ in group)
            group = []
            if size >= SORT_BLOCK:
                sort_block(block)
                block, size = [], 0
        if item is not None:
            group.append(item)
    if block:
        sort_block(block)

    each = [np.frombuffer(x, np.uint64).reshape(3, -1) for x in table.column("windows").to_pylist()]
    a, b, twice = np.concatenate(each, axis=1) if each else np.zeros((3, 0), np.uint64)
    row = np.repeat(np.arange(len(each)), [x.shape[1] for x in each])
    order = np.lexsort((a, b))
    first = np.flatnonzero(np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]) if len(a) else np.zeros(0, np.int64)
    times = np.add.reduceat((twice[order] + np.uint64(1)).astype(np.int64), first) if len(first) else first
    again = order[np.repeat(times > 1, np.diff(np.r_[first, len(order)]))]
    of = table.column("bucket").to_numpy()[row[again]] if len(again) else np.zeros(0, np.int64)
    windows = {bk: mix(a[i] ^ mix(b[i])).tobytes() for bk, i in _cut(again[np.argsort(of, kind="stable")], table.column("bucket").to_numpy()[row])} if len(again) else {}
    keys_, lows_, highs_, buckets_ = np.array(keys, np.uint64), np.array(lows, np.uint8), np.array(highs, np.uint8), np.array(buckets, np.int64)
    runs = {bk: (keys_[i].tobytes(), lows_[i].tobytes(), highs_[i].tobytes()) for bk, i in _cut(np.argsort(buckets_, kind="stable"), buckets_)}
    return [(bk, *runs.get(bk, (b"", b"", b"")), windows.get(bk, b"")) for bk in sorted({*runs, *windows})]


def _apply(docs: pa.Table, told: pa.Table, length: int) -> pa.Table:
    """spans and kept of each document of a bucket."""
    keys, order = _lookup(told, "keys")
    lows = _unpack(told, "lows", np.uint8)[0][order].astype(np.int64)
    highs = _unpack(told, "highs", np.uint8)[0][order].astype(np.int64)
    windows = np.sort(_unpack(told, "windows", np.uint64)[0])
    text = docs.column("text").combine_chunks()
    data, offsets = flat(text)
    # a place more for each document, so that each can be summed up alone
    change = np.zeros(len(data) + len(offsets), np.int32)
    for piece, at, where in pieces(text, length) if len(keys) or len(windows) else ():
        step = Step(piece, at, length)
        # from a place in the step to one in the bucket
        base = np.array([offsets[r] + r + first for r, first in where])
        moved = lambda x: x - at[p := np.searchsorted(at, x, "right") - 1] + base[p]  # noqa: B023, E731
        left, right = np.searchsorted(keys, step.context), np.searchsorted(keys, step.context, "right")
        count = right - left
        i = np.repeat(np.arange(len(count)), count)
        k = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + left[i]
        low = moved(step.low[i]) + lows[k]
        np.add.at(change, low, 1)
        np.add.at(change, low + (highs[k] - lows[k]) - 1 + length, -1)
        if len(windows):
            start, a, b = step.windows(np.arange(len(step.place)))
            name = mix(a ^ mix(b))
            hit = start[windows[np.minimum(np.searchsorted(windows, name), len(windows) - 1)] == name]
            hit = moved(hit)
            np.add.at(change, hit, 1)
            np.add.at(change, hit + length, -1)
    spans, kept = [], []
    for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        mine = np.cumsum(change[a + r : b + r], dtype=np.int32) > 0
        if mine.any():
            edges = np.flatnonzero(np.diff(np.r_[0, mine.astype(np.int8), 0]))
            spans.append([{"start": s, "end": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())])
            kept.append(data[a:b][~mine].tobytes())
        else:
            spans.append([])
            kept.append(data[a:b].tobytes())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": docs.column("doc_id"), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})


def _table(rows: list[tuple], names: tuple[str, ...], bucket: int | None = None) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    out = {n: pa.array(c, pa.int64() if n in ("shard", "bucket") else pa.binary()) for n, c in zip(names, columns)}
    if bucket is not None:
        out["bucket"] = pa.array([bucket] * len(rows), pa.int64())
    return pa.table(out)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, spans, kept): the removed byte spans (start, end) and the remaining bytes of every row."""
    if length < ANCHOR + 16 or length - ANCHOR + 1 > 255:
        raise ValueError(f"length must be {ANCHOR + 16} to {ANCHOR + 254}")
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(shuffle_parts(spark), -(-n_bytes // SHARD_BYTES))
    buckets = max(2 * shuffle_parts(spark), -(-n_bytes // BUCKET_BYTES))
    # the text takes part, so that rows without doc_id, or with one for many, spread
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("long").alias("bucket"), F.col("doc_id").cast("long"), "text")

    def tell(key, table):
        return _table(_told(table, length, shards), ("shard", "names", "notes"), key[0].as_py())

    def share(table):
        return _table(_shared(table), ("bucket", "names", "hot"))

    def gather(key, left, right):
        return _table(_contexts(left, right, length, shards) if left.num_rows and right.num_rows else [], ("shard", "contexts", "windows"), key[0].as_py())

    def decide(table):
        return _table(_decided(table, length), ("bucket", "keys", "lows", "highs", "windows"))

    def finish(left, right):
        return _apply(left, right, length)

    told = dealt.groupBy("bucket").applyInArrow(tell, "shard long, names binary, notes binary, bucket long")
    shared = told.groupBy("shard").applyInArrow(share, "bucket long, names binary, hot binary")
    contexts = dealt.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(gather, "shard long, contexts binary, windows binary, bucket long")
    decided = contexts.groupBy("shard").applyInArrow(decide, "bucket long, keys binary, lows binary, highs binary, windows binary")
    return dealt.groupBy("bucket").cogroup(decided.groupBy("bucket")).applyInArrow(finish, "doc_id long, spans array<struct<start:long,end:long>>, kept binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes."""
    out = repeated_spans(docs, length)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", (F.length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept")

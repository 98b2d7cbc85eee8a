"""Near-duplicate detection by bottom-k sketches from one hash function.

A document's set is its distinct word shingles; its sketch is the ``SKETCH`` smallest hashes of
the set. Documents with equal sets are one class from the start. A class of which so many retained
values are its own alone that no estimate can reach the limit has no link and is in no list: most
classes are like that, those with a passage common to many documents among them. The inverted lists
of the ``LISTED`` smallest retained values of the others generate overlaps; the estimate over the
sketch of the union filters them; the exact Jaccard similarity of the full sets verifies.

Of two sets with similarity s, the smallest hash of the union lies in both with probability s, so
both sketches share none of the smallest ``LISTED`` values with probability (1 - s)**LISTED, 3e-6
at 0.8. A pair is looked at in the list of the smallest value that it shares, and nowhere else. An
estimate below ``LEAST_ESTIMATE`` at that similarity has probability 1.5e-7. So a link at the very
threshold is missed with probability 3e-6, and more similar ones less often.

Links are found in two rounds. In the first every member of a list proposes only its best estimated
partner and the list's medoid (the member whose retained values are the most common). A list of more
than ``BLOCK`` members is dealt out at random into blocks for this, by another hash for each list,
so the work is linear in its members; a group of copies shares several lists, whose blocks overlap.
After these links are verified and contracted to components, the second round takes all remaining
pairs of different components that the estimate lets through, without any cap: the full sets of
their members, and of no others, go to the tasks of the lists, which verify the pairs in place and
tell links only. Lists that lie within one component by then are done. Of a longer one the members
outside its largest component meet all blocks, and those of the largest component only them, so no
task holds more than two blocks. What stays quadratic in its blocks is a long list of members that
share about half of their values with others each, but link with few.

Sets are compared as 64-bit hashes of shingles; two sets with equal size and two equal 64-bit sums
count as equal. Null and blank texts have no words: they have the empty set, which links with
nothing. Rows of equal doc_id with words count as linked with each other, whatever their texts. A
row without doc_id links like any other and never gives a component its name; a component without
any doc_id has none, and all its rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import flat, keep, mix, prefix_hash, release, runs, shuffle_parts, span_hash, steps

SKETCH, LISTED = 48, 8
#: Members up to which a list is one block of the second round, and members of a random block of the first round of longer ones.
BLOCK, FIRST_BLOCK = 256, 64
#: Least estimate that is verified; at 0.8 and 48 values it lies 5.7 standard deviations below.
LEAST_ESTIMATE = 0.47
_NONE = np.uint32(0xFFFFFFFF)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[9:14] = _WORD[32] = False
_STEP = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles."""
    low = _LOWER[data]
    start, end = runs(_WORD[low], offsets)
    words = span_hash(prefix_hash(low), start, end)
    first = np.searchsorted(start, offsets)
    m = len(words) - width + 1
    full = np.zeros(max(m, 0), np.uint64)
    for i in range(width):
        full = mix(full * _STEP + words[i : i + m]) if m > 0 else full
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield np.unique(full[a : b - width + 1])
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                h = mix(h * _STEP + words[i : i + 1])
            yield h
        else:
            yield full[:0]


#: What tells sets apart, and what tells rows apart.
_SET, _ROW = ("n", "h1", "h2"), ("doc_id", "text_hash")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")


def sketches(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, text_hash, n, h1, h2, sketch): set size, two order-free 64-bit sums over the set, smallest hashes as bytes."""

    def run(batches):
        release()
        for batch in steps(batches):
            data, offsets = flat(batch.column("text"))
            n, h1, h2, sk = [], [], [], []
            for s in shingle_sets(data, offsets, width):
                n.append(len(s))
                h1.append(int(mix(s).sum(dtype=np.uint64)))
                h2.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                sk.append(s[:SKETCH].tobytes())
            sums = [pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (h1, h2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _ROW), pa.array(n, pa.int64()), *sums, pa.array(sk, pa.binary())], names=[*_ROW, *_SET, "sketch"])

    return _rows(docs).mapInArrow(run, "doc_id long, text_hash long, n long, h1 long, h2 long, sketch binary")


def _explode(nodes: DataFrame) -> DataFrame:
    """One row per listed value: v, id, n and the sketch cut to 32 bits a value, plus node's comp if any."""
    names = [f for f in nodes.columns if f not in ("id", "n", "sketch")]

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("v", "row", "sketch")}
            for i, sk in enumerate(batch.column("sketch")):
                values = np.frombuffer(sk.as_py(), np.uint64)
                short = (values >> np.uint64(32)).astype(np.uint32).tobytes()
                for v in values[:LISTED].view(np.int64).tolist():
                    out["v"].append(v)
                    out["row"].append(i)
                    out["sketch"].append(short)
            at = pa.array(out["row"], pa.int64())
            cols = [pa.array(out["v"], pa.int64()), batch.column("id").take(at), batch.column("n").take(at), pa.array(out["sketch"], pa.binary()), *[batch.column(c).take(at) for c in names]]
            yield pa.RecordBatch.from_arrays(cols, names=["v", "id", "n", "sketch", *names])

    return nodes.mapInArrow(run, "v long, id long, n long, sketch binary" + "".join(f", {c} long" for c in names))


def _linkable(nodes: DataFrame) -> DataFrame:
    """The nodes that have enough values in common with others for any link.

    Counted over all nodes, whatever the lengths of their lists, so the rows are in proportion to the documents;
    and by the values that one node alone has, so no task gets all nodes of a common value.
    """

    def run(batches):
        for batch in batches:
            ids, values = [], []
            for i, sk in zip(batch.column("id").to_pylist(), batch.column("sketch")):
                x = np.frombuffer(sk.as_py(), np.uint64).view(np.int64)
                ids.append(np.full(len(x), i, np.int64))
                values.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (ids, values)], names=["id", "value"])

    values = nodes.select("id", "sketch").mapInArrow(run, "id long, value long")
    own = values.groupBy("value").agg(F.count("*").alias("_c"), F.min("id").alias("id")).where("_c = 1").groupBy("id").agg(F.count("*").alias("_own"))
    size = F.least(F.col("n"), F.lit(SKETCH))
    return nodes.join(own, "id", "left").where(size - F.coalesce("_own", F.lit(0)) >= F.ceil(LEAST_ESTIMATE * size - 1e-9)).drop("_own")


def _spread(nodes: DataFrame) -> DataFrame:
    """The rows of all lists with cell_i, cell_j and part for the first round: whole lists are cell 0, longer ones are random blocks from 1."""
    rows = _explode(nodes)
    large = keep(rows.groupBy("v").agg(F.count("*").alias("_m")).where(F.col("_m") > BLOCK), "minhash-large")
    if large.isEmpty():
        return rows.withColumns({"cell_i": F.lit(0), "cell_j": F.lit(0), "part": F.lit(0)})
    block = F.pmod(F.xxhash64("id", "v"), F.ceil(F.col("_m") / FIRST_BLOCK)).cast("int") + 1
    dealt = rows.join(large, "v", "left").withColumn("cell_i", F.coalesce(block, F.lit(0))).drop("_m")
    return dealt.withColumns({"cell_j": F.col("cell_i"), "part": F.lit(0)})


def _cells(nodes: DataFrame) -> DataFrame:
    """The rows of all lists, with comp; adds cell_i, cell_j and part for the second round, in which all pairs of different comps of a list meet.

    Lists of one comp are left out, and whole lists are cell (0, 0). A longer one is dealt into blocks, those
    of its largest comp first; a cell is a pair of blocks, unless both are of that comp.
    """
    n, comp = F.count("*").alias("_m"), F.col("comp")
    rows = _explode(nodes)
    lists = keep(rows.groupBy("v").agg(n, F.min(comp).alias("_low"), F.max(comp).alias("_high")).where("_low <> _high").select("v", "_m"), "minhash-lists")
    rows = rows.join(lists, "v")
    large = lists.where(F.col("_m") > BLOCK)
    if large.isEmpty():
        return rows.drop("_m").withColumns({"cell_i": F.lit(0), "cell_j": F.lit(0), "part": F.lit(0)})
    sizes = rows.where(F.col("_m") > BLOCK).groupBy("v", "comp").agg(n)
    top = sizes.groupBy("v").agg(F.max_by("comp", F.struct("_m", "comp")).alias("_top"), F.max("_m").alias("_most"))
    dealt = rows.join(keep(top, "minhash-top"), "v", "left")
    blocks = lambda members: F.ceil(members / BLOCK).cast("int")
    major, minor = blocks(F.col("_most")), blocks(F.col("_m") - F.col("_most"))
    is_major = comp == F.col("_top")
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    part = F.when(F.col("_top").isNull(), F.lit(0)).when(is_major, deal(major)).otherwise(major + deal(minor))
    meets = F.when(F.col("_top").isNull(), F.array(F.lit(0))).when(is_major, F.sequence(major, major + minor - 1)).otherwise(F.sequence(F.lit(0), major + minor - 1))
    dealt = dealt.withColumns({"part": part, "_o": meets}).withColumn("_o", F.explode("_o"))
    return dealt.withColumns({"cell_i": F.least("part", "_o"), "cell_j": F.greatest("part", "_o")}).drop("_m", "_most", "_top", "_o")


def estimates(sk: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-sketch estimate and smallest shared value of the pairs (a[i], b[i]) of rows of sk."""
    both = np.sort(np.concatenate([sk[a], sk[b]], axis=1), axis=1)
    twin = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _NONE)
    new = np.ones(both.shape, np.int16)
    new[:, 1:] -= twin
    rank = np.cumsum(new, axis=1)  # of the distinct values of the union
    # a shared value counts if it is among the k smallest of the union; a set that is not longer than its sketch is known whole
    most = np.where((n[a] <= SKETCH) & (n[b] <= SKETCH), 2 * SKETCH, SKETCH)
    real = (both != _NONE) & (rank <= most[:, None])
    shared = (twin & real[:, 1:]).sum(axis=1)
    union = real.sum(axis=1) - shared
    first = np.where(twin.any(axis=1), both[np.arange(len(a)), np.argmax(twin, axis=1) + 1], _NONE)
    return shared / np.maximum(union, 1), first


def _candidates(sk: np.ndarray, n: np.ndarray, part: np.ndarray, apart: bool, group: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, estimate, smallest shared value) of the pairs of a list that may pass, in blocks.

    apart: only pairs of different parts; group: only pairs of different groups.
    """
    need = np.ceil(LEAST_ESTIMATE * np.minimum(n, SKETCH) - 1e-9)
    rows = np.arange(len(sk))
    # values that one member alone has cannot be shared, and who has too few others has no partner here
    while True:
        if len(rows) < 2:
            return
        values, inverse, counts = np.unique(sk[rows], return_inverse=True, return_counts=True)
        common = (counts >= 2) & (values != _NONE)
        inverse = inverse.reshape(len(rows), -1)
        ok = common[inverse].sum(axis=1) >= need[rows]
        if ok.all():
            break
        rows = rows[ok]
    column = np.cumsum(common) - 1
    width = int(common.sum())
    for at in range(0, len(rows), 512):
        mine = rows[at : at + 512]
        shared = np.zeros((len(mine), len(rows)), np.float32)
        for left in range(0, width, 2048):
            use = common[inverse] & (column[inverse] >= left) & (column[inverse] < left + 2048)
            x = np.zeros((len(rows), min(2048, width - left)), np.float32)
            i, k = np.nonzero(use)
            x[i, column[inverse[i, k]] - left] = 1
            shared += x[at : at + 512] @ x.T
        least = LEAST_ESTIMATE * np.minimum(np.maximum(n[mine][:, None], n[rows][None, :]), SKETCH) - 1e-3
        ok = (shared >= least) & (np.arange(len(rows))[None, :] > np.arange(at, at + len(mine))[:, None])
        size_a, size_b = n[mine][:, None], n[rows][None, :]
        ok &= 10 * np.minimum(size_a, size_b) >= 8 * np.maximum(size_a, size_b)
        if apart:
            ok &= part[mine][:, None] != part[rows][None, :]
        if group is not None:
            ok &= group[mine][:, None] != group[rows][None, :]
        i, j = np.nonzero(ok)
        for cut in range(0, len(i), 1 << 15):
            a, b = mine[i[cut : cut + (1 << 15)]], rows[j[cut : cut + (1 << 15)]]
            e, first = estimates(sk, n, a, b)
            yield a, b, e, first


def _lists(batches: Iterator[pa.RecordBatch], least: int = 2) -> Iterator[pa.Table]:
    """Consecutive rows with equal (v, cell_i, cell_j), at least ``least`` of them."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("v", "cell_i", "cell_j")])
        edge = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1 if table.num_rows else np.zeros(0, np.int64)
        cuts = [0, *edge.tolist()]
        for a, b in zip(cuts, cuts[1:]):
            if b - a >= least:
                yield table.slice(a, b - a)
        rest = table.slice(cuts[-1]).combine_chunks()
    if rest is not None and rest.num_rows >= least:
        yield rest


def _members(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool, np.uint32]:
    """ids, set sizes, sketches and parts of a list; whether only different parts meet; the list's value, cut."""
    sk = np.full((table.num_rows, SKETCH), _NONE, np.uint32)
    for i, x in enumerate(table.column("sketch").to_pylist()):
        values = np.frombuffer(x, np.uint32)
        sk[i, : len(values)] = values
    here = np.uint32((int(table.column("v")[0].as_py()) % (1 << 64)) >> 32)
    apart = table.column("cell_i")[0].as_py() != table.column("cell_j")[0].as_py()
    return table.column("id").to_numpy(), table.column("n").to_numpy(), sk, table.column("part").to_numpy(), apart, here


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a list, or of a pair of its blocks, one after another in one task."""
    keys = ("v", "cell_i", "cell_j")
    return rows.repartition(shuffle_parts(rows.sparkSession), *keys).sortWithinPartitions(*keys, "id")


def _proposed(rows: DataFrame) -> DataFrame:
    """(a, b): every member's best estimated partner, and the partners of the list's medoid.

    (a, a) is a member of a long list whose block has no partner for it, or no other member.
    """

    def run(batches):
        out: list[list[int]] = [[], []]

        def add(x, y):
            swap = x > y
            out[0].extend(np.where(swap, y, x).tolist())
            out[1].extend(np.where(swap, x, y).tolist())

        def handed():
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])
            out[0], out[1] = [], []
            return batch

        for table in _lists(batches, least=1):
            if table.num_rows == 1 and table.column("cell_i")[0].as_py() == 0:
                continue
            ids, n, sk, part, apart, here = _members(table)
            dealt = table.column("cell_i")[0].as_py() > 0
            best, partner = np.full(len(ids), -1.0), np.zeros(len(ids), np.int64)
            medoid = -1
            if len(ids) > 2:
                values, inverse, counts = np.unique(sk, return_inverse=True, return_counts=True)
                counts[values == _NONE] = 0
                score = counts[inverse.reshape(sk.shape)].sum(axis=1) / np.minimum(n, SKETCH)
                medoid = int(np.argmax(score))
            for a, b, e, first in _candidates(sk, n, part, apart, None):
                # the blocks of a long list see few of its pairs, so they take any
                ok = (e >= LEAST_ESTIMATE) & ((first == here) | dealt)
                a, b, e = a[ok], b[ok], e[ok]
                star = (a == medoid) | (b == medoid)
                add(ids[a[star]], ids[b[star]])
                for x, y in ((a, b), (b, a)):
                    order = np.lexsort((y, -e, x))
                    x, y, top = x[order], y[order], e[order]
                    lead = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
                    x, y, top = x[lead], y[lead], top[lead]
                    better = top > best[x]
                    best[x[better]], partner[x[better]] = top[better], y[better]
            has = np.flatnonzero(best >= 0)
            add(ids[has], ids[partner[has]])
            if dealt:  # the partner may be in another block
                add(ids[best < 0], ids[best < 0])
            if len(out[0]) > 50_000:
                yield handed()
        yield handed()

    return _dealt(rows).mapInArrow(run, "a long, b long").distinct()


def _contested(rows: DataFrame) -> DataFrame:
    """The rows of lists whose member has a partner of another comp that the estimate lets through."""

    def run(batches):
        for table in _lists(batches):
            group = table.column("comp").to_numpy()
            if (group == group[0]).all():
                continue
            ids, n, sk, part, apart, here = _members(table)
            flag = np.zeros(len(ids), bool)
            for a, b, e, first in _candidates(sk, n, part, apart, group):
                ok = (e >= LEAST_ESTIMATE) & (first == here)
                flag[a[ok]] = flag[b[ok]] = True
            if flag.any():
                yield from table.filter(pa.array(flag)).combine_chunks().to_batches()

    return _dealt(rows).mapInArrow(run, rows.schema)


def _linked_in_lists(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between different comps, verified on full sets within the task of their list.

    Of the links that join the same two comps in one list the first is told; the others add nothing.
    """

    def run(batches):
        for table in _lists(batches):
            group = table.column("comp").to_numpy()
            ids, n, sk, part, apart, here = _members(table)
            items = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
            told: dict[tuple[int, int], tuple[int, int]] = {}
            for a, b, e, first in _candidates(sk, n, part, apart, group):
                ok = (e >= LEAST_ESTIMATE) & (first == here)
                for i, j in zip(a[ok].tolist(), b[ok].tolist()):
                    key = (min(group[i], group[j]), max(group[i], group[j]))
                    if key not in told and similar(items[i], items[j], percent):
                        told[key] = (min(ids[i], ids[j]), max(ids[i], ids[j]))
            if told:
                x, y = zip(*told.values())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return _dealt(rows.join(sets, "id")).mapInArrow(run, "a long, b long").where("a <> b").distinct()


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    z = np.concatenate([x, y])
    z.sort()
    both = int((z[1:] == z[:-1]).sum())
    return 100 * both >= percent * (len(z) - both)


def full_sets(docs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(id, items): the whole sets of the rows (id, doc_id, text_hash) of docs, as bytes."""
    wanted = rows.select("id", F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"))
    # a merge join at every size: rows grow with the data, so they are never broadcast
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_text"))
    chosen = _rows(docs).join(wanted.hint("merge"), same).select("id", "text")

    def run(batches):
        for batch in steps(batches):
            items = [s.tobytes() for s in shingle_sets(*flat(batch.column("text")), width)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(items, pa.binary())], names=["id", "items"])

    return chosen.mapInArrow(run, "id long, items binary").dropDuplicates(["id"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            ok = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column("x"), batch.column("y"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of all linked nodes: the smallest id reachable, by hooking and pointer jumping.

    Each round hangs every node under its smallest neighbour, follows the pointers, and contracts
    the links; their number at least halves. All tables stay distributed.
    """
    links = keep(links.where("a <> b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("up")), "up")
        for _ in range(3):
            above = up.select(F.col("id").alias("up"), F.col("up").alias("_top"))
            up = keep(up.join(above, "up").select("id", F.col("_top").alias("up")), "up")
        labels = up.withColumnRenamed("up", "comp") if labels is None else keep(labels.join(up.select(F.col("id").alias("comp"), F.col("up").alias("_up")), "comp", "left").select("id", F.coalesce("_up", "comp").alias("comp")), "labels")
        one, two = (up.select(F.col("id").alias(c), F.col("up").alias(f"_{c}")) for c in ("a", "b"))
        links = keep(links.join(one, "a").join(two, "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "links")
    return labels if labels is not None else links.sparkSession.createDataFrame([], "id long, comp long")


def _links_of_ids(known: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(a, b) between the classes of rows with one doc_id, or None if every doc_id has one set."""
    named = known.where("n > 0 and doc_id is not null")
    differ = F.lit(False)
    for c in _SET:
        differ = differ | (F.min(c) != F.max(c))
    several = keep(named.groupBy("doc_id").agg(differ.alias("_differ")).where("_differ").select("doc_id"), "several-sets")
    if several.isEmpty():
        return None
    of_id = keep(named.join(several, "doc_id").select("doc_id", *_SET).distinct().join(classes.select(*_SET, "id"), [*_SET]).select("doc_id", "id"), "classes-of-ids")
    least = of_id.groupBy("doc_id").agg(F.min("id").alias("a"))
    return of_id.join(least, "doc_id").select("a", F.col("id").alias("b")).where("a <> b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, one row per row of docs."""
    known = keep(sketches(docs, width), "sketches")
    # a class is a set; the row with its smallest doc_id stands for it
    one = [F.min("doc_id").alias("doc_id"), F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("text_hash")]
    classes = keep(known.where("n > 0").groupBy(*_SET).agg(*one).withColumn("id", F.monotonically_increasing_id()), "classes")
    mine = classes.select("id", *_SET, F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"))
    nodes = known.join(mine, [*_SET]).where(F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_text")))
    nodes = keep(nodes.select("id", "n", "sketch").dropDuplicates(["id"]), "nodes")
    nodes = keep(_linkable(nodes), "linkable")
    told = keep(_proposed(_spread(nodes)), "pairs")
    # both rounds need the sets of these members and of no others, so the texts are dealt out once
    ends = keep(told.select(F.col("a").alias("id")).union(told.select("b")).distinct(), "ends")
    sets = keep(full_sets(docs, classes.join(ends, "id"), width), "sets")
    links = keep(verified(told.where("a <> b"), sets, percent), "verified")
    of_ids = _links_of_ids(known, classes)
    links = links if of_ids is None else keep(links.union(of_ids), "links")
    found = components(links)
    # what is left between components
    some = nodes.join(ends, "id", "left_semi").join(found, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    contested = keep(_contested(_cells(keep(some, "members"))), "contested")
    if not contested.isEmpty():
        more = keep(_linked_in_lists(contested, sets, percent), "links")
        if not more.isEmpty():
            found = components(links.union(more))
    # components get the smallest doc_id of their classes; a class without links has its own
    linked = keep(classes.select("id", "doc_id").join(found, "id"), "linked")
    names = linked.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = linked.join(names, "comp").select("id", F.lit(True).alias("_linked"), "component_id")
    of_class = classes.join(named, "id", "left").select(*_SET, F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    of_class = keep(of_class, "class-components")
    out = known.join(of_class.withColumn("_found", F.lit(True)), [*_SET], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("_found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))

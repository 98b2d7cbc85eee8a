"""What the operators of this package share: tables, scratch folders, Arrow batches and byte hashing."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step handles; the arrays made for it take some fifty times as much.
STEP_BYTES = 1 << 19


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark, []).append(path)
    return path


#: The folders that each session has made.
_MADE: weakref.WeakKeyDictionary[SparkSession, list[str]] = weakref.WeakKeyDictionary()


def clean_up(spark: SparkSession) -> None:
    """Removes the tables that this session has written to the shared folder; their results must be read by then."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for made in _MADE.pop(spark, []):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made)
        path.getFileSystem(conf).delete(path, True)


#: Bytes of an Arrow batch while a table is written by keep(); Spark's own limit is eight times as much.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Smaller Arrow batches for what is run inside; afterwards the setting is as it was."""
    before = dict(spark.conf.getAll).get(_BATCH_SETTING)
    spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_SETTING)
        else:
            spark.conf.set(_BATCH_SETTING, before)


def keep(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shielded(docs: DataFrame, names: Iterable[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) with the columns of docs, in order; those that clash with ``names`` are set aside meanwhile."""
    taken = {n.lower() for n in names}
    aside = {c: f"__quill_aside_{i}" for i, c in enumerate(docs.columns) if c.lower() in taken}
    out = work(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices batches so that each holds at most ``limit`` text bytes, or one row."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
        total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column (null: empty) and the n + 1 offsets of its rows."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (two xor-shift-multiply rounds)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: One random 64-bit value for each byte, the same in every process.
BYTE_VALUE = np.random.Generator(np.random.PCG64(20240611)).integers(1, 2**63, 256).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * STEP_BYTES)
        for i, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps_ = np.full(size, b, np.uint64)
            steps_[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps_)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums by which span_hash() finds the hash of any span in constant time."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; they depend on the bytes alone, not on where they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes that lie within one row."""
    n = len(member)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = member.copy()
    first[1:] &= ~member[:-1] | edge[1:n]
    last = member.copy()
    last[:-1] &= ~member[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def table_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


class Remembered(dict):
    """What ``make`` returns for a key, for short keys in two generations of ``size`` entries.

    When the young generation is full it becomes the old one, and what is still in use moves back,
    so frequent keys stay and memory is bounded.
    """

    def __init__(self, make: Callable[[str], bytes], size: int, longest: int = 64):
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


_RESIDENT: dict[str, object] = {}


def resident(name: str, make: Callable[[], object]):
    """The one large object that a worker process keeps from task to task, made when another one was there or none."""
    if name not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[name] = make()
    return _RESIDENT[name]


def release() -> None:
    """Lets go of what an earlier job left in this worker process; called by tasks that need none of it."""
    _RESIDENT.clear()

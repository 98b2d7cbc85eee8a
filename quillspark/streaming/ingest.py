"""The incremental index as a stream: new files or events, watermarks, and upserts by micro-batch."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.incremental import Buckets, Versions, upsert


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 64, pattern: str | None = None) -> DataFrame:
    """Parquet files as they appear, at most so many a batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def deduplicated(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums of value by event-time window; rows later than the watermark are left out."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    grouped = events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), *keys, "n", "total")


def changes_to_table(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Adds the rows that each micro-batch changed to a Parquet table, in a folder for each batch.

    A batch that is run again writes its own folder again, so nothing is counted twice.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_changes(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The last state of each key in a table of changes."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    rest = [f.name for f in schema.fields if f.name not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def upsert_stream(stream: DataFrame, target: Versions | Buckets, keys: list[str], checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda x: x, order: str | None = None) -> StreamingQuery:
    """Writes each micro-batch into a table, replacing rows of equal keys.

    Of several rows with one key in a batch the one with the largest ``order`` counts. A batch that
    is run again after a failure replaces its own rows, so the result is the same. Versions writes
    the whole table for every batch; Buckets, for large ones, only the buckets that a batch touches.
    """

    def apply(batch: DataFrame, _: int) -> None:
        new = transform(batch)
        if order is not None:
            rest = [c for c in new.columns if c not in keys]
            new = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_x")).select(*keys, *[F.col(f"_x.{c}") for c in rest])
        new = new.persist()
        try:
            if new.isEmpty():
                return
            if isinstance(target, Buckets):
                target.upsert(new)
            else:
                target.write(new if target.current() is None else upsert(target.read(), new, keys))
        finally:
            new.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_for(query: StreamingQuery, minutes: float | None) -> bool:
    """Waits for a query, at most so many minutes; then it is stopped and goes on from its checkpoint next time."""
    end = None if minutes is None else time.monotonic() + 60 * minutes
    while query.isActive:
        if end is not None and time.monotonic() >= end:
            query.stop()
            return False
        query.awaitTermination(1)
    if query.exception() is not None:
        raise query.exception()
    return True

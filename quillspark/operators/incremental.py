"""Incremental maintenance: snapshot differences, upserts, purges and ledgers as joins.

What a folder holds is told by its newest state file, a small JSON document that is renamed into
place after all tables are written, and never changed. So a reader sees all tables before a change
or all after it, and a writer that is lost at any moment leaves the state before. The state before
the newest is kept with its tables.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V

#: Seconds by which modification times of the same file may differ.
SAME_TIME = 0.01
#: Segments of a table from which on a change merges them into one.
MAX_SEGMENTS = 8


def snapshot_diff(found: DataFrame, stored: DataFrame, retry: tuple[str, ...] = (), reextract_before: Column | None = None, max_bytes: int | None = None) -> DataFrame:
    """(path_key, action): unchanged, new, updated, skipped or gone.

    found: (path_key, size, mtime) on disk; stored: (path_key, size, mtime, status, indexed_at).
    """
    a = found.select("path_key", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.lit(True).alias("_found"))
    b = stored.select("path_key", F.col("size").alias("_old_size"), F.col("mtime").alias("_old_mtime"), "status", "indexed_at", F.lit(True).alias("_stored"))
    both = a.join(b, "path_key", "full_outer")
    same = (F.col("_size") == F.col("_old_size")) & (F.abs(F.col("_mtime") - F.col("_old_mtime")) < SAME_TIME)
    if retry:
        same = same & ~F.col("status").isin(*retry)
    if reextract_before is not None:
        same = same & (F.col("indexed_at") >= reextract_before)
    action = F.when(F.col("_found").isNull(), "gone").when(F.col("_stored") & F.coalesce(same, F.lit(False)), "unchanged")
    if max_bytes is not None:
        action = action.when(F.col("_size") > max_bytes, "skipped")
    return both.select("path_key", action.when(F.col("_stored").isNull(), "new").otherwise("updated").alias("action"))


def upsert(stored: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the rows of updates in place of those with equal keys."""
    return stored.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(updates, allowMissingColumns=True)


def insert_missing(stored: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """stored and those rows of more whose keys it lacks."""
    return stored.unionByName(more.join(stored.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def delete_docs(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of deleted documents (doc_id)."""
    ids = gone.select("doc_id").distinct()
    return {name: t.join(ids, "doc_id", "left_anti") for name, t in tables.items()}


def redo_pictures(picture_ledger: DataFrame, recognised: DataFrame) -> DataFrame:
    """The ledger of described documents without those that recognition has given text since: they are looked at again."""
    return picture_ledger.join(recognised.where("status = 'text'").select("doc_id").distinct(), "doc_id", "left_anti")


def purge_missing(stored: DataFrame, found: DataFrame, reachable: Column) -> DataFrame:
    """Stored documents that vanished although their root can be reached."""
    return stored.where(reachable).join(found.select("path_key"), "path_key", "left_anti")


def stale(derived: DataFrame, version: int) -> DataFrame:
    """Rows that an older version of the code derived."""
    return derived.where(F.coalesce(F.col("code_version"), F.lit(0)) < version)


def pending(work: DataFrame, ledger: DataFrame, keys: list[str], version: int, retry: tuple[str, ...] = ()) -> DataFrame:
    """Work that the ledger does not have as done at this version; retry: statuses to do again."""
    done = ledger.where(F.col("version") == version)
    if retry:
        done = done.where(~F.col("status").isin(*retry))
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def append_passages(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """Adds passages (doc_id, page_no, place, text) behind the chunks of their pages.

    seq goes on from the page's largest; a passage on a page that has text begins with an empty line.
    """
    last = chunks.groupBy("doc_id", "page_no").agg(F.max("seq").alias("_last"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("place"))
    more = passages.join(last, ["doc_id", "page_no"], "left").withColumn("_n", rank)
    gap = F.when(F.col("_last").isNotNull() | (F.col("_n") > 1), F.lit("\n\n")).otherwise(F.lit(""))
    seq = F.coalesce(F.col("_last"), F.lit(-1)) + F.col("_n")
    return chunks.select("doc_id", "page_no", "seq", "chunk").unionByName(more.select("doc_id", "page_no", seq.cast("int").alias("seq"), F.concat(gap, F.col("text")).alias("chunk")))


def jobs(work: DataFrame, group: str, order: str, size: int = V.OCR_PAGES_PER_JOB) -> DataFrame:
    """Adds job, from 0: at most so many consecutive rows of a group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return work.withColumn("job", F.floor((rank - 1) / size).cast("int"))


def failure_runs(log: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """(key, run, first, length) of consecutive failures: gaps and islands over a log."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = log.withColumn("_i", F.row_number().over(w)).withColumn("_bad", failed)
    islands = numbered.where("_bad").withColumn("run", F.col("_i") - F.row_number().over(w))
    return islands.groupBy(key, "run").agg(F.min(order[0]).alias("first"), F.count("*").alias("length"))


class States:
    """The state files of a folder: numbered JSON documents, the newest of which counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/_state")
        if not self.fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def get(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/_state/{number}", wholetext=True).first().value)

    def newest(self) -> tuple[int, dict]:
        """The newest number and state; 0 and nothing in an empty folder."""
        have = self.numbers()
        return (have[-1], self.get(have[-1])) if have else (0, {})

    def put(self, number: int, state: dict) -> None:
        """Writes a state beside the others and renames it into place; states before the one before go."""
        draft = self._path(f"{self.path}/_state/_draft-{number}")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self.fs.exists(self._path(f"{self.path}/_state/{number}")) or not self.fs.rename(draft, self._path(f"{self.path}/_state/{number}")):
            raise ValueError(f"another writer has made state {number} of {self.path}")
        for old in [n for n in self.numbers() if n < number - 1]:
            self.fs.delete(self._path(f"{self.path}/_state/{old}"), False)

    def drop(self, folder: str, used: set[str]) -> None:
        """Deletes the folders below one that no kept state uses."""
        top = self._path(f"{self.path}/{folder}")
        if self.fs.exists(top):
            for f in self.fs.listStatus(top):
                if f.getPath().getName() not in used:
                    self.fs.delete(f.getPath(), True)


class Versions:
    """One table that is written whole: a folder for each of its two newest versions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.states = States(spark, path)

    def current(self) -> int | None:
        return self.states.newest()[0] or None

    def read(self) -> DataFrame:
        version = self.current()
        if version is None:
            raise ValueError(f"{self.path} has no version")
        return self.spark.read.parquet(f"{self.path}/data/v={version}")

    def write(self, table: DataFrame) -> int:
        """Writes a new version, then its state, then drops what is older than the one before."""
        version = (self.current() or 0) + 1
        table.write.mode("overwrite").parquet(f"{self.path}/data/v={version}")
        self.states.put(version, {"version": version})
        self.states.drop("data", {f"v={n}" for n in self.states.numbers()})
        return version


class Buckets:
    """One table with keys, in folders by a hash of them; an upsert writes the folders that it touches anew."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 256):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.states = States(spark, path)

    def _read(self, folders: dict[str, int], some: list[int] | None = None) -> DataFrame | None:
        paths = [f"{self.path}/data/{n}/_bucket={b}" for b, n in folders.items() if some is None or int(b) in some]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame:
        rows = self._read(self.states.newest()[1])
        if rows is None:
            raise ValueError(f"{self.path} has no rows")
        return rows

    def upsert(self, updates: DataFrame) -> int:
        """Replaces the rows with the keys of updates; the number of the new state."""
        number, folders = self.states.newest()
        number += 1
        updates = updates.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        touched = sorted(r["_bucket"] for r in updates.select("_bucket").distinct().collect())
        old = self._read(folders, touched)
        if old is not None:
            old = old.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
            updates = upsert(old, updates, ["_bucket", *self.keys])
        updates.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{number}")
        self.states.put(number, {**folders, **{str(b): number for b in touched}})
        self.states.drop("data", {str(n) for k in self.states.numbers() for n in self.states.get(k).values()})
        return number


class Segments:
    """Tables of documents that change together, by small additions.

    A change has a number, the doc_ids that it takes away and rows for some tables, which are written
    as one segment each; nothing else is rewritten. A row counts unless a later change takes its
    doc_id away. A table of ``MAX_SEGMENTS`` segments is merged into one by the next change.
    ``layout`` names for each table the columns that its files are sorted by, so that filters on them
    skip files and row groups.
    """

    def __init__(self, spark: SparkSession, path: str, layout: dict[str, list[str]]):
        self.spark, self.path, self.layout = spark, path.rstrip("/"), layout
        self.states = States(spark, path)

    def state(self) -> dict:
        return self.states.newest()[1]

    def has(self, name: str) -> bool:
        return bool(self.state().get("tables", {}).get(name))

    def _live(self, state: dict, name: str) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.path}/{name}/{n}").withColumn("_change", F.lit(n)) for n in state.get("tables", {}).get(name, [])]
        if not parts:
            return None
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        first = min(state["tables"][name])
        gone = [self.spark.read.parquet(f"{self.path}/_gone/{n}").withColumn("_at", F.lit(n)) for n in state.get("gone", []) if n > first]
        if gone:
            last = reduce(DataFrame.unionByName, gone).groupBy(F.col("doc_id").alias("_doc")).agg(F.max("_at").alias("_at"))
            rows = rows.join(last, (F.col("doc_id") == F.col("_doc")) & (F.col("_at") > F.col("_change")), "left_anti")
        return rows.drop("_change")

    def read(self, name: str) -> DataFrame:
        rows = self._live(self.state(), name)
        if rows is None:
            raise ValueError(f"{self.path} has no table {name}")
        return rows

    def change(self, rows: dict[str, DataFrame], gone: DataFrame | None = None, notes: dict | None = None) -> int:
        """Takes documents (doc_id) away and adds rows; notes are kept in the state. Both take effect at once, with its last step."""
        number, state = self.states.newest()
        number += 1
        tables = {k: list(v) for k, v in state.get("tables", {}).items()}
        taken = list(state.get("gone", []))
        if gone is not None:
            gone.select("doc_id").distinct().write.mode("overwrite").parquet(f"{self.path}/_gone/{number}")
            taken.append(number)
        for name, more in rows.items():
            old = None
            if len(tables.get(name, [])) >= MAX_SEGMENTS:
                old = self._live(state, name)
                if gone is not None:
                    old = old.join(self.spark.read.parquet(f"{self.path}/_gone/{number}"), "doc_id", "left_anti")
            keys = self.layout.get(name, ["doc_id"])
            table = more if old is None else old.unionByName(more, allowMissingColumns=True)
            table.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{self.path}/{name}/{number}")
            tables[name] = [number] if old is not None else [*tables.get(name, []), number]
        first = min((min(v) for v in tables.values() if v), default=number)
        taken = [n for n in taken if n > first]
        self.states.put(number, {"tables": tables, "gone": taken, "notes": {**state.get("notes", {}), **(notes or {})}})
        kept = [self.states.get(n) for n in self.states.numbers()]
        for name in tables:
            self.states.drop(name, {str(n) for s in kept for n in s.get("tables", {}).get(name, [])})
        self.states.drop("_gone", {str(n) for s in kept for n in s.get("gone", [])})
        return number

    def replace(self, name: str, rows: DataFrame, notes: dict | None = None) -> int:
        """Puts rows in place of all of a table."""
        number, state = self.states.newest()
        number += 1
        keys = self.layout.get(name, ["doc_id"])
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{self.path}/{name}/{number}")
        self.states.put(number, {**state, "tables": {**state.get("tables", {}), name: [number]}, "notes": {**state.get("notes", {}), **(notes or {})}})
        return number

    def note(self, **notes) -> int:
        """Sets notes of the state and nothing else."""
        number, state = self.states.newest()
        self.states.put(number + 1, {**state, "notes": {**state.get("notes", {}), **notes}})
        return number + 1

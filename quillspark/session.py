"""Session construction and the few settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quillspark", cores: str | int = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings their own session.

    ``spark.checkpoint.dir`` is set to a temporary folder only here, never on a cluster.
    """
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.warehouse.dir": os.path.join(tempfile.gettempdir(), "quillspark-warehouse"),
        "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="quillspark-ckpt-"),
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's parquet tables, by whatever path scheme Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one in local mode where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-ckpt-")
    return base.rstrip("/")


def stored(df: DataFrame, label: str, *order: str, dealt: bool = True) -> DataFrame:
    """df written to the folder that driver and executors share, its files sorted by ``order``, and read again.

    dealt: each file has a range of its own, for which df is made twice; otherwise every task sorts its own file.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    table = df.repartitionByRange(*order) if order and dealt else df
    table = table.sortWithinPartitions(*order) if order else table
    table.write.parquet(path)
    return df.sparkSession.read.schema(table.schema).parquet(path)


def dealt_by(df: DataFrame, *keys: str, table: DataFrame | None = None) -> DataFrame:
    """df dealt out by keys, over partitions whose number follows that of its scan (or of the scan of ``table``, from which it comes).

    Aggregations by these keys, and more, then need no other exchange, and what a task holds does not grow with the input.
    """
    scanned = (df if table is None else table)._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * scanned), *keys)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if its scan has fewer (one small file, say).

    For work that is heavy for its bytes; tables of more files than cores are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df

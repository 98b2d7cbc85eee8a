"""Incremental maintenance, enrichment ledgers, cards and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import enrichment, incremental
from quillspark.plans import adapters
from quillspark.plans.registry import query
from quillspark.session import read_table, shared_folder

_OLD = "old AS (SELECT o_orderkey::VARCHAR AS path_key, o_custkey AS size, epoch(o_orderdate)::DOUBLE AS mtime, CASE WHEN o_orderkey % 50 = 0 THEN 'error' ELSE 'ok' END AS status FROM orders WHERE o_orderkey % 10 > 0)"
_NEW = "new AS (SELECT o_orderkey::VARCHAR AS path_key, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS size, epoch(o_orderdate)::DOUBLE + CASE WHEN o_orderkey % 11 = 0 THEN 0.005 WHEN o_orderkey % 13 = 0 THEN 5 ELSE 0 END AS mtime FROM orders WHERE o_orderkey % 9 > 0)"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = read_table(spark, sf_dir, "orders")
    k, t = F.col("o_orderkey"), F.unix_timestamp("o_orderdate").cast("double")
    old = o.where(k % 10 > 0).select(k.cast("string").alias("path_key"), F.col("o_custkey").alias("size"), t.alias("mtime"), F.when(k % 50 == 0, "error").otherwise("ok").alias("status"), F.lit(1).alias("indexed_at"))
    moved = F.when(k % 11 == 0, F.lit(0.005)).when(k % 13 == 0, F.lit(5.0)).otherwise(F.lit(0.0))
    new = o.where(k % 9 > 0).select(k.cast("string").alias("path_key"), F.when(k % 7 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("size"), (t + moved).alias("mtime"))
    return new, old


@query("snapshot_diff", f"""WITH {_OLD}, {_NEW} SELECT coalesce(new.path_key, old.path_key) AS path_key, CASE WHEN new.path_key IS NULL THEN 'gone' WHEN old.path_key IS NOT NULL AND new.size = old.size AND abs(new.mtime - old.mtime) < 0.01 AND status <> 'error' THEN 'unchanged'
  WHEN new.size > 1400 THEN 'skipped' WHEN old.path_key IS NULL THEN 'new' ELSE 'updated' END AS action FROM new FULL JOIN old ON new.path_key = old.path_key""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _snapshots(spark, sf_dir)
    return incremental.snapshot_diff(new, old, retry=("error",), max_bytes=1400)


@query("upsert_docs", f"WITH {_OLD}, {_NEW} SELECT coalesce(new.path_key, old.path_key) AS path_key, coalesce(new.size, old.size) AS size FROM new FULL JOIN old ON new.path_key = old.path_key")
def upsert_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _snapshots(spark, sf_dir)
    return incremental.upsert(old.select("path_key", "size"), new.select("path_key", "size"), ["path_key"])


@query("insert_missing", f"WITH {_OLD}, {_NEW} SELECT coalesce(old.path_key, new.path_key) AS path_key, coalesce(old.size, new.size) AS size FROM old FULL JOIN new ON new.path_key = old.path_key")
def insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _snapshots(spark, sf_dir)
    return incremental.insert_missing(old.select("path_key", "size"), new.select("path_key", "size"), ["path_key"])


@query("purge_missing", f"WITH {_OLD}, {_NEW} SELECT path_key FROM old WHERE size % 3 > 0 AND path_key NOT IN (SELECT path_key FROM new)")
def purge_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _snapshots(spark, sf_dir)
    return incremental.purge_missing(old, new, F.col("size") % 3 > 0).select("path_key")


@query("cascade_delete", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = read_table(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id")
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").alias("doc_id"))
    return incremental.delete_docs({"vectors": vectors}, gone)["vectors"].select("vec_id")


@query("ledger_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def ledger_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("version"), F.when(F.col("toxic") == 1, "error").otherwise("ok").alias("status"))
    return incremental.pending(read_table(spark, sf_dir, "documents").select("doc_id"), ledger, ["doc_id"], 1, ("error",))


@query("stale_derivations", "SELECT doc_id FROM labels WHERE quality < 1")
def stale_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.stale(read_table(spark, sf_dir, "labels").withColumn("code_version", F.col("quality")), 1).select("doc_id")


@query("append_passages", f"""WITH {adapters.LINE_PAGES_SQL}, more AS (SELECT doc_id, (toxic + 1)::INT AS page_no, 'note ' || k AS text, k FROM labels, (SELECT unnest([0, 1]) AS k)),
numbered AS (SELECT m.*, row_number() OVER (PARTITION BY m.doc_id, m.page_no ORDER BY k) AS r, p.doc_id IS NOT NULL AS has FROM more m LEFT JOIN line_pages p ON p.doc_id = m.doc_id AND p.page_no = m.page_no)
SELECT doc_id, page_no, (CASE WHEN has THEN 0 ELSE -1 END + r)::INT AS seq, (CASE WHEN has OR r > 1 THEN chr(10) || chr(10) ELSE '' END) || text AS chunk FROM numbered""")
def append_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = adapters.line_pages(spark, sf_dir).select("doc_id", "page_no", F.lit(0).alias("seq"), F.col("text").alias("chunk"))
    notes = read_table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") + 1).cast("int").alias("page_no"), F.explode(F.array(F.lit(0), F.lit(1))).alias("place"))
    notes = notes.withColumn("text", F.concat(F.lit("note "), F.col("place").cast("string")))
    return incremental.append_passages(pages, notes).where(F.endswith("chunk", F.lit("note 0")) | F.endswith("chunk", F.lit("note 1")))


@query("ocr_jobs20", f"WITH {adapters.LINE_PAGES_SQL} SELECT doc_id, page_no, ((row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1) // 20)::INT AS job FROM line_pages")
def ocr_jobs20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.jobs(adapters.line_pages(spark, sf_dir).select("doc_id", "page_no"), "doc_id", "page_no")


@query("failure_runs", "WITH n AS (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), b AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS run FROM n WHERE event_type = 'error') SELECT user_id, run::INT AS run, count(*)::BIGINT AS length FROM b GROUP BY user_id, run")
def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.failure_runs(read_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "run", "length")


@query("ocr_candidates", """WITH docs AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'no_text' ELSE 'ok' END AS status, (n_chars % 7)::INT AS n_pages FROM documents),
pages AS (SELECT doc_id, status, unnest(range(1, least(n_pages, 4) + 1)) AS page_no FROM docs WHERE n_pages > 0),
chars AS (SELECT doc_id, page_no, (doc_id * page_no) % 90 AS chars FROM pages WHERE status = 'ok'),
ledger AS (SELECT doc_id, 1 AS page_no, CASE WHEN toxic = 1 THEN 'error' ELSE 'text' END AS status, quality AS version FROM labels)
SELECT p.doc_id, p.page_no::INT AS page_no, p.status = 'no_text' AS first FROM pages p LEFT JOIN chars c USING (doc_id, page_no) LEFT JOIN ledger l ON l.doc_id = p.doc_id AND l.page_no = p.page_no
WHERE NOT coalesce(l.version = 1 AND l.status <> 'error', false) AND (l.version IS NOT NULL OR coalesce(chars, 0) < 50)""")
def ocr_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.lit(".pdf").alias("ext"), F.when(F.col("doc_id") % 5 == 0, "no_text").otherwise("ok").alias("status"), (F.col("n_chars") % 7).cast("int").alias("n_pages"))
    page = F.explode(F.sequence(F.lit(1), F.col("n_pages")))
    chars = d.where("status = 'ok' and n_pages > 0").select("doc_id", page.alias("page_no")).withColumn("chars", F.col("doc_id") * F.col("page_no") % 90)
    ledger = read_table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("page_no"), F.when(F.col("toxic") == 1, "error").otherwise("text").alias("status"), F.col("quality").alias("version"))
    return enrichment.ocr_candidates(d, chars, ledger, 1, 4, ("error",))


@query("picture_dedupe_sha1", "WITH o AS (SELECT doc_id, sha1(coalesce(text, '')) AS sha1 FROM documents) SELECT doc_id, sha1, CASE WHEN row_number() OVER (PARTITION BY sha1 ORDER BY doc_id) = 1 THEN 'described' ELSE 'reused' END AS use FROM o")
def picture_dedupe_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.first_uses(read_table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.coalesce("text", F.lit(""))).alias("sha1")), ["doc_id"])


@query("describe_candidates", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def describe_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("version"), F.lit("ok").alias("status"))
    return incremental.pending(read_table(spark, sf_dir, "documents").select("doc_id"), ledger, ["doc_id"], 1)


@query("model_comparison", "SELECT event_type AS model, count(*)::BIGINT AS n, count(*) FILTER (user_id % 9 = 0)::BIGINT AS failures, round(median(value), 6) AS median_seconds FROM events GROUP BY event_type")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("value").alias("seconds"), F.when(F.col("user_id") % 9 == 0, "x").alias("error"))
    return enrichment.compare_models(e).withColumn("median_seconds", F.round("median_seconds", 6))


@query("page_chars", f"WITH {adapters.LINE_PAGES_SQL} SELECT doc_id, page_no, sum(length(text))::BIGINT AS chars FROM line_pages GROUP BY doc_id, page_no")
def page_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.line_pages(spark, sf_dir).groupBy("doc_id", "page_no").agg(F.sum(F.length("text")).alias("chars"))


# ------------------------------------------------------------------ streams


@query("stream_ingest_counts", "SELECT time_bucket(INTERVAL 1 hour, ts)::VARCHAR AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream, windowed under a watermark; each micro-batch's changed windows go to a Parquet table."""
    import uuid

    from quillspark.streaming import ingest

    schema = read_table(spark, sf_dir, "events").schema
    # a file pattern keeps to the events table of the folder
    stream = ingest.file_stream(spark, sf_dir, schema, pattern="events.parquet")
    counts = ingest.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 hour", "10 minutes")
    path = f"{shared_folder(spark)}/hourly-{uuid.uuid4().hex}"
    ingest.changes_to_table(counts, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    newest = ingest.newest_changes(spark, f"{path}/table", counts.schema, ["start", "event_type"])
    return newest.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 minute THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS n FROM s GROUP BY ALL""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of work with at most half an hour between two events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    gap = F.col("ts").cast("double") - F.lag("ts").over(w).cast("double")
    s = e.withColumn("_new", F.when(gap > 1800, 1).otherwise(0)).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"))

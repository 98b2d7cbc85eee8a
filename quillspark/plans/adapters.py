"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import read_table, spread


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as indexed files: path, ext, status, title."""
    d = read_table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    size = F.length(F.trim(F.coalesce("text", F.lit(""))))
    status = F.when(size == 0, "empty").when(size < 15, "no_text").otherwise("ok")
    return d.select("doc_id", path.alias("path"), F.lower(path).alias("path_key"), F.lit(".txt").alias("ext"), status.alias("status"), F.split("text", "\n")[0].alias("title"), "text", "lang", "source", "n_chars")


#: The same in SQL, as a common table expression named docs.
DOCS_SQL = """docs AS (
  SELECT doc_id, '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, lower('/' || source || '/' || lang || '/' || doc_id || '.txt') AS path_key, '.txt' AS ext,
    CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 'empty' WHEN length(trim(coalesce(text, ''))) < 15 THEN 'no_text' ELSE 'ok' END AS status,
    string_split(text, chr(10))[1] AS title, text, lang, source, n_chars FROM documents)"""


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with host, domain and the folders of their URL path."""
    p = read_table(spark, sf_dir, "pages")
    rest = F.regexp_replace("url", r"^[a-z]+://", "")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    domain = F.array_join(F.slice(F.split(host, r"\."), -3, 3), ".")
    return p.select("page_id", "url", "html", host.alias("host"), domain.alias("domain"), path.alias("path"), F.filter(F.split(path, "/"), lambda x: x != "").alias("names"))


PAGES_SQL = """web AS (
  SELECT page_id, url, html, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
web_pages AS (
  SELECT *, array_to_string(string_split(host, '.')[-3:], '.') AS domain, [x FOR x IN string_split(path, '/') IF x <> ''] AS names FROM web)"""


def project_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as documents of projects: one project a customer, the priority as document type."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("project"),
        F.when(F.col("o_orderstatus") == "F", F.lit("9_Archive")).alias("collection"),
        F.concat(F.lit("Y"), F.year("o_orderdate").cast("string")).alias("subproject"),
        F.col("o_orderstatus").alias("section"),
        F.col("o_orderpriority").alias("doc_type"),
        F.col("o_orderdate").alias("mtime"),
        F.concat(F.lit("/p"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"),
    )


PROJECT_DOCS_SQL = """project_docs AS (
  SELECT o_orderkey AS doc_id, 'P' || o_custkey AS project, CASE WHEN o_orderstatus = 'F' THEN '9_Archive' END AS collection, 'Y' || year(o_orderdate) AS subproject,
    o_orderstatus AS section, o_orderpriority AS doc_type, o_orderdate AS mtime, '/p' || o_custkey || '/' || o_orderkey AS path FROM orders)"""


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as register rows: client, group, country; every third has no project."""
    c, n = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "nation")
    project = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("P"), F.col("c_custkey").cast("string")))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("row_id"), project.alias("project"), F.concat(F.lit("site "), F.col("n_name")).alias("name"), F.col("c_name").alias("client"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise(F.lit("")).alias("grp"), F.col("n_name").alias("country"),
        F.concat(F.col("c_mktsegment"), F.lit("-"), (F.col("c_custkey") % 7).cast("string")).alias("model"), (F.lit(1990) + F.col("c_custkey") % 30).cast("int").alias("year"),
    )


REGISTER_SQL = """register AS (
  SELECT c_custkey AS row_id, CASE WHEN c_custkey % 3 > 0 THEN 'P' || c_custkey END AS project, 'site ' || n_name AS name, c_name AS client,
    CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END AS grp, n_name AS country, c_mktsegment || '-' || (c_custkey % 7) AS model, (1990 + c_custkey % 30)::INT AS year
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents cut into pages of five lines: (doc_id, page_no, text)."""
    d = spread(read_table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "line")))
    return d.groupBy("doc_id", (F.floor(F.col("i") / 5) + 1).cast("int").alias("page_no")).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


LINE_PAGES_SQL = """lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
line_pages AS (SELECT doc_id, (i // 5 + 1)::INT AS page_no, string_agg(line, chr(10) ORDER BY i) AS text FROM lines GROUP BY doc_id, i // 5)"""

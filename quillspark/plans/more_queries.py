"""Further operators over the driver's tables: thesaurus joins, counts, numbering and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import control, enrichment, linkage, reports, retrieval
from quillspark.plans import adapters
from quillspark.plans.registry import query
from quillspark.session import read_table, spread


@query("root_counts", f"WITH {adapters.DOCS_SQL}, r AS (SELECT unnest(['/src1', '/src2/en', '/nowhere']) AS root) SELECT root, (SELECT count(*) FROM docs WHERE path_key = root OR starts_with(path_key, root || '/'))::BIGINT AS docs FROM r")
def root_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.root_counts(adapters.docs(spark, sf_dir), ["/src1", "/src2/en", "/nowhere"])


@query("natural_numbering", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT AS image_no FROM part")
def natural_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of a document numbered by name, image2 before image10."""
    name = F.concat(F.lit("image"), F.col("p_partkey").cast("string"), F.lit(".png"))
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(control.natural_key(name)))
    return read_table(spark, sf_dir, "part").select("p_partkey", rank.alias("image_no"))


@query("fresh_copies", "SELECT o_orderkey, o_orderkey % 7 > 0 AND (o_orderkey % 5 > 0) OR o_orderkey % 3 = 0 AS fresh FROM orders")
def fresh_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    size = F.when(k % 3 > 0, F.when(k % 7 > 0, F.lit(10)).otherwise(F.lit(11)))
    mtime = F.when(k % 5 > 0, F.lit(100.004)).otherwise(F.lit(100.5))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", control.is_fresh(size, mtime, F.lit(10), F.lit(100.0)).alias("fresh"))


@query("number_evidence", f"""WITH {adapters.PROJECT_DOCS_SQL}, pages AS (SELECT o_orderkey AS doc_id, unnest([1, 3]) AS page_no FROM orders),
each AS (SELECT '120' || lpad((doc_id % 40)::VARCHAR, 6, '0') AS number, project, doc_id, true AS in_path FROM project_docs WHERE doc_id % 2 = 0
  UNION ALL SELECT '100' || lpad((doc_id % 30)::VARCHAR, 6, '0'), project, doc_id, false FROM project_docs JOIN pages USING (doc_id) WHERE page_no <= 2 AND section = 'F'),
one AS (SELECT number, project, doc_id, bool_or(in_path) AS in_path FROM each GROUP BY ALL)
SELECT number, project, count(*)::BIGINT AS docs, count(*) FILTER (in_path)::BIGINT AS named FROM one GROUP BY number, project""")
def number_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.project_docs(spark, sf_dir)
    k = F.col("doc_id")
    pad = lambda n: F.lpad((k % n).cast("string"), 6, "0")
    path = F.when(k % 2 == 0, F.concat(F.lit("/x/120"), pad(40), F.lit("/a.pdf"))).otherwise(F.lit("/x/none.pdf"))
    docs = d.select("doc_id", "project", path.alias("path"), F.when(F.col("section") == "F", F.lit("facture")).otherwise(F.lit("plan")).alias("doc_type"))
    pages = d.select("doc_id", F.explode(F.array(F.lit(1), F.lit(3))).alias("page_no"), F.concat(F.lit("no 100"), pad(30)).alias("text"))
    return linkage.number_evidence(docs, pages)


@query("machine_mentions", f"""WITH {adapters.PROJECT_DOCS_SQL}, m AS (SELECT project, doc_id, 'Paloma' AS family, unnest(['Paloma ' || (doc_id % 4 + 1) || 'R', '']) AS model, true AS in_name FROM project_docs WHERE doc_id % 3 = 0
  UNION ALL SELECT project, doc_id, 'Hector', '', false FROM project_docs WHERE section = 'O')
SELECT project, family, model, count(*)::BIGINT AS docs, count(*) FILTER (in_name)::BIGINT AS name_docs FROM m GROUP BY ALL""")
def machine_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names count below the project's folder only; texts on first pages of evidence types."""
    d = adapters.project_docs(spark, sf_dir)
    k = F.col("doc_id")
    path = F.concat(F.lit("/astor 2R/"), "project", F.lit("/"), F.when(k % 3 == 0, F.concat(F.lit("paloma_"), (k % 4 + 1).cast("string"), F.lit("r.pdf"))).otherwise(F.lit("x.pdf")))
    docs = d.select("doc_id", "project", path.alias("path"), F.when(F.col("section") == "O", F.lit("offre")).otherwise(F.lit("sav")).alias("doc_type"))
    pages = d.select("doc_id", F.explode(F.array(F.struct(F.lit(2).alias("page_no"), F.lit("a Hector cell").alias("text")), F.struct(F.lit(4).alias("page_no"), F.lit("Delfi 3R").alias("text")))).alias("p")).select("doc_id", "p.page_no", "p.text")
    return linkage.confirmed(linkage.mentions(docs, pages)).drop("confirmed")


@query("paginated_texts", """WITH RECURSIVE b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
sized AS (SELECT doc_id, i, length(text)::BIGINT AS size, i % 5 = 4 AS heading FROM b WHERE doc_id % 2 <> 0),
r AS (SELECT doc_id, i, 1::BIGINT AS page_no, size AS used FROM sized WHERE i = 0
  UNION ALL SELECT s.doc_id, s.i, r.page_no + (CASE WHEN f THEN 1 ELSE 0 END), CASE WHEN f THEN s.size ELSE r.used + s.size END
  FROM r JOIN sized s ON s.doc_id = r.doc_id AND s.i = r.i + 1, LATERAL (SELECT r.used > 0 AND (r.used + s.size > 3000 OR s.heading AND r.used > 1500) AS f)),
p AS (SELECT doc_id, i, text, i // 3 + 1 AS page_no FROM b WHERE doc_id % 2 = 0 UNION ALL SELECT b.doc_id, b.i, b.text, r.page_no FROM b JOIN r ON r.doc_id = b.doc_id AND r.i = b.i)
SELECT doc_id, page_no::INT AS page_no, md5(string_agg(text, chr(10) ORDER BY i)) AS page_md5 FROM p GROUP BY doc_id, page_no""")
def paginated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every text: with even ids by break marks, with odd ones by size and headings."""
    d = spread(read_table(spark, sf_dir, "documents")).where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    even = F.col("doc_id") % 2 == 0
    blocks = d.withColumns({"is_heading": ~even & (F.col("i") % 5 == 4), "is_break": even & (F.col("i") % 3 == 0)})
    return reports.paginate_blocks(blocks).select("doc_id", "page_no", F.md5("text").alias("page_md5"))


@query("strength_labels", "SELECT event_id, CASE WHEN value >= 0.86 THEN 'strong' WHEN value >= 0.83 THEN 'medium' ELSE 'weak' END AS strength, CASE WHEN user_id < 1024 THEN user_id || ' B' END AS size, event_id || ' document' || CASE WHEN event_id = 1 THEN '' ELSE 's' END AS docs FROM events")
def strength_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    size = F.when(F.col("user_id") < 1024, text.size_label(F.col("user_id")))
    return e.select("event_id", text.strength(F.col("value")).alias("strength"), size.alias("size"), text.plural(F.col("event_id"), "document").alias("docs"))


@query("sampled_pictures", "WITH o AS (SELECT doc_id, source, sha1(coalesce(text, '')) AS sha1 FROM documents) SELECT count(*)::BIGINT AS n, max(c)::BIGINT AS most FROM (SELECT count(*) OVER (PARTITION BY source) AS c FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha1, doc_id) AS r FROM o) WHERE r <= 2)")
def sampled_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many a seeded sample takes, and from one document at most; which ones is the hash's choice."""
    o = spread(read_table(spark, sf_dir, "documents")).select(F.col("source").alias("doc_id"), F.sha1(F.concat(F.coalesce("text", F.lit("")), F.col("doc_id").cast("string"))).alias("sha1"))
    s = enrichment.sampled(o, 7, 2, 10_000).groupBy("doc_id").count()
    return s.agg(F.sum("count").alias("n"), F.max("count").alias("most"))


@query("hash_search_whole", r"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}_]+')) AS w FROM documents),
b AS (SELECT doc_id, (('0x' || substr(md5(w), 7, 2) || substr(md5(w), 5, 2) || substr(md5(w), 3, 2) || substr(md5(w), 1, 2))::BIGINT % 32)::INT AS bucket, count(*) AS n FROM words GROUP BY ALL),
q AS (SELECT (('0x' || substr(md5(w), 7, 2) || substr(md5(w), 5, 2) || substr(md5(w), 3, 2) || substr(md5(w), 1, 2))::BIGINT % 32)::INT AS bucket, count(*) AS m FROM (SELECT unnest(['license', 'version', '2', '0']) AS w) GROUP BY ALL),
s AS (SELECT doc_id, sum(n * coalesce(m, 0)) / sqrt(sum(n * n)) / (SELECT sqrt(sum(m * m)) FROM q) AS score FROM b LEFT JOIN q USING (bucket) GROUP BY doc_id)
SELECT doc_id AS id, round(coalesce(score, 0), 6) AS score FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN s USING (doc_id) ORDER BY round(coalesce(score, 0), 9) DESC, doc_id LIMIT 25""")
def hash_search_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all texts by hashed words, searched by the vector of a query text; a text without words scores 0."""
    d = spread(read_table(spark, sf_dir, "documents"))
    wanted = F.array(*[F.lit(x) for x in retrieval.query_vector(spark, "License, Version 2.0", 32)])
    part = retrieval.hash_embedding_rows(d, "doc_id", "text", 32).select("id", (F.col("value") * F.element_at(wanted, F.col("bucket").cast("int") + 1)).alias("s"))
    scored = part.unionByName(d.select(F.col("doc_id").alias("id"), F.lit(0.0).alias("s"))).groupBy("id").agg(F.sum("s").alias("s"))
    return scored.orderBy(F.round("s", 9).desc(), "id").limit(25).select("id", F.round("s", 6).alias("score"))

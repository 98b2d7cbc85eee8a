"""Text helpers, filters and lookups that no other query runs, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import chunking, text
from quillspark.operators import cards, enrichment, filters, incremental, lexical, retrieval
from quillspark.operators.querylang import parse
from quillspark.plans import adapters
from quillspark.plans.project_queries import _CARDS_SQL, _card_files
from quillspark.plans.registry import ORACLES, query
from quillspark.plans.search_queries import PROBE
from quillspark.session import read_table, spread, stored

# ------------------------------------------------------------------ text


@query("cut_texts", r"SELECT doc_id, CASE WHEN length(text) <= 80 THEN text WHEN regexp_extract(text, '(?s)^(.{0,79})\s', 1) <> '' THEN rtrim(regexp_extract(text, '(?s)^(.{0,79})\s', 1)) || '…' ELSE substr(text, 1, 79) || '…' END AS cut FROM documents")
def cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at the end of a word."""
    return read_table(spark, sf_dir, "documents").select("doc_id", text.cut_words(F.col("text"), 80).alias("cut"))


@query("picture_passages", """SELECT event_id, '[Image ' || user_id || ']' || ' ' || event_type || chr(10) || concat_ws(' | ', CASE WHEN event_id % 3 > 0 THEN 'k' || user_id END, CASE WHEN event_id % 2 = 0 THEN event_type || ', x' END)
  || chr(10) || concat_ws(' — ', event_id || '.png', CASE WHEN event_id % 5 > 0 THEN 'a / b' END) AS passage FROM events""")
def picture_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = read_table(spark, sf_dir, "events"), F.col("event_id")
    words = F.when(i % 2 == 0, F.array(F.col("event_type"), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    seen = F.when(i % 3 > 0, F.concat(F.lit("k"), F.col("user_id").cast("string"))).otherwise(F.lit(""))
    marker = F.concat(F.lit("[Image "), F.col("user_id").cast("string"), F.lit("]"))
    folders = F.when(i % 5 > 0, F.lit("a / b")).otherwise(F.lit(""))
    return e.select("event_id", text.picture_passage(F.col("event_type"), seen, words, marker, F.concat(i.cast("string"), F.lit(".png")), folders).alias("passage"))


@query("page_resolutions", "SELECT p_partkey, CASE WHEN px > 40000000 THEN floor(300 * sqrt(40000000 / px)) ELSE 300 END::INT AS dpi FROM (SELECT p_partkey, (p_size * 100) / 72.0 * 300 * (p_size * 141 / 72.0) * 300 AS px FROM part)")
def page_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolution at which pages of any size stay within the number of pixels."""
    return read_table(spark, sf_dir, "part").select("p_partkey", text.capped_dpi(F.col("p_size") * 100, F.col("p_size") * 141, 300).alias("dpi"))


@query("file_names", r"SELECT page_id, trim(regexp_replace(url, '[<>:\x22/\\|?*\x00-\x1f]+', '_', 'g')) AS safe, trim(regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', ''), '[_\-]+', ' ', 'g')) AS title FROM pages")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", text.safe_name(F.col("url")).alias("safe"), text.picture_title(F.col("url")).alias("title"))


@query("markdown_pictures", r"""SELECT doc_id, md5('# Part ' || doc_id || chr(10) || chr(10) || text || chr(10) || chr(10) || '[Image 1: a view]' || chr(10) || chr(10) || '## Next' || chr(10) || chr(10) || 'A line.' || chr(10) || chr(10) || '[Image 2]' || chr(10)) AS numbered_md5,
  'img/' || doc_id || '.png b.png' AS targets, regexp_extract_all(chr(10) || '# Part ' || doc_id || chr(10) || chr(10) || text || chr(10) || chr(10), '\n#+\s*([^\n]+)', 1)[-1] AS first_heading, 'Next' AS second_heading, 'A line.' AS second_paragraph FROM documents WHERE text IS NOT NULL""")
def markdown_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picture links of Markdown numbered, listed, and put into their context."""
    d = spread(read_table(spark, sf_dir, "documents")).where("text is not null")
    name = F.col("doc_id").cast("string")
    markdown = F.concat(F.lit("# Part "), name, F.lit("\n\n"), "text", F.lit("\n\n![a view](img/"), name, F.lit('.png "t")\n\n## Next\n\nA line.\n\n![](b.png)\n'))
    d = d.select("doc_id", markdown.alias("m"))
    first, second = text.picture_context(F.col("m"), 1), text.picture_context(F.col("m"), 2)
    targets = F.array_join(F.transform(text.pictures_of(F.col("m")), lambda x: x["target"]), " ")
    return d.select("doc_id", F.md5(text.number_pictures(F.col("m"))).alias("numbered_md5"), targets.alias("targets"), first["heading"].alias("first_heading"), second["heading"].alias("second_heading"), second["paragraph"].alias("second_paragraph"))


@query("link_candidates", "SELECT page_id, '/srv/docs/img/a b/' || page_id || '.png|/r1/img/a b/' || page_id || '.png|/r1/a b/' || page_id || '.png|/r2/img/a b/' || page_id || '.png|/r2/a b/' || page_id || '.png' AS candidates FROM pages")
def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages")
    target = F.concat(F.lit("./img\\a b/"), F.col("page_id").cast("string"), F.lit(".png#top"))
    return p.select("page_id", F.array_join(text.link_candidates(target, F.lit("/srv/docs/x.md"), ["/r1", "/r2/"]), "|").alias("candidates"))


# ------------------------------------------------------------------ filters and lookups


@query("project_filter", f"WITH {adapters.PROJECT_DOCS_SQL} SELECT doc_id FROM project_docs WHERE lower(project) IN ('p7', 'y1996') OR lower(subproject) IN ('p7', 'y1996')")
def project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.project_docs(spark, sf_dir).where(filters.project_is("P7, y1996")).select("doc_id")


@query("combined_filters", f"WITH {adapters.PROJECT_DOCS_SQL} SELECT doc_id FROM project_docs WHERE starts_with(path, '/p1/') IS NOT NULL AND mtime >= TIMESTAMP '1996-01-01' AND lower(section) = 'f' AND lower(doc_type) IN ('1-urgent', '2-high') AND project IN (SELECT 'P' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def combined_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, date, facets and projects together."""
    d = adapters.project_docs(spark, sf_dir)
    files = d.select("doc_id", F.lower("path").alias("path_key"), F.lit(".PDF").alias("ext"), "mtime")
    projects = read_table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("project"))
    return filters.with_filters(files, d, "/", "pdf", "1996-01-01", projects=projects, section="F", doc_type="1-URGENT,2-high").select("doc_id")


@query("picture_pages", "SELECT doc_id, CASE WHEN n_chars % 3 > 0 THEN (n_chars % 100) / 100.0 >= 0.15 ELSE CASE WHEN doc_id % 4 > 0 THEN n_chars < 600 ELSE doc_id % 2 = 1 END END AS wanted FROM documents")
def picture_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages are to be described: by share of pictures, or by what recognition found."""
    i, n = F.col("doc_id"), F.col("n_chars")
    wanted = lambda enabled: enrichment.is_picture_page((n % 100) / 100, n % 3, F.when(i % 4 > 0, n), enabled)
    return read_table(spark, sf_dir, "documents").select("doc_id", F.when(i % 2 == 1, wanted(False)).otherwise(wanted(True)).alias("wanted"))


@query("embed_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def embed_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages without a vector of this model."""
    done = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("version"), F.lit("ok").alias("status"))
    return incremental.pending(read_table(spark, sf_dir, "documents").select("doc_id"), done, ["doc_id"], 1)


@query("canonical_words", "SELECT p_partkey, w AS word, CASE WHEN w IN ('PROMO', 'promos') THEN 'promotion' WHEN w IN ('ECONOMYES', 'economy') THEN 'economy' END AS value FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'PROMO' WHEN 1 THEN 'promos' WHEN 2 THEN 'ECONOMYES' WHEN 3 THEN 'economy' ELSE 'promo x' END AS w FROM part)")
def canonical_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of entries put into the vocabulary's form, plurals too."""
    k = F.col("p_partkey") % 5
    said = F.when(k == 0, "PROMO").when(k == 1, "promos").when(k == 2, "ECONOMYES").when(k == 3, "economy").otherwise("promo x")
    words = spark.createDataFrame([("forms", "promotion", "promo"), ("forms", "economy", None)], "kind string, value string, synonym string")
    asked = read_table(spark, sf_dir, "part").select("p_partkey", F.lit("forms").alias("kind"), said.alias("word"))
    return cards.canonical(asked, cards.vocabulary(words)).select("p_partkey", "word", "value")


@query("card_lookup", f"WITH {_CARDS_SQL} SELECT file, error FROM cards WHERE i = 12")
def card_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.card_for(cards.parse_cards(_card_files(spark, sf_dir)), "C12").select("file", "error")


@query("hybrid_stored_index", ORACLES["hybrid_chunk_search"])
def hybrid_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search on a stored inverted index: what is read are the query's postings, the vectors and the hits."""
    d = spread(read_table(spark, sf_dir, "documents"))
    chunks = chunking.chunk_rows(d.select("doc_id", "text")).withColumn("chunk_id", F.col("doc_id") * 100_000 + F.col("seq"))
    chunks = stored(chunks, "chunks", "doc_id", "chunk_id")
    words = chunks.select(F.col("chunk_id").alias("id"), "doc_id", text.tokens(F.col("chunk")).alias("words"))
    index = stored(lexical.postings(words), "postings", "term", "id", dealt=False)
    vectors = read_table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 100_000).alias("chunk_id"), F.col("vec_id").alias("doc_id"), "embedding").join(chunks, "chunk_id", "left_semi")
    shown = d.where("lang = 'en'").select("doc_id")
    found = retrieval.hybrid_search(chunks, parse("thereon license"), vectors, PROBE, visible=shown, limit=20, index=(index, lexical.corpus_figures(words)))
    return found.select("id", "doc_id", F.round("score", 9).alias("score"))

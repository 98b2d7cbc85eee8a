"""Text functions and chunking over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import chunking, text
from quillspark.plans import adapters
from quillspark.plans.registry import query
from quillspark.session import read_table, spread

_FOLD_SQL = "lower(strip_accents({0}))"
_CLEAN_SQL = r"regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(replace(replace(replace(replace({0}, chr(0), ''), chr(173), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t\x{{a0}}]+', ' ', 'g'), ' ' || chr(10), chr(10)), chr(10) || ' ', chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')"


@query("clean_text_stats", f"""SELECT doc_id, length(c)::BIGINT AS clean_chars, md5(c) AS clean_md5 FROM (SELECT doc_id, {_CLEAN_SQL.format("replace(text, '. ', '.  ' || chr(9) || chr(10) || '  ')")} AS c FROM documents)""")
def clean_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(read_table(spark, sf_dir, "documents"))
    noisy = F.replace("text", F.lit(". "), F.lit(".  \t\n  "))
    c = text.clean_text(noisy)
    return d.select("doc_id", F.length(c).cast("long").alias("clean_chars"), F.md5(c).alias("clean_md5"))


CHUNKS_SQL = """RECURSIVE steps AS (
  SELECT doc_id, text, length(text) AS n, 0 AS pos, 0 AS seq, NULL::VARCHAR AS chunk FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, n, e, seq + 1, substr(text, pos + 1, e - pos) FROM (
    SELECT *, CASE WHEN n - pos <= 2000 THEN n ELSE pos + 600 + coalesce(
      {cuts}, 1400) END AS e FROM (SELECT *, reverse(substr(text, pos + 601, 1400)) AS w FROM steps WHERE pos < n))),
chunks AS (SELECT doc_id, seq - 1 AS seq, chunk FROM steps WHERE chunk IS NOT NULL)"""
_SEPARATORS = ("chr(10) || chr(10)", "chr(10)", "' .'", "' ?'", "' !'", "' ;'", "' ,'", "' '")
# a separator's last place in the window is its first in the reversed window
CHUNKS_SQL = CHUNKS_SQL.format(cuts=", ".join(f"CASE WHEN strpos(w, {s}) > 0 THEN 1401 - strpos(w, {s}) END" for s in _SEPARATORS))


@query("chunk_documents", f"WITH {CHUNKS_SQL} SELECT doc_id, seq::INT AS seq, length(chunk)::BIGINT AS chars, md5(chunk) AS chunk_md5 FROM chunks")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_rows(spread(read_table(spark, sf_dir, "documents")).select("doc_id", "text"))
    return chunks.select("doc_id", "seq", F.length("chunk").cast("long").alias("chars"), F.md5("chunk").alias("chunk_md5"))


@query("page_rebuild", f"SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE length(text) > 0")
def page_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_rows(spread(read_table(spark, sf_dir, "documents")).select("doc_id", "text"))
    return chunking.rebuilt(chunks, ["doc_id"]).select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "fold_flavours",
    r"""SELECT doc_id, md5(lower(strip_accents(text))) AS folded, md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ascii_lower,
  md5(trim(regexp_replace(strip_accents(lower(text)), '[\s_\-]+', ' ', 'g'))) AS name, md5(array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]+'), ' ')) AS terms,
  md5(trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))) AS key
FROM documents""",
)
def fold_flavours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five ways of folding, of whole texts."""
    t = F.col("text")
    folds = {"folded": text.fold(t), "ascii_lower": text.ascii_lower(t), "name": text.norm_name(t), "terms": text.norm_terms(t), "key": text.fold_ascii(t)}
    return spread(read_table(spark, sf_dir, "documents")).select("doc_id", *[F.md5(c).alias(k) for k, c in folds.items()])


@query(
    "number_extraction",
    r"""SELECT doc_id, array_to_string(list_sort(list_distinct([regexp_extract(x, '1[02]0\d{6}') FOR x IN regexp_extract_all(x, '(?:^|\D)0?1[02]0\d{6}(?:$|\D)')])), ',') AS numbers,
  coalesce(try_cast(nullif(regexp_extract(text, '\d+'), '') AS BIGINT), -1) AS first_number
FROM (SELECT doc_id, text, coalesce(text, '') || ' ref 120' || lpad((doc_id % 1000000)::VARCHAR, 6, '0') || ' and 0100' || lpad((n_chars % 1000000)::VARCHAR, 6, '0') || '; no 9120000001 nor 12000' AS x FROM documents)""",
)
def number_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pad = lambda c: F.lpad((F.col(c) % 1_000_000).cast("string"), 6, "0")
    x = F.concat(F.coalesce("text", F.lit("")), F.lit(" ref 120"), pad("doc_id"), F.lit(" and 0100"), pad("n_chars"), F.lit("; no 9120000001 nor 12000"))
    return spread(read_table(spark, sf_dir, "documents")).select("doc_id", F.array_join(text.numbers_in(x), ",").alias("numbers"), F.coalesce(text.first_int(F.col("text")), F.lit(-1)).cast("long").alias("first_number"))


@query(
    "hash_embed",
    r"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]+')) AS w FROM documents),
hashed AS (SELECT doc_id, (('0x' || substr(md5(w), 7, 2) || substr(md5(w), 5, 2) || substr(md5(w), 3, 2) || substr(md5(w), 1, 2))::BIGINT % 256)::INT AS bucket FROM words),
counted AS (SELECT doc_id, bucket, count(*) AS n FROM hashed GROUP BY ALL)
SELECT doc_id AS id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM counted""",
)
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.operators.retrieval import hash_embedding_rows

    return hash_embedding_rows(spread(read_table(spark, sf_dir, "documents")), "doc_id", "text").select("id", "bucket", F.round("value", 6).alias("value"))


@query(
    "snippets",
    """WITH flat AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents),
places AS (SELECT *, coalesce(list_min([x FOR x IN [strpos(lower(strip_accents(t)), 'license'), strpos(lower(strip_accents(t)), 'token')] IF x > 0]), 1) - 1 AS first FROM flat),
cut AS (SELECT *, greatest(0, first - 233) AS s FROM places)
SELECT doc_id, CASE WHEN length(t) <= 700 THEN t ELSE (CASE WHEN s > 0 THEN '…' ELSE '' END) || substr(t, s + 1, 700) || (CASE WHEN s + 700 < length(t) THEN '…' ELSE '' END) END AS snippet FROM cut""",
)
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents")).select("doc_id", text.snippet(F.col("text"), ["license", "token", "of", "the"]).alias("snippet"))


@query(
    "ocr_line_filter",
    r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
parts AS (SELECT doc_id, i, [x FOR x IN regexp_split_to_array(line, '\s+') IF x <> ''] AS p FROM lines),
words AS (SELECT doc_id, i, p, [x FOR x IN p IF regexp_full_match(x, '[(\[{«"''‘’“”„.,;:!?…/*•–—-]*\p{L}+(?:[''’-]\p{L}+)*[)\]}»"''‘’“”„.,;:!?…/*–—-]*') AND regexp_matches(x, '[aeiouyàâäáãåæèéêëìíîïòóôöõøœùúûüýÿAEIOUYÀÂÄÁÃÅÆÈÉÊËÌÍÎÏÒÓÔÖÕØŒÙÚÛÜÝŸ]')] AS w FROM parts)
SELECT doc_id, count(*)::BIGINT AS lines, count(*) FILTER (len([x FOR x IN w IF length(regexp_replace(x, '[^\p{L}]', '', 'g')) >= 2]) >= 2 AND len(w) * 2 >= len(p))::BIGINT AS kept FROM words GROUP BY doc_id""",
)
def ocr_line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    return spread(read_table(spark, sf_dir, "documents")).where("text is not null").select("doc_id", F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, text.keeps_line)).cast("long").alias("kept"))


@query(
    "link_markers",
    r"""SELECT page_id, len(regexp_extract_all(html, '<a href="[^"]*">'))::BIGINT AS links, length(html)::BIGINT AS chars, coalesce(array_to_string(regexp_extract_all(html, '<a href="([^"]*)">', 1), ' '), '') AS targets FROM pages""",
)
def link_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links numbered in one pass; the numbered text is put back to its length for the comparison."""
    pattern = r'<a href="([^"]*)">'
    p = read_table(spark, sf_dir, "pages")
    marked = text.number_matches(F.col("html"), pattern, lambda k, target: F.concat(F.lit("\u0001"), k.cast("string"), F.lit("\u0002"), target, F.lit("\u0003")))
    marks = F.regexp_extract_all(marked, F.lit("\u0001(\\d+)\u0002([^\u0003]*)\u0003"), F.lit(2))
    back = F.regexp_replace(marked, "\u0001\\d+\u0002([^\u0003]*)\u0003", '<a href="$1">')
    return p.select("page_id", F.size(marks).cast("long").alias("links"), F.length(back).cast("long").alias("chars"), F.array_join(marks, " ").alias("targets"))


@query(
    "json_answer_parse",
    """SELECT event_id, substr(event_type, 1, 30) AS type, 'event ' || event_id AS description, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN NULL ELSE 'k' || json_extract_string(props, '$.k') END AS visible_text,
  event_type || ',x' AS keywords, NULL::VARCHAR AS error FROM events""",
)
def json_answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    words = F.array(F.col("event_type"), F.upper("event_type"), F.lit(" x "), F.lit(""))
    answer = F.to_json(F.struct(F.col("event_type").alias("type"), F.concat(F.lit(" event "), F.col("event_id").cast("string")).alias("description"), F.concat(F.lit("k"), k).alias("visible_text"), words.alias("keywords")))
    x = e.select("event_id", text.picture_answer(answer).alias("x"))
    return x.select("event_id", "x.type", "x.description", "x.visible_text", F.array_join("x.keywords", ",").alias("keywords"), "x.error")


@query("doc_status_counts", f"WITH {adapters.DOCS_SQL} SELECT status, lang, count(*)::BIGINT AS docs FROM docs GROUP BY status, lang")
def doc_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.docs(spark, sf_dir).groupBy("status", "lang").agg(F.count("*").alias("docs"))


@query(
    "embedding_texts",
    f"WITH {adapters.DOCS_SQL} SELECT doc_id, md5(substr(path || CASE WHEN title <> '' AND strpos(lower(path), lower(title)) = 0 THEN ' — ' || title ELSE '' END || chr(10) || text, 1, 2400)) AS input_md5 FROM docs WHERE text IS NOT NULL",
)
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.docs(spark, sf_dir).where("text is not null")
    return d.select("doc_id", F.md5(text.embedding_text(F.col("path"), F.col("title"), F.col("text"))).alias("input_md5"))


@query(
    "parsed_dates",
    """SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS parsed FROM orders""",
)
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", text.parse_date(forms).cast("string").alias("parsed"))

"""Listings, roll-ups, linkage and reading over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import models_in
from quillspark.operators import facets, filters, linkage, reports
from quillspark.plans import adapters
from quillspark.plans.registry import query
from quillspark.session import dealt_by, read_table


@query("project_listing", f"""WITH {adapters.PROJECT_DOCS_SQL} SELECT project, collection, count(*)::BIGINT AS docs, max(mtime)::VARCHAR AS newest, string_agg(DISTINCT section, ', ' ORDER BY section) AS sections, string_agg(DISTINCT subproject, ', ' ORDER BY subproject) AS subprojects
FROM project_docs GROUP BY project, collection HAVING strpos(lower(project), 'p1') > 0 OR bool_or(strpos(lower(subproject), 'p1') > 0) ORDER BY collection IS NOT NULL, project, collection LIMIT 200""")
def project_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.list_projects(adapters.project_docs(spark, sf_dir), "p1", 200)
    return out.select("project", "collection", "docs", F.date_format("newest", "yyyy-MM-dd HH:mm:ss").alias("newest"), "sections", F.array_join("subprojects", ", ").alias("subprojects"))


@query("unindexed_listing", f"""WITH {adapters.REGISTER_SQL} SELECT coalesce(nullif(name, ''), '(no name)') AS name, string_agg(DISTINCT nullif(model, ''), ', ' ORDER BY nullif(model, '')) AS models, max(client) AS client, max(country) AS country, min(year) AS first_year, max(year) AS last_year, count(*)::BIGINT AS rows
FROM register WHERE project IS NULL GROUP BY 1 ORDER BY 1 LIMIT 100""")
def unindexed_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.unindexed(adapters.register(spark, sf_dir))


@query("project_header", f"WITH {adapters.PROJECT_DOCS_SQL} SELECT count(*)::BIGINT AS docs, min(mtime)::VARCHAR AS oldest, max(mtime)::VARCHAR AS newest, max(collection) AS collection FROM project_docs WHERE lower(project) = 'p12' OR lower(subproject) = 'p12'")
def project_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return reports.project_header(adapters.project_docs(spark, sf_dir), "P12").select("docs", text("oldest"), text("newest"), "collection")


@query("newest_per_type", f"WITH {adapters.PROJECT_DOCS_SQL} SELECT doc_type, path, mtime::VARCHAR AS mtime FROM project_docs QUALIFY row_number() OVER (PARTITION BY doc_type ORDER BY mtime DESC, path) = 1")
def newest_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.newest_per_type(adapters.project_docs(spark, sf_dir)).select("doc_type", "path", F.date_format("mtime", "yyyy-MM-dd HH:mm:ss").alias("mtime"))


@query("mode_client", f"WITH {adapters.REGISTER_SQL}, g AS (SELECT 'G' || (row_id % 50) AS project, grp AS client FROM register) SELECT project, client, n FROM (SELECT project, client, count(*)::BIGINT AS n FROM g WHERE client <> '' GROUP BY project, client) QUALIFY row_number() OVER (PARTITION BY project ORDER BY n DESC, client) = 1")
def mode_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = adapters.register(spark, sf_dir).select(F.concat(F.lit("G"), (F.col("row_id") % 50).cast("string")).alias("project"), F.col("grp").alias("client"))
    return linkage.usual_client(r)


@query("same_client_others", f"""WITH {adapters.REGISTER_SQL}, keyed AS (SELECT project, year, 'client' AS kind, lower(client) AS who FROM register WHERE project IS NOT NULL AND client <> '' UNION ALL SELECT project, year, 'group', lower(grp) FROM register WHERE project IS NOT NULL AND grp <> '')
SELECT project, max(year) AS year FROM keyed WHERE project <> 'P7' AND (kind, who) IN (SELECT (kind, who) FROM keyed WHERE project = 'P7') GROUP BY project ORDER BY year DESC, project LIMIT 25""")
def same_client_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.other_projects(adapters.register(spark, sf_dir), "P7")


@query("facet_histogram", f"WITH {adapters.PROJECT_DOCS_SQL} SELECT coalesce(collection, '(unknown)') AS value, count(*)::BIGINT AS docs FROM project_docs GROUP BY 1")
def facet_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(adapters.project_docs(spark, sf_dir), "collection")


_TREE = f"""WITH {adapters.PAGES_SQL}, parts AS (SELECT [domain, host] || names[:greatest(len(names) - 1, 0)] AS p FROM web_pages),
counts AS (SELECT array_to_string(p[:i], '/') AS folder, i AS level, count(*) AS docs FROM (SELECT p, unnest(range(0, least(3, len(p)) + 1)) AS i FROM parts) GROUP BY 1, 2)"""


def _tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = adapters.web_pages(spark, sf_dir)
    names = F.slice("names", F.lit(1), F.greatest(F.size("names") - 1, F.lit(0)))
    return reports.folder_counts(w, F.concat(F.array("domain", "host"), names))


@query("folder_tree_rollup", f"{_TREE} SELECT folder, level::INT AS level, docs::BIGINT AS docs FROM counts")
def folder_tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree_counts(spark, sf_dir)


@query("folder_tree_folded", f"""{_TREE}, kids AS (SELECT *, CASE WHEN level = 1 THEN '' ELSE regexp_replace(folder, '/[^/]*$', '') END AS parent FROM counts WHERE level > 0),
rows AS (SELECT parent, folder, docs, 0 AS smaller FROM kids WHERE docs >= 5 UNION ALL SELECT parent, NULL, sum(docs), count(*) FROM kids WHERE docs < 5 GROUP BY parent)
SELECT parent, folder, docs::BIGINT AS docs, smaller::BIGINT AS smaller FROM rows WHERE parent = '' OR parent IN (SELECT folder FROM rows WHERE folder IS NOT NULL)""")
def folder_tree_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.folder_tree(_tree_counts(spark, sf_dir))


@query("template_folders", f"""WITH {adapters.PROJECT_DOCS_SQL}, each AS (SELECT section, doc_type AS key, count(*) AS docs, count(DISTINCT coalesce(project, '') || '|' || coalesce(subproject, '')) AS projects FROM project_docs GROUP BY 1, 2),
placed AS (SELECT *, CASE WHEN docs >= 5 AND row_number() OVER (PARTITION BY section ORDER BY docs < 5, projects DESC, docs DESC, key) <= 3 THEN row_number() OVER (PARTITION BY section ORDER BY docs < 5, projects DESC, docs DESC, key) ELSE -1 END AS place FROM each)
SELECT section, key, docs::BIGINT AS docs, projects::BIGINT AS projects, place::INT AS place FROM placed WHERE place > 0 UNION ALL SELECT section, NULL, sum(docs)::BIGINT, count(*), -1 FROM placed WHERE place < 0 GROUP BY section""")
def template_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.project_docs(spark, sf_dir).withColumnRenamed("doc_type", "key")
    return reports.template_folders(d, most=3)


@query("url_facets", f"""WITH {adapters.PAGES_SQL} SELECT page_id, CASE WHEN len(names) > 1 THEN names[1] END AS category, CASE WHEN regexp_matches(upper(names[1]), '^(FR|DE|EN|ES|IT)$') THEN lower(names[1]) END AS language FROM web_pages""")
def url_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = adapters.web_pages(spark, sf_dir).withColumn("tagged", F.concat("path", F.lit("/doc_"), F.upper(F.get("names", F.lit(0))), F.lit(".md")))
    tags = facets.documentation_facets(w.select("page_id", F.col("tagged").alias("path"))).select("page_id", "language")
    return facets.category_facets(w).select("page_id", "category").join(tags, "page_id")


@query("read_budget", f"""WITH {adapters.LINE_PAGES_SQL}, used AS (SELECT *, sum(length(text)) OVER w AS used, row_number() OVER w AS r FROM line_pages WINDOW w AS (PARTITION BY doc_id ORDER BY page_no))
SELECT doc_id, page_no, md5(CASE WHEN length(text) > 3000 THEN substr(text, 1, 3000) ELSE text END) AS text_md5, length(text) > 3000 AS cut FROM used WHERE used <= 3000 OR r = 1""")
def read_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.read_pages(adapters.line_pages(spark, sf_dir), budget=3000).select("doc_id", "page_no", F.md5("text").alias("text_md5"), "cut")


@query("find_in_document", f"""WITH RECURSIVE {adapters.LINE_PAGES_SQL}, low AS (SELECT doc_id, page_no, text, lower(strip_accents(text)) AS t FROM line_pages),
hits AS (SELECT doc_id, page_no, text, t, strpos(t, 'licen') AS p FROM low WHERE strpos(t, 'licen') > 0
  UNION ALL SELECT doc_id, page_no, text, t, p + 4 + strpos(substr(t, p + 5), 'licen') FROM hits WHERE strpos(substr(t, p + 5), 'licen') > 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, p) AS hit, count(*) OVER (PARTITION BY doc_id) AS total FROM hits)
SELECT doc_id, page_no, hit::INT AS hit, (p - 1)::INT AS offset_, md5(substr(text, greatest(0, p - 1 - 250) + 1, p - 1 - greatest(0, p - 1 - 250) + 5 + 250)) AS context_md5, total::BIGINT AS total FROM numbered WHERE hit <= 20""")
def find_in_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.find_in_document(adapters.line_pages(spark, sf_dir), "LICEN")
    return found.select("doc_id", "page_no", "hit", F.col("offset").alias("offset_"), F.md5("context").alias("context_md5"), "total")


@query("problems_page", f"WITH {adapters.DOCS_SQL}, bad AS (SELECT doc_id, path, status FROM docs WHERE status <> 'ok') SELECT doc_id, path, status, (SELECT count(*) FROM bad)::BIGINT AS total FROM bad ORDER BY path LIMIT 10 OFFSET 2")
def problems_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.problems(adapters.docs(spark, sf_dir).select("doc_id", "path", "status"), 2, 10)


@query("index_status", f"""WITH {adapters.DOCS_SQL} SELECT 'status' AS what, status AS value, count(*)::BIGINT AS n FROM docs GROUP BY status UNION ALL SELECT 'ext', ext, count(*) FROM docs WHERE status = 'ok' GROUP BY ext
UNION ALL SELECT 'chunks', 'all', count(*) FROM embeddings UNION ALL SELECT 'chunks', 'embedded', count(*) FILTER (label > 2) FROM embeddings UNION ALL SELECT 'ocr', CASE WHEN toxic = 1 THEN 'error' ELSE 'text' END, count(*) FROM labels GROUP BY 2""")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_table(spark, sf_dir, "embeddings").select((F.col("label") > 2).alias("embedded"))
    ocr = read_table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "error").otherwise("text").alias("status"))
    return reports.index_status(adapters.docs(spark, sf_dir), chunks, ocr)


@query("similar_names", f"WITH {adapters.PROJECT_DOCS_SQL}, {adapters.REGISTER_SQL} SELECT DISTINCT name FROM (SELECT project AS name FROM project_docs UNION SELECT subproject FROM project_docs UNION SELECT name FROM register) WHERE strpos(lower(name), '99') > 0 ORDER BY name LIMIT 10")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.similar_names(adapters.project_docs(spark, sf_dir), adapters.register(spark, sf_dir), "99")


# ------------------------------------------------------------------ evidence and linkage

_MENTIONS = """mentions AS (SELECT 'S' || l_suppkey AS project, l_orderkey AS doc_id, p_type AS family, m AS model, bool_or(l_returnflag = 'R') AS in_name
  FROM (SELECT l_suppkey, l_orderkey, p_type, l_returnflag, unnest([p_type || ' ' || p_brand, '']) AS m FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY ALL),
machines AS (SELECT project, family, model, count(*) AS docs, count(*) FILTER (in_name) AS name_docs FROM mentions GROUP BY ALL)"""


def _machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part")
    some = li.select(F.col("l_suppkey").alias("project"), F.col("l_orderkey").alias("doc_id"), "l_partkey", (F.col("l_returnflag") == "R").alias("in_name"))
    # dealt out by project and document before families are told beside models; suppliers are named when they are counted
    each = dealt_by(some.join(p, F.col("l_partkey") == F.col("p_partkey")).select("project", "doc_id", "p_type", "p_brand", "in_name"), "project", "doc_id", table=li)
    models = F.explode(F.array(F.concat("p_type", F.lit(" "), "p_brand"), F.lit("")))
    each = each.select("project", "doc_id", F.col("p_type").alias("family"), models.alias("model"), "in_name")
    found = linkage.confirmed(each.groupBy("project", "doc_id", "family", "model").agg(F.bool_or("in_name").alias("in_name")))
    return found.withColumn("project", F.concat(F.lit("S"), F.col("project").cast("string")))


@query("machine_evidence", f"WITH {_MENTIONS} SELECT project, family, model, docs::BIGINT AS docs, name_docs::BIGINT AS name_docs, (docs >= 2 OR name_docs >= 1) AND docs >= 0.1 * max(docs) OVER (PARTITION BY project) AS confirmed FROM machines")
def machine_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _machines(spark, sf_dir)


@query("machine_summary", f"""WITH {_MENTIONS}, sure AS (SELECT * FROM machines QUALIFY (docs >= 2 OR name_docs >= 1) AND docs >= 0.1 * max(docs) OVER (PARTITION BY project)),
named AS (SELECT project, model AS name, docs, 0 AS kind FROM sure WHERE model <> '' UNION ALL SELECT project, family, docs, 1 FROM sure s WHERE model = '' AND NOT EXISTS (SELECT 1 FROM sure t WHERE t.project = s.project AND t.family = s.family AND t.model <> '')),
top AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY kind, docs DESC, name) AS r FROM named)
SELECT project, string_agg(name, ', ' ORDER BY r) AS machines FROM top WHERE r <= 6 GROUP BY project""")
def machine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.describe_machines(_machines(spark, sf_dir)).select("project", F.array_join("machines", ", ").alias("machines"))


@query("models_in_text", r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Paloma:Paloma ' || (p_size % 9 + 1) || 'R' WHEN p_partkey % 3 = 1 THEN 'Hector:,Presto:Presto ' || (p_size % 9 + 1) || 'R SQ' ELSE 'Delfi:' END AS models FROM part""")
def models_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("p_size") % 9 + 1).cast("string")
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("offer_PALOMA PM D2 "), n, F.lit("R.pdf"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Hector, and a presto-SQ "), n, F.lit(" r x"))).otherwise(F.lit("delfi 0R; megapaloma"))
    each = F.transform(models_in(said), lambda m: F.concat(m["family"], F.lit(":"), m["model"]))
    return read_table(spark, sf_dir, "part").select("p_partkey", F.array_join(each, ",").alias("models"))


@query("number_ownership", """WITH votes AS (SELECT l_partkey AS number, 'S' || l_suppkey AS project, count(DISTINCT l_orderkey) AS docs, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS named FROM lineitem GROUP BY ALL),
best AS (SELECT number, project AS owner, docs AS owner_docs, named AS owner_named, sum(docs) OVER (PARTITION BY number) AS total FROM votes QUALIFY row_number() OVER (PARTITION BY number ORDER BY docs DESC, named DESC, project) = 1)
SELECT number, owner, owner_docs::BIGINT AS owner_docs, owner_named::BIGINT AS owner_named, total::BIGINT AS total, (owner_docs >= 2 OR owner_named >= 1) AND owner_docs >= 0.6 * total AS accepted FROM best""")
def number_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exchange, by number; suppliers are named when they are counted."""
    li = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("number"), "l_suppkey", "l_orderkey", (F.col("l_returnflag") == "R").alias("in_name"))
    each = dealt_by(li, "number").groupBy("number", "l_suppkey", "l_orderkey").agg(F.bool_or("in_name").alias("in_name"))
    votes = each.groupBy("number", "l_suppkey").agg(F.count("l_orderkey").alias("docs"), F.count_if(F.col("in_name") & F.col("l_orderkey").isNotNull()).alias("named"))
    votes = votes.select("number", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("project"), "docs", "named")
    return linkage.majority(votes, "number").withColumn("accepted", linkage.accepted(F.lit(False)))


@query("trimmed_year_span", f"WITH {adapters.PROJECT_DOCS_SQL}, y AS (SELECT project, list_sort(list(year(mtime))) AS y FROM project_docs GROUP BY project HAVING count(*) >= 3) SELECT project, y[len(y) // 10 + 1]::INT AS first_year, y[len(y) - len(y) // 10]::INT AS last_year FROM y")
def trimmed_year_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.year_spans(adapters.project_docs(spark, sf_dir))


_LINK_ROWS = """rows AS (SELECT c_custkey AS row_id, CASE c_custkey % 4 WHEN 0 THEN '/x/NATION ' || (c_custkey % 30) ELSE '/x/other' END AS path,
    CASE c_custkey % 4 WHEN 1 THEN 'Nation-' || (c_custkey % 30) || ' old' WHEN 2 THEN 'nation_' || (c_custkey % 30) ELSE 'none' END AS name,
    CASE WHEN c_custkey % 4 = 3 THEN '120' || lpad((c_custkey % 500)::VARCHAR, 6, '0') ELSE '' END AS order_no FROM customer)"""


@query("register_link_cascade", f"""WITH {_LINK_ROWS}, votes AS (SELECT '120' || lpad(s_suppkey::VARCHAR, 6, '0') AS number, 'NATION_' || s_nationkey AS project, 2 AS docs FROM supplier),
p AS (SELECT n_name AS project, replace(lower(n_name), '_', '') AS k FROM nation),
keyed AS (SELECT *, regexp_replace(lower(regexp_extract(path, '([^/]*)$', 1)), '[^a-z0-9]', '', 'g') AS fk, regexp_replace(regexp_replace(lower(name), ' old$', ''), '[^a-z0-9]', '', 'g') AS nb FROM rows)
SELECT row_id, coalesce(a.project, b.project, v.project) AS project, CASE WHEN a.project IS NOT NULL THEN 'folder' WHEN b.project IS NOT NULL THEN 'name' WHEN v.project IS NOT NULL THEN 'order' END AS matched_by
FROM keyed LEFT JOIN p a ON a.k = fk LEFT JOIN p b ON b.k = nb LEFT JOIN votes v ON v.number = order_no""")
def register_link_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    k, which = F.col("c_custkey"), F.col("c_custkey") % 4
    n = (k % 30).cast("string")
    none = F.lit("").alias
    rows = c.select(
        k.alias("row_id"), F.when(which == 0, F.concat(F.lit("/x/NATION "), n)).otherwise(F.lit("/x/other")).alias("path"),
        F.when(which == 1, F.concat(F.lit("Nation-"), n, F.lit(" old"))).when(which == 2, F.concat(F.lit("nation_"), n)).otherwise(F.lit("none")).alias("name"),
        F.when(which == 3, F.concat(F.lit("120"), F.lpad((k % 500).cast("string"), 6, "0"))).otherwise(F.lit("")).alias("order_no"),
        none("serial"), none("model"), none("year"), none("client"), none("grp"), none("order_date"), none("notes"),
    )
    projects = read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("project"))
    votes = read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("120"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("number"), F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("project"), F.lit(2).cast("long").alias("docs"), F.lit(0).cast("long").alias("named"))
    machines = spark.createDataFrame([], "project string, family string, model string, docs long, name_docs long, confirmed boolean")
    spans = spark.createDataFrame([], "project string, first_year int, last_year int")
    return linkage.link_register(rows, projects, votes, machines, spans).select("row_id", "project", "matched_by")


@query("documents_win", """WITH rows AS (SELECT p_partkey AS row_id, 'NATION_' || (p_partkey % 25) AS reg, p_partkey % 2 = 0 AS moved, p_partkey % 3 AS m, p_size FROM part)
SELECT row_id, CASE WHEN moved THEN 'NATION_' || ((row_id + 1) % 25) ELSE reg END AS project, CASE WHEN moved THEN reg END AS reg_project, CASE m WHEN 0 THEN 'Paloma' WHEN 1 THEN 'Hector' ELSE 'Paloma' END AS family,
  m <> 1 AS family_ok, m = 0 AS model_ok, 1998 AS year FROM rows""")
def documents_win(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners, families, models and years that contradict the documents."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    number = F.concat(F.lit("120"), F.lpad((k % 1_000_000).cast("string"), 6, "0"))
    reg = F.concat(F.lit("NATION_"), (k % 25).cast("string"))
    model = F.when(k % 3 == 0, F.lit("Paloma 2R")).when(k % 3 == 1, F.lit("Hector 1R")).otherwise(F.lit("Paloma 9R"))
    none = F.lit("").alias
    rows = p.select(k.alias("row_id"), F.lit("").alias("path"), reg.alias("name"), number.alias("order_no"), none("serial"), model.alias("model"), F.lit("1901").alias("year"), none("client"), none("grp"), none("order_date"), none("notes"))
    projects = read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("project"))
    other = F.concat(F.lit("NATION_"), ((k + 1) % 25).cast("string"))
    votes = p.where(k % 2 == 0).select(number.alias("number"), other.alias("project"), F.lit(5).cast("long").alias("docs"), F.lit(1).cast("long").alias("named"))
    machines = projects.select("project", F.lit("Paloma").alias("family"), F.explode(F.array(F.lit("Paloma 2R SQ"), F.lit(""))).alias("model"), F.lit(3).cast("long").alias("docs"), F.lit(0).cast("long").alias("name_docs"), F.lit(True).alias("confirmed"))
    spans = projects.select("project", F.lit(1998).alias("first_year"), F.lit(2001).alias("last_year"))
    return linkage.link_register(rows, projects, votes, machines, spans).select("row_id", "project", "reg_project", "family", "family_ok", "model_ok", "year")


@query("machine_filter", f"""WITH {_MENTIONS}, sure AS (SELECT * FROM machines QUALIFY (docs >= 2 OR name_docs >= 1) AND docs >= 0.1 * max(docs) OVER (PARTITION BY project))
SELECT DISTINCT project FROM sure WHERE lower(family) = 'promo' OR lower(model) = 'economy brand#3'""")
def machine_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "project string, family string, model string, family_ok boolean, model_ok boolean")
    return filters.projects_with_machine(_machines(spark, sf_dir), none, "PROMO, economy brand#3")


@query("facet_lines", f"""WITH {adapters.PROJECT_DOCS_SQL}, {adapters.REGISTER_SQL}, c AS (SELECT project, client FROM register WHERE project IS NOT NULL)
SELECT doc_id, concat_ws(' · ', project_docs.project, subproject, client, collection, section, doc_type || ' (folder)') AS line FROM project_docs LEFT JOIN c ON c.project = project_docs.project""")
def facet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.project_docs(spark, sf_dir).withColumn("facet_source", F.lit("folder"))
    clients = linkage.usual_client(adapters.register(spark, sf_dir)).select("project", "client")
    machines = spark.createDataFrame([], "project string, machines array<string>")
    return reports.facet_lines(d, machines, clients)


@query("coverage", f"WITH {adapters.PROJECT_DOCS_SQL}, {adapters.REGISTER_SQL} SELECT count(DISTINCT p.project)::BIGINT AS projects, count(DISTINCT r.project)::BIGINT AS with_register FROM project_docs p LEFT JOIN register r ON lower(r.project) = lower(p.project)")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = adapters.project_docs(spark, sf_dir).select("project").distinct()
    r = adapters.register(spark, sf_dir).where("project is not null").select(F.lower("project").alias("_p")).distinct()
    return projects.join(r, F.lower("project") == F.col("_p"), "left").agg(F.count("*").alias("projects"), F.count("_p").alias("with_register"))


@query("project_names_union", f"WITH {adapters.PROJECT_DOCS_SQL}, {adapters.REGISTER_SQL} SELECT project AS name FROM project_docs UNION SELECT subproject FROM project_docs UNION SELECT project FROM register WHERE project IS NOT NULL UNION SELECT name FROM register")
def project_names_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, r = adapters.project_docs(spark, sf_dir), adapters.register(spark, sf_dir)
    return d.select(F.col("project").alias("name")).union(d.select("subproject")).union(r.where("project is not null").select("project")).union(r.select("name")).distinct()


@query("project_type_counts", f"WITH {adapters.PROJECT_DOCS_SQL} SELECT project, doc_type, count(*)::BIGINT AS docs, row_number() OVER (PARTITION BY project ORDER BY count(*) DESC, doc_type)::INT AS place FROM project_docs GROUP BY project, doc_type")
def project_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = adapters.project_docs(spark, sf_dir).groupBy("project", "doc_type").agg(F.count("*").alias("docs"))
    return each.withColumn("place", F.row_number().over(Window.partitionBy("project").orderBy(F.col("docs").desc(), "doc_type")))

"""Listings, roll-ups, reading and status reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions.text import ascii_lower, fold

UNKNOWN = "(unknown)"


def list_projects(docs: DataFrame, name: str | None = None, limit: int = 100) -> DataFrame:
    """(project, collection, docs, newest, sections, subprojects), running projects before archived ones."""
    each = docs.where("project is not null").groupBy("project", "collection").agg(
        F.count("*").alias("docs"),
        F.max("mtime").alias("newest"),
        F.array_join(F.array_sort(F.collect_set("section")), ", ").alias("sections"),
        F.array_sort(F.collect_set("subproject")).alias("subprojects"),
    )
    if name:
        low = ascii_lower(F.lit(name))
        each = each.where(F.contains(ascii_lower(F.col("project")), low) | F.exists("subprojects", lambda s: F.contains(ascii_lower(s), low)))
    return each.orderBy(F.col("collection").isNotNull(), "project", "collection").limit(min(max(limit, 1), 1000))


def unindexed(register: DataFrame, limit: int = 100) -> DataFrame:
    """Register rows without a project, by name: models, client, country, years and rows."""
    name = F.coalesce(F.nullif("name", F.lit("")), F.lit("(no name)"))
    out = register.where("project is null").groupBy(name.alias("name")).agg(
        F.array_join(F.array_sort(F.collect_set(F.nullif("model", F.lit("")))), ", ").alias("models"),
        F.max("client").alias("client"),
        F.max("country").alias("country"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.count("*").alias("rows"),
    )
    return out.orderBy("name").limit(limit)


def project_header(docs: DataFrame, project: str) -> DataFrame:
    """(docs, oldest, newest, collection) of a project or subproject, by name without regard to case."""
    mine = (ascii_lower(F.col("project")) == project.lower()) | (ascii_lower(F.col("subproject")) == project.lower())
    return docs.where(mine).agg(F.count("*").alias("docs"), F.min("mtime").alias("oldest"), F.max("mtime").alias("newest"), F.max("collection").alias("collection"))


def register_summary(register: DataFrame, most: int = 2) -> DataFrame:
    """(rows, linked, first_year, last_year, clients, leading): a register in one row; leading are its most frequent clients."""
    named = register.where("client <> ''").groupBy("client").agg(F.count("*").alias("n"))
    top = named.orderBy(F.col("n").desc(), "client").limit(most)
    leading = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "client"))), lambda x: F.concat(x["client"], F.lit(" ("), (-x["n"]).cast("string"), F.lit(")"))), ", ").alias("leading"))
    clients = named.agg(F.count("*").alias("clients"))
    totals = register.agg(F.count("*").alias("rows"), F.count("project").alias("linked"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return totals.crossJoin(F.broadcast(clients)).crossJoin(F.broadcast(leading))


def project_cards(docs: DataFrame, register: DataFrame, machines: DataFrame, votes: DataFrame, written: DataFrame, most: int = V.MAP_ROWS) -> DataFrame:
    """(project, part, place, line): what there is to say about every project, part by part.

    docs: (project, subproject, collection, doc_type, mtime, path); register: with project, reg_project,
    name, client, country, year; machines: (project, machines); votes: (number, project, docs, named);
    written: written_card(). Parts: header, register, moved (rows that the register has here and the
    documents elsewhere), machines, numbers, types (with the newest document of each), card, others.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))

    def part(name: str, rows: DataFrame, line: Column, *order: Column) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("project").orderBy(*order, line)) if order else F.lit(1)
        return rows.select("project", F.lit(name).alias("part"), rank.alias("place"), line.alias("line")).where(F.col("place") <= most)

    mine = docs.where("project is not null")
    date = lambda c: F.date_format(c, "yyyy-MM-dd")
    header = mine.groupBy("project").agg(F.count("*").alias("docs"), date(F.min("mtime")).alias("oldest"), date(F.max("mtime")).alias("newest"), F.max("collection").alias("collection"), F.count_distinct("subproject").alias("subs"))
    parts = [part("header", header, F.concat_ws(" · ", F.concat(text("docs"), F.lit(" documents")), F.concat("oldest", F.lit(" to "), "newest"), "collection", F.concat(text("subs"), F.lit(" subprojects"))))]
    rows = register.select("project", "reg_project", F.concat_ws(" · ", "name", "client", "country", F.col("year").cast("string")).alias("_line"), "year")
    parts.append(part("register", rows.where("project is not null"), F.col("_line"), F.col("year").desc_nulls_last()))
    moved = rows.where("reg_project is not null").select(F.col("reg_project").alias("project"), F.concat("_line", F.lit(" → "), "project").alias("_line"), "year")
    parts.append(part("moved", moved, F.col("_line"), F.col("year").desc_nulls_last()))
    parts.append(part("machines", machines.where(F.size("machines") > 0), F.array_join("machines", ", ")))
    parts.append(part("numbers", votes.where("project is not null"), F.concat("number", F.lit(" ("), text("docs"), F.lit(", "), text("named"), F.lit(" by name)")), F.col("docs").desc(), F.col("number")))
    types = mine.where("doc_type is not null").groupBy("project", "doc_type").agg(F.count("*").alias("n"), F.min_by("path", F.struct((-F.unix_micros(F.col("mtime").cast("timestamp"))).alias("t"), "path")).alias("newest"))
    parts.append(part("types", types, F.concat("doc_type", F.lit(": "), text("n"), F.lit(", newest "), "newest"), F.col("n").desc(), F.col("doc_type")))
    parts.append(part("card", written.where("card is not null or note is not null"), F.concat_ws(" — ", "note", "card")))
    who = F.explode(F.array(F.struct(F.lit("c").alias("kind"), F.lower("client").alias("who")), F.struct(F.lit("g").alias("kind"), F.lower("grp").alias("who"))))
    keyed = register.where("project is not null").select("project", "year", who.alias("w")).where("w.who <> ''").groupBy("project", "w").agg(F.max("year").alias("year"))
    # of a client or group its newest projects, so a frequent one is no group of all pairs: one more than are shown, as one may be the project itself
    newest = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("w").orderBy(F.col("year").desc_nulls_last(), "project"))).where(F.col("_r") <= most + 1)
    pairs = keyed.select("project", "w").join(newest.select(F.col("project").alias("other"), "w", "year"), "w").where("project <> other").groupBy("project", "other").agg(F.max("year").alias("year"))
    parts.append(part("others", pairs, F.col("other"), F.col("year").desc_nulls_last()))
    return reduce(DataFrame.unionByName, parts)


def newest_per_type(docs: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(doc_type, path, mtime): the newest document of each type, ties by path."""
    some = docs if types is None else docs.where(F.col("doc_type").isin(types))
    rank = F.row_number().over(Window.partitionBy("doc_type").orderBy(F.col("mtime").desc(), "path"))
    return some.withColumn("_r", rank).where("_r = 1").select("doc_type", "path", "mtime")


def histogram(docs: DataFrame, column: str) -> DataFrame:
    """(value, docs), most frequent first; null counts as (unknown)."""
    return docs.groupBy(F.coalesce(F.col(column), F.lit(UNKNOWN)).alias("value")).agg(F.count("*").alias("docs")).orderBy(F.col("docs").desc(), "value")


def folder_counts(docs: DataFrame, parts: Column, depth: int = V.MAP_DEPTH) -> DataFrame:
    """(folder, level, docs): documents under every folder down to a depth; parts are the folders of a path."""
    up = F.transform(F.sequence(F.lit(0), F.least(F.lit(depth), F.size(parts))), lambda i: F.slice(parts, F.lit(1), i))
    each = docs.select(F.explode(up).alias("_f")).groupBy("_f").agg(F.count("*").alias("docs"))
    return each.select(F.array_join("_f", "/").alias("folder"), F.size("_f").alias("level"), "docs")


def folder_tree(counts: DataFrame, least: int = V.MAP_MIN_DOCS) -> DataFrame:
    """(parent, folder, docs, smaller): folders of at least so many documents, and the rest of each parent in one row."""
    parent = F.when(F.col("level") == 1, F.lit("")).otherwise(F.regexp_replace("folder", "/[^/]*$", ""))
    kids = counts.where("level > 0").withColumn("parent", parent)
    large = kids.where(F.col("docs") >= least).select("parent", "folder", "docs", F.lit(0).cast("long").alias("smaller"))
    small = kids.where(F.col("docs") < least).groupBy("parent").agg(F.sum("docs").alias("docs"), F.count("*").alias("smaller"))
    # a folder stays only below folders that stay
    kept = large.select(F.col("folder").alias("_k")).union(counts.where("level = 0").select(F.lit("")))
    both = large.unionByName(small.select("parent", F.lit(None).cast("string").alias("folder"), "docs", "smaller"))
    return both.join(kept, F.col("parent") == F.col("_k"), "left_semi")


def tree_lines(tree: DataFrame, root: str, total: int, budget: int = V.MAP_CHARS) -> list[str]:
    """The tree as indented lines, cut to a number of characters.

    Only the rows that can be shown come to the driver: the first of the walk's order, in which a
    folder comes before what is in it and a parent's rest comes last.
    """
    part = lambda x: F.struct(F.lit(False).alias("rest"), F.lower(x).alias("low"), x.alias("name"))
    parts = lambda c: F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), "/"), lambda x: x != ""), part)
    rest = F.array(F.struct(F.lit(True).alias("rest"), F.lit("").alias("low"), F.lit("").alias("name")))
    walk = tree.withColumn("_walk", F.when(F.col("folder").isNull(), F.concat(parts(F.col("parent")), rest)).otherwise(parts(F.col("folder"))))
    lines = [f"{root} ({total} documents)"]
    # a line has at least "x (1)" and its end
    for r in walk.orderBy("_walk").limit(budget // 6 + 1).collect():
        indent = "  " * len(r._walk)
        if r.folder is None:
            lines.append(f"{indent}+ {r.smaller} smaller folder{'s' * (r.smaller != 1)} ({r.docs} document{'s' * (r.docs != 1)})")
        else:
            lines.append(f"{indent}{r.folder.rsplit('/', 1)[-1]} ({r.docs})")
    out, used = [], 0
    for line in lines:
        used += len(line) + 1
        if used > budget:
            return [*out, f"... {tree.count() + 1 - len(out)} more lines"]
        out.append(line)
    return out


def template_folders(docs: DataFrame, least: int = V.MAP_MIN_DOCS, most: int = V.MAP_ROWS) -> DataFrame:
    """(section, key, docs, projects, place): the leading folders of each section; place -1 sums the rest.

    docs: (section, key, project, subproject). Projects are counted by (project, subproject), nulls too.
    """
    each = docs.where("section is not null").groupBy("section", "key").agg(F.count("*").alias("docs"), F.count_distinct(F.struct(F.coalesce("project", F.lit("")), F.coalesce("subproject", F.lit("")))).alias("projects"))
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.col("docs") < least, F.col("projects").desc(), F.col("docs").desc(), "key"))
    placed = each.withColumn("place", F.when((F.col("docs") >= least) & (rank <= most), rank).otherwise(F.lit(-1)))
    top = placed.where("place > 0")
    rest = placed.where("place < 0").groupBy("section").agg(F.lit(None).cast("string").alias("key"), F.sum("docs").alias("docs"), F.count("*").alias("projects"), F.lit(-1).alias("place"))
    return top.select("section", "key", "docs", "projects", "place").unionByName(rest)


def read_pages(pages: DataFrame, first: int = 1, last: int | None = None, budget: int = V.READ_CHARS) -> DataFrame:
    """(page_no, text, cut): pages while their joint length stays within a budget; the first always, cut if need be."""
    some = pages.where(F.col("page_no") >= first)
    if last is not None:
        some = some.where(F.col("page_no") <= last)
    w = Window.partitionBy("doc_id").orderBy("page_no")
    used = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    is_first = F.row_number().over(w) == 1
    read = some.withColumns({"_used": used, "_first": is_first}).where((F.col("_used") <= budget) | F.col("_first"))
    return read.select("doc_id", "page_no", F.when(F.length("text") > budget, F.substring("text", 1, budget)).otherwise(F.col("text")).alias("text"), (F.length("text") > budget).alias("cut"))


def find_in_document(pages: DataFrame, needle: str, most: int = 20, context: int = V.FIND_CONTEXT) -> DataFrame:
    """(doc_id, page_no, hit, offset, context, total): non-overlapping occurrences, folded, up to so many of a document."""
    want = fold(F.lit(needle))
    gaps = F.split(fold(F.col("text")), F.concat(F.lit("\\Q"), want, F.lit("\\E")), -1)
    cut = pages.withColumn("_lengths", F.transform(gaps, lambda g: F.length(g)))
    n = len(needle)
    starts = F.slice("_lengths", F.lit(1), F.size("_lengths") - 1)
    # the start of each hit: gaps before it, and the hits among them
    summed = F.aggregate(starts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda a, x: F.struct((a["at"] + x + n).alias("at"), F.concat(a["all"], F.array(a["at"] + x)).alias("all")))["all"]
    each = cut.select("doc_id", "page_no", "text", F.posexplode(summed).alias("_k", "offset"))
    hit = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "offset"))
    total = F.count("*").over(Window.partitionBy("doc_id"))
    out = each.withColumns({"hit": hit, "total": total}).where(F.col("hit") <= min(max(most, 1), 100))
    begin = F.greatest(F.lit(0), F.col("offset") - context)
    return out.select("doc_id", "page_no", "hit", "offset", F.substring("text", begin + 1, F.col("offset") - begin + n + context).alias("context"), "total")


def paginate_blocks(blocks: DataFrame, page_chars: int = V.PAGE_CHARS) -> DataFrame:
    """(doc_id, page_no, text) of (doc_id, i, text, is_heading, is_break).

    A document with breaks has a page for each; another ends a page at the size, or at a heading
    beyond half of it. The fold over sizes is an aggregate over one document's blocks.
    """
    item = F.struct("i", "text", "is_heading", "is_break")
    docs = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("b"))
    has_breaks = F.exists("b", lambda x: x["is_break"])
    start = F.struct(F.lit(1).alias("page"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("pages"))

    def step(a: Column, x: Column) -> Column:
        size = F.length(x["text"])
        full = (a["used"] > 0) & ((a["used"] + size > page_chars) | (x["is_heading"] & (a["used"] > page_chars / 2)))
        new = F.when(has_breaks, x["is_break"] & (F.size(a["pages"]) > 0)).otherwise(full)
        page = a["page"] + F.when(new, 1).otherwise(0)
        return F.struct(page.alias("page"), F.when(new, size).otherwise(a["used"] + size).alias("used"), F.concat(a["pages"], F.array(page)).alias("pages"))

    placed = docs.withColumn("p", F.aggregate("b", start, step)["pages"]).select("doc_id", F.explode(F.arrays_zip("b", "p")).alias("x"))
    rows = placed.select("doc_id", F.col("x.p").alias("page_no"), F.col("x.b.i").alias("i"), F.col("x.b.text").alias("text"))
    return rows.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n").alias("text"))


def index_status(docs: DataFrame, chunks: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """(what, value, n): documents by status and by type, chunks, embedded chunks, recognised pages."""
    parts = [
        docs.groupBy("status").agg(F.count("*").alias("n")).select(F.lit("status").alias("what"), F.col("status").alias("value"), "n"),
        docs.where("status = 'ok'").groupBy("ext").agg(F.count("*").alias("n")).select(F.lit("ext").alias("what"), F.col("ext").alias("value"), "n"),
        chunks.agg(F.count("*").alias("n"), F.count_if("embedded").alias("e")).select(F.explode(F.array(F.struct(F.lit("chunks").alias("what"), F.lit("all").alias("value"), F.col("n")), F.struct(F.lit("chunks").alias("what"), F.lit("embedded").alias("value"), F.col("e").alias("n")))).alias("x")).select("x.*"),
    ]
    if ocr is not None:
        parts.append(ocr.groupBy("status").agg(F.count("*").alias("n")).select(F.lit("ocr").alias("what"), F.col("status").alias("value"), "n"))
    return reduce(DataFrame.unionByName, parts)


def problems(docs: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of the documents that could not be read, by path, with their total."""
    bad = docs.where(F.col("status").isin("error", "skipped", "empty", "no_text"))
    total = bad.agg(F.count("*").alias("total"))
    return bad.orderBy("path").offset(offset).limit(limit).crossJoin(F.broadcast(total))


def similar_names(indexed: DataFrame, register: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Up to so many names of projects, subprojects or register rows that contain a text."""
    low = ascii_lower(F.lit(name))
    names = [indexed.select(F.col("project").alias("name")), indexed.select("subproject"), register.select("name")]
    return reduce(DataFrame.union, names).where(F.contains(ascii_lower(F.col("name")), low)).distinct().orderBy("name").limit(limit)


def facet_lines(facets: DataFrame, machines: DataFrame, clients: DataFrame) -> DataFrame:
    """(doc_id, line): project, subproject, machines, client, collection, section and type of a document, in one line."""
    joined = facets.join(machines, "project", "left").join(clients, "project", "left")
    kind = F.when(F.col("doc_type").isNotNull(), F.concat("doc_type", F.coalesce(F.concat(F.lit(" ("), "facet_source", F.lit(")")), F.lit(""))))
    return joined.select("doc_id", F.concat_ws(" · ", "project", "subproject", F.array_join("machines", ", "), "client", "collection", "section", kind).alias("line"))

"""Machine evidence from documents and the linkage of a register with the projects they describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions.text import base_of, family_of, first_int, fold_ascii, key_of, models_in, numbers_in


def mentions(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(project, doc_id, family, model, in_name): what each document names, families included.

    docs: (doc_id, project, path, doc_type); pages: (doc_id, page_no, text). Names count below the
    project's own folder; texts on the first pages of types that describe the project's machine.
    """
    below = F.expr("substring(path, instr(lower(path), lower(project)) + length(project))")
    by_name = docs.where("project is not null").select("project", "doc_id", F.explode(models_in(below)).alias("m"), F.lit(True).alias("in_name"))
    first = pages.where(F.col("page_no") <= V.EVIDENCE_PAGES)
    some = docs.where(F.col("doc_type").isin(*V.EVIDENCE_TYPES) & F.col("project").isNotNull())
    by_text = first.join(some, "doc_id").select("project", "doc_id", F.explode(models_in(F.col("text"))).alias("m"), F.lit(False).alias("in_name"))
    each = by_name.unionByName(by_text).select("project", "doc_id", "in_name", F.col("m.family").alias("family"), F.explode(F.array_distinct(F.array(F.col("m.model"), F.lit("")))).alias("model"))
    return each.groupBy("project", "doc_id", "family", "model").agg(F.bool_or("in_name").alias("in_name"))


def confirmed(evidence: DataFrame) -> DataFrame:
    """(project, family, model, docs, name_docs, confirmed): two documents or a name, and a tenth of the project's best."""
    each = evidence.groupBy("project", "family", "model").agg(F.count("*").alias("docs"), F.count_if("in_name").alias("name_docs"))
    top = F.max("docs").over(Window.partitionBy("project"))
    enough = (F.col("docs") >= V.MIN_DOCS) | (F.col("name_docs") >= 1)
    return each.withColumn("confirmed", enough & (F.col("docs") >= V.MIN_SHARE * top))


def describe_machines(machines: DataFrame, most: int = 6) -> DataFrame:
    """(project, machines): the leading confirmed models, then families of which no model is confirmed."""
    is_model = F.coalesce(F.col("model") != "", F.lit(False))
    has_model = F.bool_or(is_model).over(Window.partitionBy("project", "family")) & F.col("project").isNotNull() & F.col("family").isNotNull()
    kind = F.when(is_model, F.lit(0)).when((F.col("model") == "") & ~has_model, F.lit(1))
    named = machines.where("confirmed").withColumn("kind", kind).where("kind is not null").select("project", F.when(F.col("kind") == 0, F.col("model")).otherwise(F.col("family")).alias("name"), "docs", "kind")
    rank = F.row_number().over(Window.partitionBy("project").orderBy("kind", F.col("docs").desc(), "name"))
    top = named.withColumn("rank", rank).where(F.col("rank") <= most)
    return top.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("machines"))


def number_evidence(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(number, project, docs, named): documents with a number in path or first pages, and those with it in the path."""
    by_path = docs.where("project is not null").select(F.explode(numbers_in(F.col("path"))).alias("number"), "project", "doc_id", F.lit(True).alias("in_path"))
    some = docs.where(F.col("doc_type").isin(*V.NUMBER_TYPES) & F.col("project").isNotNull()).select("doc_id", "project")
    by_text = pages.where(F.col("page_no") <= V.NUMBER_PAGES).join(some, "doc_id").select(F.explode(numbers_in(F.col("text"))).alias("number"), "project", "doc_id", F.lit(False).alias("in_path"))
    each = by_path.unionByName(by_text).groupBy("number", "project", "doc_id").agg(F.bool_or("in_path").alias("in_path"))
    return each.groupBy("number", "project").agg(F.count("*").alias("docs"), F.count_if("in_path").alias("named"))


def year_spans(docs: DataFrame) -> DataFrame:
    """(project, first_year, last_year) of projects with three dated documents, a tenth cut off at both ends."""
    years = docs.where("project is not null and mtime is not null").groupBy("project").agg(F.array_sort(F.collect_list(F.year("mtime"))).alias("y")).where(F.size("y") >= 3)
    cut = (F.size("y") / 10).cast("int")
    return years.select("project", F.get("y", cut).alias("first_year"), F.get("y", F.size("y") - 1 - cut).alias("last_year"))


def majority(votes: DataFrame, key: str) -> DataFrame:
    """(key, owner, owner_docs, owner_named, total): the project with the most documents, ties by name."""
    order = F.struct(F.col("docs"), F.col("named"))
    summed = votes.groupBy(key, "project").agg(F.sum("docs").alias("docs"), F.sum("named").alias("named"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(order.desc(), "project"))
    total = F.sum("docs").over(Window.partitionBy(key))
    return summed.withColumn("_r", best).withColumn("total", total).where("_r = 1").select(key, F.col("project").alias("owner"), F.col("docs").alias("owner_docs"), F.col("named").alias("owner_named"), "total")


def accepted(strong: Column) -> Column:
    """Whether a majority owns a row: enough documents (more where the row is linked already) and a clear share."""
    usual = (F.col("owner_docs") >= 2) | (F.col("owner_named") >= 1)
    firm = (F.col("owner_named") >= 2) | (F.col("owner_docs") >= 4)
    return F.when(strong, firm).otherwise(usual) & (F.col("owner_docs") >= V.OWNER_SHARE * F.col("total"))


def unambiguous(projects: DataFrame, key: Column) -> DataFrame:
    """(k, p): keys that one project alone has; empty keys match nothing."""
    keyed = projects.select(key.alias("k"), F.col("project").alias("p")).where("k <> ''").distinct()
    return keyed.groupBy("k").agg(F.min("p").alias("p"), F.count("*").alias("n")).where("n = 1").select("k", "p")


def link_register(register: DataFrame, projects: DataFrame, votes: DataFrame, machines: DataFrame, spans: DataFrame) -> DataFrame:
    """The register rows with project, matched_by, reg_project, family, family_ok, model_ok, year, client_key and notes.

    register: row_id, name, path, order_no, serial, model, year, client, grp, order_date, notes and
    what else it has; projects: (project); votes: number_evidence(); machines: confirmed();
    spans: year_spans(). The first of these links: the folder's key or base key, the name's key or
    base key, the row's numbers. Documents win: a strong other owner takes a row whose linked
    project has none of its numbers. Rows without a match stay, with a null project.
    """
    rows = register.withColumn("_folder", F.regexp_extract(F.replace(F.coalesce("path", F.lit("")), F.lit("\\"), F.lit("/")), "([^/]*)/*$", 1))
    rows = rows.withColumn("_numbers", numbers_in(F.col("order_no"), F.col("serial")))
    exact, base = unambiguous(projects, key_of(F.col("project"))), unambiguous(projects, base_of(F.col("project")))
    steps = [("folder", key_of(F.col("_folder")), exact), ("folder", base_of(F.col("_folder")), base), ("name", key_of(F.col("name")), exact), ("name", base_of(F.col("name")), base)]
    for i, (_, key, table) in enumerate(steps):
        rows = rows.withColumn("_k", key).join(table.withColumnRenamed("k", "_k").withColumnRenamed("p", f"_p{i}"), "_k", "left").drop("_k")
    linked = F.coalesce(*[F.col(f"_p{i}") for i in range(len(steps))])
    by = F.coalesce(*[F.when(F.col(f"_p{i}").isNotNull(), F.lit(s[0])) for i, s in enumerate(steps)])
    rows = rows.withColumn("_linked", linked).withColumn("_by", by)
    mine = rows.select("row_id", "_linked", F.explode("_numbers").alias("number")).join(votes, "number")
    own = mine.where(F.col("project") == F.col("_linked")).select("row_id", F.lit(True).alias("_has")).distinct()
    rows = rows.join(majority(mine, "row_id"), "row_id", "left").join(own, "row_id", "left")
    moved = F.col("_linked").isNotNull() & (F.col("owner") != F.col("_linked")) & F.col("_has").isNull() & accepted(F.lit(True))
    found = F.col("_linked").isNull() & F.col("owner").isNotNull() & accepted(F.lit(False))
    rows = rows.withColumns(
        {
            "project": F.when(moved | found, F.col("owner")).otherwise(F.col("_linked")),
            "matched_by": F.when(moved | found, F.lit("order")).otherwise(F.col("_by")),
            "reg_project": F.when(moved, F.col("_linked")),
            "family": family_of(F.col("model")),
        }
    )
    return _resolve_conflicts(rows, machines, spans)


def _resolve_conflicts(rows: DataFrame, machines: DataFrame, spans: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.col("docs").desc(), "model"))
    sure = machines.where("confirmed")
    of_project = sure.groupBy("project").agg(F.collect_set("family").alias("_families"), F.collect_set(F.when(F.col("model") != "", F.struct("family", "model"))).alias("_models"))
    top = sure.where("model <> ''").withColumn("_r", rank).where("_r <= 3").groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "model"))), lambda x: x["model"]), ", ").alias("_top"))
    rows = rows.join(of_project, "project", "left").join(top, "project", "left").join(spans, "project", "left")
    known = F.col("family").isin(*sorted(set(V.FAMILIES.values())))
    count = F.regexp_extract("model", r"(?i)(\d{1,2})\s*r(?![a-z])", 1)
    exact = F.concat("family", F.lit(" "), count.try_cast("int").cast("string"), F.lit("R"))
    same_family = F.filter("_models", lambda m: m["family"] == F.col("family"))
    has_model = F.exists(same_family, lambda m: (m["model"] == exact) | F.startswith(m["model"], F.concat(exact, F.lit(" "))))
    family_ok = ~(known & F.col("_families").isNotNull() & (F.size("_families") > 0) & ~F.array_contains("_families", F.col("family")))
    model_ok = family_ok & ~(known & (count != "") & (F.coalesce(F.size(same_family), F.lit(0)) > 0) & ~F.coalesce(has_model, F.lit(False)))
    given = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("order_date", F.lit("")), r"\d{4}", 0), F.lit("")).try_cast("int"), first_int(F.coalesce("year", F.lit(""))).cast("int"))
    outside = (given < F.col("first_year") - V.YEARS_BEFORE) | (given > F.col("last_year") + V.YEARS_AFTER)
    rows = rows.withColumns({"family_ok": F.coalesce(family_ok, F.lit(True)), "model_ok": F.coalesce(model_ok, F.lit(True)), "_given": given, "_outside": F.coalesce(outside, F.lit(False))})
    note = F.concat_ws(
        "; ",
        F.nullif(F.col("notes"), F.lit("")),
        F.when(F.col("reg_project").isNotNull(), F.concat(F.lit("the register has it under "), F.col("reg_project"))),
        F.when(~F.col("model_ok"), F.concat(F.lit("the documents name "), F.coalesce("_top", F.array_join("_families", ", ")))),
        F.when(F.col("_outside"), F.concat(F.lit("the register has the year "), F.col("_given").cast("string"))),
    )
    rows = rows.withColumns(
        {
            "year": F.when(F.col("_outside"), F.col("first_year")).otherwise(F.col("_given")),
            "notes": note,
            "client_key": F.concat(F.lit(" "), fold_ascii(F.col("client")), F.lit(" | "), fold_ascii(F.col("grp")), F.lit(" ")),
        }
    )
    gone = [c for c in rows.columns if c.startswith("_")]
    return rows.drop(*gone, "owner", "owner_docs", "owner_named", "total", "first_year", "last_year")


def other_projects(register: DataFrame, project: str, most: int = 25) -> DataFrame:
    """(project, year): other projects of the same client or group, newest first; blank names link nothing."""
    who = F.explode(F.array(F.struct(F.lit("client").alias("kind"), F.lower("client").alias("who")), F.struct(F.lit("group").alias("kind"), F.lower("grp").alias("who"))))
    keyed = register.where("project is not null").select("project", "year", who.alias("w")).where("w.who <> ''")
    mine = keyed.where(F.col("project") == project).select("w").distinct()
    out = keyed.where(F.col("project") != project).join(mine, "w", "left_semi").groupBy("project").agg(F.max("year").alias("year"))
    return out.orderBy(F.col("year").desc_nulls_last(), "project").limit(most)


def usual_client(register: DataFrame) -> DataFrame:
    """(project, client, n): the most frequent client of each project, ties by name."""
    each = register.where("project is not null and client <> ''").groupBy("project", "client").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.col("n").desc(), "client"))
    return each.withColumn("_r", rank).where("_r = 1").drop("_r")

"""Knowledge cards: parsing, catalog queries and the rules that a program can check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions.text import fold_ascii, form_of, path_key, split_list, stem_of

_SOURCE = r"(?<!\[)\[(?!\[)([^\[\]]+)\](?!\])"


def parse_cards(files: DataFrame) -> DataFrame:
    """(file, text) to (file, fields, lists, body, error); error is null for a readable card.

    fields is a map of header values as text; lists the values of those in square brackets.
    """
    text = F.replace(F.regexp_replace("text", "^﻿", ""), F.lit("\r\n"), F.lit("\n"))
    pattern = r"(?s)\A---\n(.*?)\n---\n?(.*)\z"
    text_of = _once(files, _text=text).select("file", "_text")
    cut = _once(text_of, _ok=F.rlike("_text", F.lit(pattern)), _head=F.regexp_extract("_text", pattern, 1))
    key = lambda x: F.trim(F.substring_index(x, ":", 1))
    value = lambda x: F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x)))
    lines = F.filter(F.split("_head", "\n"), lambda x: F.trim(x) != "")
    cut = _once(cut, _lines=F.transform(lines, lambda x: F.struct(x.alias("line"), key(x).alias("key"), value(x).alias("value"))))
    bad = F.filter("_lines", lambda x: ~F.rlike(x["line"], F.lit(r"^\s*[a-z_]+\s*:")))
    # of a key that stands twice, the last counts
    last = F.filter("_lines", lambda x, i: ~F.exists(F.slice("_lines", i + 2, F.size("_lines")), lambda y: y["key"] == x["key"]))
    fields = F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], x["value"])))
    cut = _once(cut, _bad=F.get(bad, F.lit(0))["line"])
    out = _once(cut, fields=F.when(F.col("_ok") & F.col("_bad").isNull(), fields)).withColumn("_body", F.regexp_extract("_text", pattern, 2))
    item = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))
    missing = F.array_join(F.filter(F.array(*[F.when(item(k) == "", F.lit(k)) for k in V.CARD_REQUIRED]), lambda x: x.isNotNull()), ", ")
    error = (
        F.when(~F.col("_ok"), F.lit("no header (a block between two --- lines at the top)"))
        .when(F.col("_bad").isNotNull(), F.concat(F.lit("not 'key: value': "), F.trim("_bad")))
        .when(missing != "", F.concat(F.lit("required header field missing: "), missing))
        .when(~item("status").isin(*V.CARD_STATUSES), F.concat(F.lit("status must be unreviewed or reviewed, not "), item("status")))
        .when(~F.rlike(item("written"), F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.concat(F.lit("written must be a date YYYY-MM-DD, not "), item("written")))
        .when(~F.rlike(item("read"), F.lit(r"^\d+$")), F.concat(F.lit("read must be a number of documents, not "), item("read")))
    )
    inner = lambda v: F.substring(v, F.lit(2), F.length(v) - 2)
    lists = F.transform_values("fields", lambda k, v: F.when(F.rlike(v, F.lit(r"(?s)^\[.*\]$")), split_list(inner(v))).when(v != "", F.array(v)).otherwise(F.array().cast("array<string>")))
    return out.select("file", "fields", lists.alias("lists"), F.regexp_replace("_body", r"\A\n+|\n+\z", "").alias("body"), error.alias("error"))


def _once(rows: DataFrame, **made: Column) -> DataFrame:
    """rows with columns that are made once a row, whatever is made of them: no filter or projection is merged with them."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))))


def values(key: str) -> Column:
    """The values of a header field of a parsed card; empty if it has none."""
    return F.coalesce(F.try_element_at("lists", F.lit(key)), F.array().cast("array<string>"))


def vocabulary(rows: DataFrame) -> DataFrame:
    """(kind, word, value) of (kind, value, synonym), folded; a word under two values keeps the first by value."""
    each = rows.select("kind", "value", F.explode(F.array(F.col("value"), F.col("synonym"))).alias("word")).where("word is not null")
    folded = each.select("kind", fold_ascii(F.col("word")).alias("word"), "value").where("word <> ''")
    return folded.groupBy("kind", "word").agg(F.min("value").alias("value"))


def vocabulary_duplicates(rows: DataFrame) -> DataFrame:
    """Words that stand under two values of a kind."""
    each = rows.select("kind", "value", F.explode(F.array(F.col("value"), F.col("synonym"))).alias("word")).where("word is not null")
    return each.groupBy("kind", fold_ascii(F.col("word")).alias("word")).agg(F.count_distinct("value").alias("n")).where("n > 1").select("kind", "word")


def canonical(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Adds value to (kind, word, ...): the word itself, or without -s, or without -es."""
    folded = words.withColumn("_w", fold_ascii(F.col("word")))
    out = folded
    for i, cut in enumerate(("", "s$", "es$")):
        table = vocab.select("kind", F.col("word").alias("_k"), F.col("value").alias(f"_v{i}"))
        key = F.regexp_replace("_w", cut, "") if cut else F.col("_w")
        out = out.withColumn("_k", key).join(table, ["kind", "_k"], "left").drop("_k")
    return out.withColumn("value", F.coalesce("_v0", "_v1", "_v2")).drop("_w", "_v0", "_v1", "_v2")


def entry_matches(key: str, wanted: str, wanted_value: str | None, values_by_form: Column | None) -> Column:
    """Whether an entry of a list field fits: its canonical form equals the wanted one or ends with it; else plain substring."""
    if wanted_value is None or values_by_form is None:
        return F.exists(values(key), lambda e: F.contains(fold_ascii(e), fold_ascii(F.lit(wanted))))
    end = " " + wanted_value
    form = lambda e: F.coalesce(F.try_element_at(values_by_form, fold_ascii(form_of(e))), form_of(e))
    return F.exists(values(key), lambda e: (form(e) == wanted_value) | F.endswith(form(e), F.lit(end)))


def catalog(cards: DataFrame, status: str | None = None, first_year: int | None = None, last_year: int | None = None, text: str | None = None, **contains: str) -> DataFrame:
    """Readable cards that satisfy all filters, by folded project. contains: header field = folded substring."""
    out = cards.where("error is null")
    if status:
        out = out.where(fold_ascii(F.element_at("fields", F.lit("status"))) == fold_ascii(F.lit(status)))
    for key, wanted in contains.items():
        out = out.where(F.exists(values(key), _has(wanted)))
    if text:
        out = out.where(F.contains(fold_ascii(F.concat_ws(" ", F.map_values("fields"), "body")), fold_ascii(F.lit(text))))
    if first_year is not None or last_year is not None:
        years = F.transform(F.flatten(F.transform(values("years"), lambda v: F.regexp_extract_all(v, F.lit(r"\d{4}"), F.lit(0)))), lambda y: y.cast("int"))
        out = out.where((F.size(years) > 0) & (F.array_max(years) >= (first_year or 0)) & (F.array_min(years) <= (last_year or 9999)))
    return out.withColumn("project", F.element_at("fields", F.lit("project"))).orderBy(fold_ascii(F.col("project")), "file")


def _has(wanted: str):
    return lambda v: F.contains(fold_ascii(v), fold_ascii(F.lit(wanted)))


def card_for(cards: DataFrame, name: str) -> DataFrame:
    """The card of that stem, else the only one whose stem ends with __name."""
    stem = fold_ascii(stem_of(F.col("file")))
    tail = fold_ascii(F.element_at(F.split(stem_of(F.col("file")), "__"), -1))
    want = fold_ascii(F.lit(name))
    some = cards.withColumn("_exact", stem == want).withColumn("_tail", F.contains("file", F.lit("__")) & (tail == want)).where("_exact or _tail")
    n = F.count_if("_tail").over(Window.partitionBy())
    e = F.count_if("_exact").over(Window.partitionBy())
    return some.withColumns({"_n": n, "_e": e}).where("_exact or (_e = 0 and _n = 1)").drop("_exact", "_tail", "_n", "_e")


def sourced_lines(cards: DataFrame) -> DataFrame:
    """(file, line_no, section, line): the bullets of the sections that must name their sources."""
    lines = cards.where("error is null").select("file", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    section = F.last(F.when(F.startswith("line", F.lit("## ")), F.col("line")), ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    known = reduce(lambda a, b: a | b, [F.startswith("section", F.lit(s)) for s in V.CARD_SOURCED])
    return lines.withColumn("section", section).where(F.startswith("line", F.lit("- ")) & known)


def unsourced_lines(body: Column) -> Column:
    """The bullets without a source, in the sections that must name their sources."""
    blocks = F.split(F.concat(F.lit("\n"), body), r"\n(?=## )")
    known = lambda b: reduce(lambda x, y: x | y, [F.startswith(b, F.lit(s)) for s in V.CARD_SOURCED])
    bare = lambda x: F.startswith(x, F.lit("- ")) & ~F.rlike(x, F.lit(_SOURCE))
    return F.flatten(F.transform(F.filter(blocks, known), lambda b: F.filter(F.split(b, "\n"), bare)))


def check(cards: DataFrame, vocab_rows: DataFrame, docs: DataFrame, projects: DataFrame) -> DataFrame:
    """(file, level, message) of all rules.

    docs: (path_key, project, mtime); projects: (project) known to index or register. A card of an
    unknown project has that error alone, apart from being unreadable.

    A card is parsed once: what the card alone decides is an array of issues, what needs a table is
    looked up in the same pass, as rows of (kind, word) or of a path.
    """
    known = projects.select(F.lower("project").alias("_p")).distinct().withColumn("_known", F.lit(True))
    newest = docs.groupBy(F.lower("project").alias("_p")).agg(F.max(F.to_date("mtime")).alias("_newest"))
    project = F.element_at("fields", F.lit("project"))
    base = cards.withColumn("project", F.when(F.col("error").isNull(), project)).withColumn("_p", F.lower("project"))
    base = base.join(known, "_p", "left").join(newest, "_p", "left")

    kind = "struct<kind:string,level:string,message:string,entry:string,word:string,path:string>"
    none = F.lit(None).cast("string")
    make = lambda kind, level=none, message=none, entry=none, word=none, path=none: F.struct(F.lit(kind).alias("kind"), level.alias("level"), message.alias("message"), entry.alias("entry"), word.alias("word"), path.alias("path"))
    issue = lambda message, level="error": make("issue", F.lit(level), message)
    when = lambda test, x: F.when(test, F.array(x)).otherwise(F.array().cast(f"array<{kind}>"))
    body = fold_ascii(F.col("body"))
    named = when(fold_ascii(F.element_at(F.split(stem_of(F.col("file")), "__"), -1)) != fold_ascii(F.col("project")), issue(F.concat(F.lit("file name and project differ: "), "project")))
    bare = F.transform(unsourced_lines(F.col("body")), lambda x: issue(F.concat(F.lit("no [source]: "), x)))

    def unbacked(key: str) -> Column:
        missing = F.filter(values(key), lambda v: ~F.contains(body, fold_ascii(v)))
        return F.transform(missing, lambda v: issue(F.concat(F.lit(f"{key} not in the text: "), v)))

    written = F.try_to_timestamp(F.element_at("fields", F.lit("written")), F.lit("yyyy-MM-dd")).cast("date")
    stale = when(written < F.col("_newest"), issue(F.concat(F.lit("older than the newest document: "), F.col("_newest").cast("string")), "warning"))

    def entries(name: str, key: str) -> Column:
        return F.transform(values(key), lambda e: make(name, entry=e, word=form_of(e)))

    cited = F.filter(F.array_distinct(F.regexp_extract_all("body", F.lit(_SOURCE), F.lit(1))), lambda x: F.contains(x, F.lit("\\")))
    place = lambda x: path_key(F.trim(F.regexp_replace(x, r"\s*,?\s*(?:p|pp|page|pages)\.?\s*[\d ,\-–]+$", "")))
    sources = F.transform(cited, lambda x: make("path", entry=x, path=place(x)))
    all_of = F.concat(named, bare, *map(unbacked, V.CARD_BACKED), *[entries(n, k) for n, k in V.CARD_WORD_LISTS], sources, stale)
    alone = lambda message: F.array(issue(message))
    found = F.when(F.col("error").isNotNull(), alone(F.col("error"))).when(F.col("_known").isNull(), alone(F.concat(F.lit("project unknown: "), "project"))).otherwise(all_of)
    each = base.select("file", body.alias("_body"), F.explode(found).alias("x")).select("file", "_body", "x.*")

    vocab = vocabulary(vocab_rows)
    synonyms = vocab.groupBy("kind", "value").agg(F.collect_set("word").alias("_words"))
    each = canonical(each, vocab).join(synonyms, ["kind", "value"], "left")
    each = each.join(docs.select("path_key", F.lit(True).alias("_indexed")).distinct(), F.col("path") == F.col("path_key"), "left")
    message = (
        F.when(F.col("kind") == "issue", F.col("message"))
        .when(F.col("kind") == "path", F.when(F.col("_indexed").isNull(), F.concat(F.lit("not indexed: "), "entry")))
        .when(F.col("value").isNull(), F.concat(F.lit("not in the vocabulary: "), "word"))
        .when(~F.exists("_words", lambda w: F.contains(F.col("_body"), w)), F.concat(F.lit("not in the text: "), "entry"))
    )
    own = each.select("file", F.coalesce("level", F.lit("error")).alias("level"), message.alias("message")).where("message is not null")
    doubled = vocabulary_duplicates(vocab_rows).select(F.lit("vocabulary").alias("file"), F.lit("error").alias("level"), F.concat(F.lit("listed twice: "), "word").alias("message"))
    return own.unionByName(doubled)


def written_card(cards: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, card, note): the card of a project or subproject: its own, a note if that cannot be read, else its parent's.

    projects: (project, parent), parent null for a project.
    """
    stem = fold_ascii(F.element_at(F.split(stem_of(F.col("file")), "__"), -1))
    mine = cards.select(stem.alias("_k"), "file", "body", "error").groupBy("_k").agg(F.min_by(F.struct("file", "body", "error"), "file").alias("c"))
    out = projects.withColumn("_k", fold_ascii(F.col("project"))).join(mine, "_k", "left").drop("_k").withColumnRenamed("c", "own")
    out = out.withColumn("_k", fold_ascii(F.col("parent"))).join(mine, "_k", "left").drop("_k").withColumnRenamed("c", "above")
    readable = lambda c: F.col(c).isNotNull() & F.col(f"{c}.error").isNull()
    card = F.when(readable("own"), F.col("own.body")).when(F.col("own").isNull() & readable("above"), F.col("above.body"))
    note = F.when(F.col("own.error").isNotNull(), F.concat(F.lit("the card cannot be read: "), F.col("own.error"))).when(F.col("own").isNull() & readable("above"), F.concat(F.lit("the card of "), F.col("parent")))
    return out.select("project", "parent", card.alias("card"), note.alias("note"))


def coverage(cards: DataFrame, projects: DataFrame) -> DataFrame:
    """(cards, unreadable, projects, with_card): one row on how far the catalog covers the projects known."""
    have = cards.where("error is null").select(fold_ascii(F.element_at("fields", F.lit("project"))).alias("_k")).distinct()
    all_ = projects.select(fold_ascii(F.col("project")).alias("_k")).where("_k is not null").distinct()
    covered = all_.join(have.withColumn("_has", F.lit(True)), "_k", "left").agg(F.count("*").alias("projects"), F.count("_has").alias("with_card"))
    counts = cards.agg(F.count("*").alias("cards"), F.count("error").alias("unreadable"))
    return counts.crossJoin(F.broadcast(covered))


def unreadable(cards: DataFrame) -> DataFrame:
    """(file, error) of the cards that cannot be read."""
    return cards.where("error is not null").select("file", "error")

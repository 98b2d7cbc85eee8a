"""Facets of documents from their paths, as rules over folder arrays.

``rules`` of the projects profile: numbered folders on top are containers; the first other folder is
the project, unless it is a section; a section more than one level below gives a subproject, the
folder just above it. The document type comes from words of the file name that name acceptance
tests, else from folder names (deepest first), else from other words of the file name, else from
the section. ``facet_source`` says which.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions.text import norm_name, stem_of

#: Types that words of a file name decide before any folder.
FIRST_TYPES = ("fat", "sat")


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def section_of(folder: Column) -> Column:
    """The section that a folder stands for, without regard to its number; else null."""
    return F.try_element_at(_map(V.SECTIONS), norm_name(F.regexp_replace(folder, r"^\d{1,2}[ _]", "")))


def is_container(folder: Column) -> Column:
    return F.rlike(folder, F.lit(r"^\d{1,2}_")) & section_of(folder).isNull()


def path_parts(path: Column) -> Column:
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")


def _first_word_rule(words: Column, types) -> Column:
    """The first type of which a word or phrase stands in ' words ', in the order of the table."""
    out = None
    for name, _, terms in types:
        test = reduce(lambda a, b: a | b, [F.contains(words, F.lit(f" {t} ")) for t in terms])
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out if out is not None else F.lit(None).cast("string")


def _folder_types() -> dict[str, str]:
    table: dict[str, str] = {}
    for name, folders, _ in V.DOCUMENT_TYPES:
        for f in folders:
            table.setdefault(f, name)
    return table


def project_facets(docs: DataFrame, path: str = "path", root_name: Column | str | None = None) -> DataFrame:
    """Adds collection, project, subproject, section, doc_type and facet_source; path is below its root."""
    root = F.lit(root_name) if isinstance(root_name, str) or root_name is None else root_name
    out = docs.withColumn("_parts", path_parts(F.col(path)))
    out = out.withColumns({"_folders": F.slice("_parts", F.lit(1), F.greatest(F.size("_parts") - 1, F.lit(0))), "_name": F.element_at("_parts", -1)})
    # leading containers, never the last folder
    out = out.withColumn("_sections", F.transform("_folders", section_of))
    last = F.size("_folders") - 1
    stops = F.filter(F.transform("_folders", lambda f, i: F.when(is_container(f) & (i < last), F.lit(-1)).otherwise(i)), lambda i: i >= 0)
    out = out.withColumn("_at", F.coalesce(F.array_min(stops), F.lit(0)))
    later = F.filter(F.transform("_sections", lambda s, i: F.when(s.isNotNull() & (i >= F.col("_at")), i)), lambda i: i.isNotNull())
    out = out.withColumn("_section_at", F.array_min(later))
    here = F.get("_folders", F.col("_at"))
    named = here.isNotNull() & F.get("_sections", F.col("_at")).isNull()
    deeper = named & (F.col("_section_at") > F.col("_at") + 1)
    out = out.withColumns(
        {
            "collection": F.when(named & (F.col("_at") > 0), F.get("_folders", F.col("_at") - 1)),
            "project": F.when(named, here).otherwise(root),
            "subproject": F.when(deeper, F.get("_folders", F.col("_section_at") - 1)),
            "section": F.get("_sections", F.col("_section_at")),
            "_below": F.when(named, F.slice("_folders", F.col("_at") + 2, F.size("_folders"))).otherwise(F.slice("_folders", F.col("_at") + 1, F.size("_folders"))),
            "_words": F.concat(F.lit(" "), F.regexp_replace(norm_name(stem_of(F.col("_name"))), r"[^\p{L}\p{N}]+", " "), F.lit(" ")),
        }
    )
    keys = F.transform(F.reverse("_below"), lambda f: norm_name(F.regexp_replace(f, r"^[\d ]+[ _.\-]*", "")))
    folder_type = F.get(F.filter(F.transform(keys, lambda k: F.try_element_at(_map(_folder_types()), k)), lambda t: t.isNotNull()), F.lit(0))
    first = _first_word_rule(F.col("_words"), [t for t in V.DOCUMENT_TYPES if t[0] in FIRST_TYPES])
    rest = _first_word_rule(F.col("_words"), V.DOCUMENT_TYPES)
    default = F.try_element_at(_map(V.SECTION_DEFAULT), F.col("section"))
    out = out.withColumns({"_first": first, "_folder": folder_type, "_rest": rest, "_default": default})
    out = out.withColumns(
        {
            "doc_type": F.coalesce("_first", "_folder", "_rest", "_default"),
            "facet_source": F.when(F.col("_first").isNotNull(), "name").when(F.col("_folder").isNotNull(), "folder").when(F.col("_rest").isNotNull(), "name").when(F.col("_default").isNotNull(), "section"),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def category_facets(docs: DataFrame, path: str = "path") -> DataFrame:
    """category: the first folder below the root; null for a file directly in the root."""
    parts = path_parts(F.col(path))
    return docs.withColumn("category", F.when(F.size(parts) > 1, F.get(parts, F.lit(0))))


def documentation_facets(docs: DataFrame, path: str = "path") -> DataFrame:
    """category, and language from the last tag such as _FR before an underscore or the end of the name."""
    name = stem_of(F.element_at(path_parts(F.col(path)), -1))
    tags = F.regexp_extract_all(name, F.lit(r"_(FR|DE|EN|ES|IT)(?=_|$)"), F.lit(1))
    return category_facets(docs, path).withColumn("language", F.lower(F.get(F.reverse(tags), F.lit(0))))

"""Facet, folder, date and visibility filters as predicates and semi-joins."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import ascii_lower, fold_ascii, is_under, parse_date, path_key


def values_of(text: str) -> list[str]:
    return [v.strip() for v in text.split(",") if v.strip()]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def facet_is(column: str, values: str) -> Column:
    """One of comma-separated values, without regard to the case of A-Z; a null facet matches none."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(ascii_lower(F.col(column)).isin([v.translate(low) for v in values_of(values)]), F.lit(False))


def project_is(values: str) -> Column:
    return facet_is("project", values) | facet_is("subproject", values)


def in_folder(key: str, folder: str) -> Column:
    return is_under(F.col(key), path_key(F.lit(folder)))


def modified_after(column: str, date: str) -> Column:
    return F.col(column) >= parse_date(F.lit(date)).cast("timestamp")


def client_is(column: str, values: str) -> Column:
    """Whole words of a client key (' client | group '), any of the values."""
    return any_of([F.contains(F.col(column), F.concat(F.lit(" "), fold_ascii(F.lit(v)), F.lit(" "))) for v in values_of(values)])


def client_number_is(column: str, value: str) -> Column:
    """The last digits of a number in a client's name, at its end or before a #."""
    return F.contains(F.concat(F.lower(column), F.lit("#")), F.lit(value.lower() + "#"))


def country_is(column: str, values: str) -> Column:
    return facet_is(column, values)


def years_overlap(column: str, first: int | None, last: int | None) -> Column:
    lower = F.lit(True) if first is None else F.col(column) >= first
    return lower & (F.lit(True) if last is None else F.col(column) <= last)


def projects_with_machine(machines: DataFrame, register: DataFrame, value: str) -> DataFrame:
    """Projects where a family or model is confirmed by documents, or delivered by the register."""
    named = lambda c: facet_is(c, value)
    seen = machines.where(F.col("confirmed") & (named("family") | named("model"))).select("project")
    sold = register.where(F.col("family_ok") & (named("family") | (F.col("model_ok") & named("model")))).select("project")
    return seen.union(sold).where("project is not null").distinct()


def pictures_only(chunks: DataFrame, picture_chunks: DataFrame) -> DataFrame:
    """The chunks that tell what a picture shows (chunk_id)."""
    return chunks.join(picture_chunks.select("chunk_id"), "chunk_id", "left_semi")


def with_filters(docs: DataFrame, facets: DataFrame, folder: str | None = None, file_type: str | None = None, after: str | None = None, machines: DataFrame | None = None, projects: DataFrame | None = None, **wanted: str) -> DataFrame:
    """docs that satisfy all filters; facet filters are semi-joins, so documents without facets drop out.

    wanted: project, doc_type, section, collection, category, language.
    """
    out = docs
    if folder:
        out = out.where(in_folder("path_key", folder))
    if file_type:
        out = out.where(ascii_lower(F.col("ext")) == "." + file_type.lower().lstrip("."))
    if after:
        out = out.where(modified_after("mtime", after))
    tests = [project_is(v) if k == "project" else facet_is(k, v) for k, v in wanted.items() if v]
    if tests:
        out = out.join(facets.where(reduce(lambda a, b: a & b, tests)).select("doc_id"), "doc_id", "left_semi")
    if projects is not None:
        mine = facets.join(projects.select("project").distinct(), "project", "left_semi").select("doc_id")
        out = out.join(mine, "doc_id", "left_semi")
    return out


def visible(docs: DataFrame, roots: list[str], excluded: list[str] = (), key: str = "path_key") -> DataFrame:
    """docs under some root and under no excluded folder; the lists are the configuration, a few paths."""
    inside = any_of([in_folder(key, r) for r in roots])
    return docs.where(inside & ~any_of([in_folder(key, x) for x in excluded]))


def resolve_folder(docs: DataFrame, name: str, roots: list[str] = ()) -> DataFrame:
    """The shallowest folder of that name, as one row ``folder``; a path below a root is taken as it is."""
    wanted = name.strip("/\\").replace("\\", "/").lower()
    place = F.instr("path_key", f"/{wanted}/")
    found = docs.where(place > 0).select(F.substring("path_key", F.lit(1), place + len(wanted)).alias("folder"), place.alias("_at"))
    return found.orderBy("_at", "folder").limit(1).select("folder")


def glob_regex(pattern: str) -> str:
    """A glob with * and ? as an anchored regular expression."""
    parts = [".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower()]
    return "^" + "".join(parts) + "$"


def is_excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a glob fits the whole path (patterns with a slash) or any name on the way to the file."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    names = F.filter(F.split(low, "/"), lambda x: x != "")
    tests = [F.rlike(low, F.lit(glob_regex(p))) if "/" in p else F.exists(names, _fits(glob_regex(p))) for p in patterns]
    return any_of(tests)


def _fits(regex: str):
    return lambda x: F.rlike(x, F.lit(regex))


def longest_root(docs: DataFrame, roots: DataFrame, key: str = "path_key") -> DataFrame:
    """Adds the longest root that a path is under, or null.

    A path has as many candidates as folders, so the join is on equal folder, not on a range.
    """
    parts = F.split(key, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    up = docs.select(key, F.explode(F.array_distinct(F.transform(folders, lambda f: F.when(f == "", F.lit("/")).otherwise(f)))).alias("root")).distinct()
    best = up.join(roots.select("root").distinct(), "root").groupBy(key).agg(F.max_by("root", F.length("root")).alias("root"))
    return docs.join(best, key, "left")

"""Text functions as native Column expressions.

The four kinds of folding are kept apart, since results depend on which one is used:
``fold`` (accents and case, one character for one, so offsets hold), ``ascii_lower`` (A-Z only),
``norm_name`` (folder and file names), ``norm_terms`` (thesaurus terms) and ``fold_ascii``
(register keys: what is not ASCII is dropped).
"""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose, and their base letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def strip_accents(c: Column) -> Column:
    """Base letters for accented ones; texts without any are passed over, since translate() looks at each character."""
    return F.when(F.rlike(c, F.lit("[\u00C0-\u024F\u1E00-\u1EFF]")), F.translate(c, ACCENTED, PLAIN)).otherwise(c)


def fold(c: Column) -> Column:
    return F.lower(strip_accents(c))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def norm_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(strip_accents(F.lower(c)), r"[\s_\-]+", " "))


def norm_terms(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(strip_accents(F.lower(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ")


def fold_ascii(c: Column) -> Column:
    plain = F.lower(F.regexp_replace(strip_accents(F.coalesce(c, F.lit(""))), r"[^\x00-\x7F]", ""))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def key_of(c: Column) -> Column:
    """fold_ascii without spaces: the key of a name."""
    return F.replace(fold_ascii(c), F.lit(" "), F.lit(""))


def base_of(c: Column) -> Column:
    """The key of a name without trailing old, bis, backup or doc."""
    return F.replace(F.regexp_replace(fold_ascii(c), r"(?:[\s_\-]*(?:old|bis|backup|doc))+$", ""), F.lit(" "), F.lit(""))


def clean_text(c: Column) -> Column:
    """No NUL or soft hyphen, one kind of line end, single blanks, at most one empty line, no outer space.

    Blanks go in three linear passes; none of the patterns can backtrack over a run.
    """
    c = F.replace(F.replace(c, F.lit("\x00"), F.lit("")), F.lit("­"), F.lit(""))
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    c = F.regexp_replace(c, "[ \t ]+", " ")
    c = F.replace(F.replace(c, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def tokens(c: Column) -> Column:
    """Words as the lexical index sees them: folded runs of letters and digits."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def numbers_in(*values: Column) -> Column:
    """Distinct order and serial numbers of some texts, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(v, F.lit("")), F.lit(V.NUMBER_PATTERN), F.lit(1)) for v in values]))))


def first_int(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\d+", 0), F.lit("")).try_cast("long")


def models_in(c: Column) -> Column:
    """Distinct (family, model) that a text names; model is '' where no robot count follows, or it is 0."""
    whole = "(?i)" + V.FAMILY_PATTERN + "(?:" + V.ROBOTS_PATTERN + ")?"
    part = lambda x, k: F.regexp_extract(x, whole, k)

    families = F.create_map(*[F.lit(y) for x in V.FAMILIES.items() for y in x])

    def model(x: Column) -> Column:
        # a match is cut out and read again, with a blank that stands for what follows
        x = F.concat(x, F.lit(" "))
        family = F.element_at(families, F.lower(part(x, 1)))
        count = F.nullif(part(x, 3), F.lit("")).try_cast("int")
        square = F.lower(F.concat(part(x, 2), part(x, 4))).contains("sq")
        named = F.concat(family, F.lit(" "), count.cast("string"), F.lit("R"), F.when(square, F.lit(" SQ")).otherwise(F.lit("")))
        return F.struct(family.alias("family"), F.when(count > 0, named).otherwise(F.lit("")).alias("model"))

    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(whole), F.lit(0)), model)))


def family_of(model: Column) -> Column:
    """The family in a model's name, else its first word in title case."""
    families = F.create_map(*[F.lit(y) for x in V.FAMILIES.items() for y in x])
    found = F.lower(F.regexp_extract(model, "(?i)" + V.FAMILY_PATTERN, 1))
    return F.when(found != "", F.element_at(families, found)).otherwise(F.initcap(F.substring_index(F.coalesce(model, F.lit("")), " ", 1)))


def bound(value: Column, body) -> Column:
    """Evaluates a value once and hands it to body as a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def snippet(text: Column, words: list[str], size: int = V.SNIPPET) -> Column:
    """White space collapsed; a longer text is cut to a window around the first of the words."""
    used = [w for w in dict.fromkeys(words) if len(w) > 2 and w not in V.STOP_WORDS]

    def first(low: Column) -> Column:
        return F.coalesce(F.array_min(F.filter(F.array(*[F.instr(low, w) for w in used]), lambda p: p > 0)), F.lit(1)) - 1

    def cut(flat: Column) -> Column:
        def window(at: Column) -> Column:
            start = F.greatest(F.lit(0), at - size // 3)
            return F.concat(F.when(start > 0, F.lit("…")).otherwise(F.lit("")), F.substring(flat, start + 1, F.lit(size)), F.when(start + size < F.length(flat), F.lit("…")).otherwise(F.lit("")))

        place = bound(fold(flat), first) if used else F.lit(0)
        return F.when(F.length(flat) <= size, flat).otherwise(bound(place, window))

    return bound(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), cut)


def parse_date(c: Column) -> Column:
    """yyyy-MM-dd, dd.MM.yyyy or dd/MM/yyyy; another non-null value raises an error."""
    found = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy")]).cast("date")
    return F.when(c.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("not a date: "), c)))


def size_label(c: Column) -> Column:
    """Bytes as B, KB, MB or GB in steps of 1024."""
    unit = lambda power, name: F.concat(F.format_number(c / 1024**power, 1), F.lit(f" {name}"))
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1024**2, unit(1, "KB")).when(c < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def strength(similarity: Column) -> Column:
    return F.when(similarity >= V.STRONG, F.lit("strong")).when(similarity >= V.MEDIUM, F.lit("medium")).when(similarity.isNotNull(), F.lit("weak"))


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def embedding_text(name: Column, title: Column, text: Column) -> Column:
    """A header line of name and title (unless the name holds it), then the text, capped."""
    more = title.isNotNull() & (title != "") & ~F.lower(name).contains(F.lower(title))
    return F.substring(F.concat(name, F.when(more, F.concat(F.lit(" — "), title)).otherwise(F.lit("")), F.lit("\n"), text), 1, V.EMBED_CHARS)


def picture_passage(description: Column, seen_text: Column, keywords: Column, marker: Column, file: Column, folders: Column) -> Column:
    """Two or three lines about a picture, for the index."""
    head = F.concat(marker, F.lit(" "), description)
    words = F.nullif(F.array_join(keywords, ", "), F.lit(""))
    return F.concat_ws("\n", head, F.concat_ws(" | ", F.nullif(seen_text, F.lit("")), words), F.concat_ws(" — ", file, F.nullif(folders, F.lit(""))))


def cut_words(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at a word's end and marked with an ellipsis."""
    short = F.regexp_extract(c, rf"(?s)^.{{0,{limit - 1}}}(?=\s)", 0)
    return F.when(F.length(c) <= limit, c).when(short != "", F.concat(F.rtrim(short), F.lit("…"))).otherwise(F.concat(F.substring(c, 1, limit - 1), F.lit("…")))


ANSWER = "struct<type:string,description:string,visible_text:string,keywords:array<string>>"


def picture_answer(json: Column) -> Column:
    """A model's JSON answer, validated and capped; error is null for a good one."""
    x = F.from_json(json, ANSWER)
    words = F.filter(F.transform(x["keywords"], lambda w: F.substring(F.trim(w), 1, 40)), lambda w: w != "")
    first = F.filter(words, lambda w, i: F.coalesce(F.array_position(F.transform(words, lambda y: F.lower(y)), F.lower(w)), F.lit(0)) == i + 1)
    good = F.coalesce(F.trim(x["description"]), F.lit("")) != ""
    return F.struct(
        F.substring(F.trim(x["type"]), 1, 30).alias("type"),
        F.substring(F.trim(x["description"]), 1, 1000).alias("description"),
        F.substring(F.trim(x["visible_text"]), 1, 500).alias("visible_text"),
        F.slice(first, 1, 12).alias("keywords"),
        F.when(~good, F.lit("no description")).alias("error"),
    )


#: A word of a recognised line: letters joined by an apostrophe or a hyphen, punctuation around it aside. Between
#: blanks, with a vowel; and such words of two letters.
_LINE_WORD = r"[(\[{«\"'‘’“”„.,;:!?…/*•–—-]*+\p{L}++(?:['’-]\p{L}++)*+[)\]}»\"'‘’“”„.,;:!?…/*–—-]*+"
_VOWEL = "[aeiouyàâäáãåæèéêëìíîïòóôöõøœùúûüýÿAEIOUYÀÂÄÁÃÅÆÈÉÊËÌÍÎÏÒÓÔÖÕØŒÙÚÛÜÝŸ]"
_WORDS = rf"(?<![^ \t\n\f\r])(?=[^ \t\n\f\r]*?{_VOWEL}){_LINE_WORD}(?![^ \t\n\f\r])"
_LONG_WORDS = rf"(?<![^ \t\n\f\r])(?=[^ \t\n\f\r]*?{_VOWEL})(?=[^ \t\n\f\r\p{{L}}]*+\p{{L}}[^ \t\n\f\r\p{{L}}]*+\p{{L}}){_LINE_WORD}(?![^ \t\n\f\r])"


def keeps_line(line: Column) -> Column:
    """Whether a recognised line is text: two words of two letters, and words for half of its tokens.

    Each count is one pass over the line, and the cheap ones decide first.
    """
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    return (count(_LONG_WORDS) >= 2) & (count(_WORDS) * 2 >= count(r"[^ \t\n\f\r]+"))


def filter_lines(c: Column) -> Column:
    return clean_text(F.array_join(F.filter(F.split(c, "\n"), keeps_line), "\n"))


def capped_dpi(width_points: Column, height_points: Column, dpi: int, most: int = V.OCR_MAX_PIXELS) -> Column:
    """The resolution at which a page stays within a number of pixels."""
    pixels = width_points / 72 * dpi * (height_points / 72) * dpi
    return F.when(pixels > most, F.floor(dpi * F.sqrt(most / pixels))).otherwise(F.lit(dpi)).cast("int")


def split_list(c: Column) -> Column:
    """Items between commas; commas inside parentheses belong to their item."""
    return F.filter(F.transform(F.split(c, r",(?![^(]*\))"), lambda x: F.trim(x)), lambda x: x != "")


def form_of(entry: Column) -> Column:
    return F.trim(F.substring_index(entry, "(", 1))


def stem_of(file: Column) -> Column:
    return F.regexp_replace(file, r"\.[^.]*$", "")


def path_key(path: Column) -> Column:
    """Slashes made one kind, doubled ones and a last one removed, case folded as file systems do."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/"), "(?<=.)/$", ""))


def is_under(key: Column, folder: Column) -> Column:
    """Whether a path is a folder or inside it; never a mere string prefix."""
    return (key == folder) | F.startswith(key, F.concat(F.regexp_replace(folder, "/$", ""), F.lit("/")))


def safe_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]+', "_"))


def picture_title(file: Column) -> Column:
    return F.trim(F.regexp_replace(stem_of(F.substring_index(file, "/", -1)), r"[_\-]+", " "))


#: A picture link of Markdown: caption and target.
PICTURE_LINK = r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)"


def number_matches(text: Column, pattern: str, label, group: int = 1) -> Column:
    """Replaces the k-th match by label(k, its group), in one pass over the gaps between matches."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    marks = F.transform(found, lambda x, i: label(i + 1, x))
    return F.array_join(F.zip_with(gaps, marks, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


def number_pictures(markdown: Column) -> Column:
    return number_matches(markdown, PICTURE_LINK, lambda k, caption: F.concat(F.lit("[Image "), k.cast("string"), F.when(caption != "", F.concat(F.lit(": "), caption)).otherwise(F.lit("")), F.lit("]")))


def pictures_of(markdown: Column) -> Column:
    """(caption, target) of the picture links, in order."""
    each = lambda k: F.regexp_extract_all(markdown, F.lit(PICTURE_LINK), F.lit(k))
    return F.arrays_zip(each(1).alias("caption"), each(2).alias("target"))


def picture_context(markdown: Column, k: int) -> Column:
    """The nearest heading above the k-th picture, and the paragraph before it."""
    before = F.array_join(F.slice(F.split(markdown, PICTURE_LINK, -1), 1, k), "")
    headings = F.regexp_extract_all(F.concat(F.lit("\n"), before), F.lit(r"\n#+\s*([^\n]+)"), F.lit(1))
    paragraphs = F.filter(F.split(before, r"\n\s*\n"), lambda p: (F.trim(p) != "") & ~F.startswith(F.trim(p), F.lit("#")))
    last = lambda x: F.get(F.reverse(x), F.lit(0))
    return F.struct(last(headings).alias("heading"), F.trim(last(paragraphs)).alias("paragraph"))


def link_candidates(target: Column, file: Column, roots: list[str]) -> Column:
    """Paths that a Markdown link may mean, best first: beside the file, then each root with ever shorter tails (two names at least)."""
    clean = F.regexp_replace(F.replace(F.regexp_replace(target, "[#?].*$", ""), F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    folder = F.regexp_replace(file, "/[^/]*$", "")
    beside = F.concat(folder, F.lit("/"), clean)
    names = F.filter(F.split(clean, "/"), lambda x: ~x.isin("", ".", ".."))
    tails = F.transform(F.when(F.size(names) >= 2, F.sequence(F.lit(1), F.size(names) - 1)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "/"))
    rooted = [F.transform(F.coalesce(tails, F.array().cast("array<string>")), _under(root)) for root in roots]
    return F.array_distinct(F.concat(F.array(F.when(F.startswith(clean, F.lit("/")), clean).otherwise(beside)), *rooted))


def _under(root: str):
    return lambda t: F.concat(F.lit(root.rstrip("/") + "/"), t)


def hash_terms(words: Column, dim: int) -> Column:
    """The bucket of each word: the first four bytes of its MD5, little-endian, modulo dim."""
    if dim <= 256 and 256 % dim == 0:
        # the remainder is that of the first byte alone
        return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 2), 16, 10).cast("int") % dim))
    value = lambda h: F.conv(F.concat(*[F.substring(h, p, 2) for p in (7, 5, 3, 1)]), 16, 10).cast("long")
    return F.transform(F.transform(words, lambda w: F.md5(w)), lambda h: (value(h) % dim).cast("int"))

"""Quality rules as a short-circuit cascade, in native expressions only.

A rule is a condition over the text, with an estimate of its work as a second expression. All rules
are measured on a bounded sample in one job: for every combination of rejecting rules that occurs,
the number of documents and the work of each rule on them. ``best_order`` then puts that rule next
which rejects most of the documents still there per unit of work spent on them. ``first_failed`` is
one CASE expression: what a rule needs beyond the measures that every document gets anyway is made
inside its own branch, so for a document that an earlier rule has rejected the later rules cost
nothing. The order changes work and the reported reason, never which documents are kept;
``cascade_counts`` tells how many documents each rule judged, rejected and skipped.

Work is counted in characters that a regular expression passes over; unlike seconds, it gives the
same order on every run.

Null text counts as empty: no words, so ``base`` rejects it. Documents with the same doc_id are
judged one by one. Other columns pass through; columns of the names that are added here are replaced.
An empty table gives an empty result. Texts may be of any length; a text's words and windows are
held in memory together.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
#: Rows on which work and selectivities are estimated, and files that they are taken from; they only set the order of the rules.
SAMPLE_ROWS, SAMPLE_FILES, SAMPLE_SEED = 2000, 8, 7
#: Lines of a text from which on shares of its lines count.
LEAST_LINES = 5
#: What occurs once in each line that has a word, that is an item of a list, that ends in dots.
LINE = r"[^\x20\x09-\x0D][^\n]*+"
BULLET = r"(?<![^\n])[ \t]*+[-*•‣▪·][ \t]"
ELLIPSIS = r"(?:\.\.\.|…)[ \t\r]*+(?=\n|\z)"
#: The start of a word with a letter; anchored at the word, so words of any length take linear time.
LETTERED = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*+\p{L}"


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for a document to reject (null counts as false); ``work`` estimates what it costs."""

    name: str
    fails: Column
    work: Column


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body`` as a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def body_of(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def words_of(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(WORD), F.lit(0))


def repeated_words(windows: Column, width: int = WINDOW) -> Column:
    """Words inside windows that occur at least twice among ``windows``, in the order of their first words."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(places, i + 1) - x, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def twins(pairs: Column) -> Column:
        same = lambda i, x: F.coalesce(F.get(pairs, i)["h"] == x["h"], F.lit(False))
        return F.filter(pairs, lambda x, i: F.when(i > 0, same(i - 1, x)).otherwise(F.lit(False)) | same(i + 1, x))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(pairs, lambda p: let(F.sort_array(F.transform(twins(p), lambda x: x["i"])), covered))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, all long.

    Windows are compared by 64-bit hashes first, made of the hashes of their words: if all differ, so
    do the windows. Only where two hashes are equal the windows themselves are compared.
    """
    out = docs.withColumns({"__quill_body": body_of(text), "__quill_words": words_of(body_of(text))})
    n = F.size("__quill_words")
    places = F.sequence(F.lit(1), n - (WINDOW - 1))
    hashed = F.transform("__quill_words", lambda w: F.xxhash64(w))
    # two steps of four and two parts; the last places have no window
    half = lambda h: F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW // 2)]))
    both = lambda g: F.transform(g, lambda x, i: F.xxhash64(x, F.get(g, i + WINDOW // 2)))
    windows = F.slice(let(hashed, lambda h: let(half(h), both)), F.lit(1), n - (WINDOW - 1))
    out = out.withColumns({"__quill_lines": F.split(F.col("__quill_body"), "\n"), "__quill_windows": F.when(n > WINDOW, windows), "n_words": n.cast("long")})
    lines = F.col("__quill_lines")
    worded = lambda x: F.filter(x, lambda y: F.rlike(y, F.lit(WORD)))
    doubled = F.size(F.array_distinct(lines)) < F.size(lines)
    whole = F.size(F.array_distinct("__quill_windows")) == F.size("__quill_windows")
    return out.withColumns(
        {
            "word_chars": F.length(F.array_join("__quill_words", "")).cast("long"),
            "n_symbols": F.regexp_count("__quill_body", F.lit(SYMBOL)).cast("long"),
            "n_dup_lines": F.when(doubled, F.size(worded(lines)) - F.size(F.array_distinct(worded(lines)))).otherwise(F.lit(0)).cast("long"),
            # a word has no blank, so the joined words are the window
            "n_repeat_words": F.when(F.col("__quill_windows").isNull() | whole, F.lit(0)).otherwise(repeated_words(F.transform(places, lambda i: F.array_join(F.slice("__quill_words", i, WINDOW), " ")))).cast("long"),
        }
    ).drop("__quill_body", "__quill_words", "__quill_lines", "__quill_windows")


def base_failed() -> Column:
    """Over measure(): fewer than 20 words, or over 30 % of the words inside repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def default_rules(text: str = "text") -> list[Rule]:
    """Over the text and the columns of measure(). Shares are of words or of lines with a word; a text without any fails none.

    A rule over measures alone has next to no work; another one's conditions begin with the cheap ones.
    """
    body, words, chars = body_of(text), F.col("n_words"), F.col("word_chars")
    lines = F.regexp_count(body, F.lit(LINE))
    passes = lambda n: (F.length(body) * n).cast("double")
    dots = F.contains(body, F.lit("...")) | F.contains(body, F.lit("…"))
    starts = F.regexp_count(body, F.lit(BULLET))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > words, F.lit(1.0)),
        Rule("long_words", chars > 20 * words, F.lit(1.0)),
        Rule("short_words", chars < 2 * words, F.lit(1.0)),
        Rule("duplicate_lines", (F.col("n_dup_lines") > 0) & (2 * F.col("n_dup_lines") > lines), F.when(F.col("n_dup_lines") > 0, passes(1)).otherwise(F.lit(1.0))),
        Rule("no_letters", 2 * F.regexp_count(body, F.lit(LETTERED)) < words, passes(1)),
        Rule("bullets", (starts >= LEAST_LINES) & (lines >= LEAST_LINES) & (10 * starts > 9 * lines), passes(1)),
        Rule("ellipses", dots & (lines >= LEAST_LINES) & (10 * F.regexp_count(body, F.lit(ELLIPSIS)) > 3 * lines), F.when(dots, passes(2)).otherwise(passes(0.2))),
    ]


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS, text: str = "text") -> DataFrame:
    """At most ``rows`` texts out of a few files that a seed picks, so the others are not read.

    A table that is not read from files gives its first rows instead.
    """
    texts = lambda df: df.select(F.col(text))
    try:
        files = sorted(docs.inputFiles())
        chosen = random.Random(SAMPLE_SEED).sample(files, min(SAMPLE_FILES, len(files)))
        each = -(-rows // max(len(chosen), 1))
        # a condition on the file's path alone prunes the other files from the scan
        parts = [texts(docs.where(F.col("_metadata.file_path") == f)).limit(each) for f in chosen]
    except AnalysisException:
        parts = []
    out = None
    for part in parts:
        out = part if out is None else out.unionAll(part)
    if out is None or out.isEmpty():
        out = texts(docs).limit(rows)
    return out


def sample_counts(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS, text: str = "text") -> list[tuple[int, int, list[float]]]:
    """(bit mask of rejecting rules, documents, work of each rule on them) on the sample; at most ``rows`` masks."""
    bits = [F.when(F.coalesce(r.fails, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(rules)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    work = [F.sum(r.work).alias(f"w{i}") for i, r in enumerate(rules)]
    found = measure(sample_of(docs, rows, text), text).groupBy(mask.alias("mask")).agg(F.count("*").alias("n"), *work).collect()
    return [(r["mask"], r["n"], [r[f"w{i}"] or 0.0 for i in range(len(rules))]) for r in sorted(found)]


def best_order(counts: list[tuple[int, int, list[float]]], rules: list[Rule]) -> list[Rule]:
    """The rules, next always that with most rejections per work among the documents that the ones before let through.

    Without a sample, and among equals, the given order stays.
    """
    left, out = list(range(len(rules))), []
    while left:

        def gain(i: int) -> float:
            rejected = sum(n for mask, n, _ in counts if mask >> i & 1)
            return rejected / (1 + sum(w[i] for _, _, w in counts))

        best = max(left, key=lambda i: (gain(i), -i))
        out.append(rules[best])
        left.remove(best)
        counts = [c for c in counts if not c[0] >> best & 1]
    return out


def order_rules(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS, text: str = "text") -> list[Rule]:
    """The rules in the order of best_order() on a sample of docs, which is measured for them."""
    return best_order(sample_counts(docs, rules, rows, text), rules) if len(rules) > 1 else list(rules)


def first_failed(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, else null; later rules are not evaluated."""
    out = None
    for r in rules:
        out = F.when(r.fails, F.lit(r.name)) if out is None else out.when(r.fails, F.lit(r.name))
    return out if out is not None else F.lit(None).cast("string")


def cascade(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, text: str = "text") -> DataFrame:
    """docs with the measures of measure(), ``failed_rule`` (null: none) and ``kept``.

    The base rule comes first, as its measures are there anyway; the others follow in sampled order.
    """
    measured = measure(docs, text)
    ordered = order_rules(docs, default_rules(text) if rules is None else rules, sample_rows, text)
    reason = F.when(base_failed(), F.lit("base")).otherwise(first_failed(ordered))
    return measured.withColumn("failed_rule", reason).withColumn("kept", F.col("failed_rule").isNull())


def cascade_counts(result: DataFrame, order: list[str]) -> DataFrame:
    """For each rule of ``order`` (first to last): place, rule, judged, rejected and skipped documents of a cascade."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("failed_rule"))
    by_rule = result.groupBy(F.coalesce(place, F.lit(0)).cast("int").alias("at")).agg(F.count("*").alias("n"))
    rules = F.transform(F.array(*map(F.lit, order)), lambda r, i: F.struct((i + 1).alias("place"), r.alias("rule")))
    sums = by_rule.agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("n"), F.sum("n").alias("all"))
    each = sums.select("n", "all", F.inline(rules))
    before = F.aggregate(F.map_values(F.map_filter("n", lambda k, v: (k > 0) & (k < F.col("place")))), F.lit(0).cast("long"), lambda a, x: a + x)
    rejected = F.coalesce(F.try_element_at("n", F.col("place")), F.lit(0).cast("long"))
    return each.select("place", "rule", (F.col("all") - before).alias("judged"), rejected.alias("rejected"), before.alias("skipped"))

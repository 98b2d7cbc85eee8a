"""Format-preserving pseudonyms for personal data, in native expressions only.

Found values are validated (octets, calendar dates, Luhn digits, area codes) and then replaced by a
keyed permutation of all values of the same format, so equal values get equal pseudonyms in every
document, different ones stay different, and the holder of the key can undo it (``reverse=True``).

The permutations are Feistel networks of ``ROUNDS`` rounds with SHA-256 as round function:

* numbers: two parts in Z_m x Z_n, each in turn shifted by a hash of the other (IPv4 addresses on
  65536 x 65536; phone numbers on the rectangle of area codes and numbers that they are in, see
  ``PHONES``; dates on 189 x 773, the 146,097 days from 1800-01-01 to 2199-12-31);
* strings: two halves, each character shifted within its own class (a-z, A-Z, 0-9) by a hash of
  the other half (cards without their first digit and with a new check digit, social security
  numbers, e-mail addresses without their top-level domain, access keys and hexadecimal tokens of
  one case, whose letters stay hexadecimal).

A date with slashes is day/month/year if it can be; month/day/year dates, whose day is then above
12, are permuted among themselves (9 x 9833 of them). So every format is a domain of its own that
its permutation does not leave, and all are undone exactly.

Separators and all other text stay as they are. Values that fail validation are left alone: octets
above 255, impossible or far dates, wrong check digits, e-mail local parts of over 64 characters or
domains of over 126 labels. All patterns are bounded, so long texts of any shape take linear time and
constant stack. Null text stays null. Rows are handled one by one; other columns pass through.

There is no default key: it is an argument, or ``spark.quillspark.pii.key`` of the session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.quality import let

ROUNDS = 8
#: Published with the source, so it protects nothing: for tests and the registered queries only.
DEMONSTRATION_KEY = "quillspark-demonstration-key"
KEY_SETTING = "spark.quillspark.pii.key"
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
#: Of the same 400 years: the days of a month after its twelfth.
LATE_DAYS = (9, 9833)
#: Rectangles that together are all ten-digit numbers: first area code and number, and how many of each.
#: The first is that of possible numbers, so possible ones stay possible.
PHONES = {"phone": (200, 2_000_000, 800, 8_000_000), "phone-low": (200, 0, 800, 2_000_000), "phone-area": (0, 0, 200, 10_000_000)}

#: Kinds in the order in which they are tried at a place of the text.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}",
    "phone": r"(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-]|\.\d)",
    "ip": r"(?:\d{1,3}\.){3}\d{1,3}(?![\w-]|\.\d)",
    "date": r"(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w-]|[./]\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"\d(?:[ -]?\d){12,18}(?![\w-])",
    "secret": r"(?:AKIA[A-Z0-9]{16}|(?=[a-f]{0,127}[0-9])[0-9a-f]{32,128}|(?=[A-F]{0,127}[0-9])[0-9A-F]{32,128})(?!\w)",
}
#: A value begins where no other word, number or address goes on.
BEFORE = r"(?<![\w.%+@-])(?=[A-Za-z0-9(+._%-])"
FINDER = BEFORE + "(?:" + "|".join(PATTERNS.values()) + ")"
#: Every value has one of these; texts without are not searched further.
HINT = r"[0-9@]|AKIA"


def _hash(key: str, *parts: Column) -> Column:
    """60 bits of SHA-256 as a non-negative long."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def _rounds(reverse: bool) -> Column:
    return F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if reverse else range(ROUNDS))])


def permute_pair(left: Column, right: Column, m: int, n: int, domain: str, key: str, reverse: bool = False) -> Column:
    """A keyed permutation of Z_m x Z_n as a struct (l, r)."""
    sign = -1 if reverse else 1

    def step(a: Column, i: Column) -> Column:
        l, r = a["l"], a["r"]
        new_l = F.when(i % 2 == 0, F.pmod(l + sign * (_hash(key, F.lit(domain), i, r) % m), F.lit(m).cast("long"))).otherwise(l)
        new_r = F.when(i % 2 == 1, F.pmod(r + sign * (_hash(key, F.lit(domain), i, l) % n), F.lit(n).cast("long"))).otherwise(r)
        return F.struct(new_l.alias("l"), new_r.alias("r"))

    return F.aggregate(_rounds(reverse), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def permute_text(text: Column, domain: str, key: str, reverse: bool = False, letters: int = 26) -> Column:
    """A keyed permutation of all strings with the same character classes at the same places.

    letters: of the alphabet that letters are shifted in (6: hexadecimal digits).
    """
    sign = -1 if reverse else 1

    def moved(part: Column, other: Column, i: Column) -> Column:
        def one(c: Column, place: Column) -> Column:
            code = F.ascii(c)
            by = lambda base, size: F.chr((F.pmod(code - base + sign * (_hash(key, F.lit(domain), i, place, other) % size), F.lit(size).cast("long")) + base).cast("long"))
            return F.when(c.between("0", "9"), by(48, 10)).when(c.between("a", "z"), by(97, letters)).when(c.between("A", "Z"), by(65, letters)).otherwise(c)

        chars = F.filter(F.split(part, ""), lambda c: c != "")
        return F.array_join(F.transform(chars, one), "")

    def step(a: Column, i: Column) -> Column:
        l, r = a["l"], a["r"]
        return F.struct(F.when(i % 2 == 0, moved(l, r, i)).otherwise(l).alias("l"), F.when(i % 2 == 1, moved(r, l, i)).otherwise(r).alias("r"))

    def whole(x: Column) -> Column:
        half = (F.length(x) / 2).cast("int")
        start = F.struct(F.substring(x, F.lit(1), half).alias("l"), F.substring(x, half + 1, F.length(x)).alias("r"))
        done = F.aggregate(_rounds(reverse), start, step)
        return let(done, lambda d: F.concat(d["l"], d["r"]))

    return let(text, whole)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _in_place(x: Column, digits: Column) -> Column:
    """x with its digits replaced, in order, by ``digits``."""
    places = F.sequence(F.lit(1), F.length(x))
    return F.array_join(F.transform(places, lambda i: F.when(F.substring(x, i, F.lit(1)).between("0", "9"), F.substring(digits, F.length(_digits(F.substring(x, F.lit(1), i))), F.lit(1))).otherwise(F.substring(x, i, F.lit(1)))), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, the last digit counting once."""
    n = F.length(digits)

    def add(a: Column, i: Column) -> Column:
        v = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 1, v).when(v >= 5, 2 * v - 9).otherwise(2 * v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(x: Column, key: str, reverse: bool) -> Column:
    def number(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), permute_text(F.substring(d, F.lit(2), F.length(d) - 2), "card", key, reverse))
        return let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))

    return let(_digits(x), lambda d: F.when(luhn_sum(d) % 10 == 0, _in_place(x, number(d))))


def _phone(x: Column, key: str, reverse: bool) -> Column:
    def number(d: Column) -> Column:
        tail = F.substring(d, F.length(d) - 9, F.lit(10))
        area, rest = F.substring(tail, 1, 3).cast("long"), F.substring(tail, 4, 7).cast("long")

        def within(domain: str, first: int, least: int, m: int, n: int) -> Column:
            pair = permute_pair(area - first, rest - least, m, n, domain, key, reverse)
            return let(pair, lambda p: F.concat(F.lpad((p["l"] + first).cast("string"), 3, "0"), F.lpad((p["r"] + least).cast("string"), 7, "0")))

        new = None
        for domain, (first, least, m, n) in PHONES.items():
            inside = (area >= first) & (rest >= least)
            new = (F if new is None else new).when(inside, within(domain, first, least, m, n))
        return F.concat(F.substring(d, F.lit(1), F.length(d) - 10), new)

    return let(_digits(x), lambda d: _in_place(x, number(d)))


def _ip(x: Column, key: str, reverse: bool) -> Column:
    def number(o: Column) -> Column:
        octet = lambda i: F.get(o, F.lit(i)).cast("long")
        valid = F.forall(o, lambda v: (v.cast("int") <= 255) & ((F.length(v) == 1) | ~v.startswith("0")))
        text = lambda p: F.concat_ws(".", F.shiftright(p["l"], 8), p["l"] % 256, F.shiftright(p["r"], 8), p["r"] % 256)
        return F.when(valid, let(permute_pair(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), 65536, 65536, "ipv4", key, reverse), text))

    return let(F.split(x, r"\."), number)


def _day_number(x: Column, form: str) -> Column:
    return F.datediff(F.try_to_timestamp(x, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date"))


def _day(number: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), number.cast("int"))


def _late_first(month: Column) -> Column:
    """The number, among the days after a twelfth, of the 13th of a month (counted from the first month)."""
    return F.datediff(F.add_months(F.lit(FIRST_DAY).cast("date"), month.cast("int")), F.lit(FIRST_DAY).cast("date")) - 12 * month


def _late_day(number: Column) -> Column:
    """The day-number of the number-th day after a twelfth; the inverse of day - 12 * (months + 1)."""
    guess = (number * 4800 / (LATE_DAYS[0] * LATE_DAYS[1])).cast("long")
    near = F.sequence(F.greatest(guess - 2, F.lit(0).cast("long")), F.least(guess + 2, F.lit(4799).cast("long")))
    month = F.array_max(F.filter(near, lambda m: _late_first(m) <= number))
    return let(month, lambda m: number + 12 * (m + 1))


def _date(x: Column, key: str, reverse: bool) -> Column:
    m, n = DAYS

    def moved(form: str) -> Column:
        new = lambda d: let(permute_pair((d / n).cast("long"), d % n, m, n, "date", key, reverse), lambda p: F.date_format(_day(p["l"] * n + p["r"]), form))
        return let(_day_number(x, form), lambda d: F.when((d >= 0) & (d < m * n), new(d)))

    def late(d: Column) -> Column:
        """d: the day-number of a date after the twelfth of its month."""
        i, j = LATE_DAYS
        months = (F.year(_day(d)) - F.lit(FIRST_DAY[:4]).cast("int")) * 12 + F.month(_day(d)) - 1
        pair = let(d - 12 * (months + 1), lambda r: permute_pair((r / j).cast("long"), r % j, i, j, "late-date", key, reverse))
        return let(pair, lambda p: F.date_format(_day(_late_day(p["l"] * j + p["r"])), "MM/dd/yyyy"))

    month_first = let(_day_number(x, "MM/dd/yyyy"), lambda d: F.when((d >= 0) & (d < m * n), late(d)))
    # what is a date either way is day/month/year, also if it lies outside the range
    slashes = F.when(F.try_to_timestamp(x, F.lit("dd/MM/yyyy")).isNotNull(), moved("dd/MM/yyyy")).otherwise(month_first)
    return F.when(F.substring(x, 5, 1) == "-", moved("yyyy-MM-dd")).when(F.substring(x, 3, 1) == "/", slashes).otherwise(moved("dd.MM.yyyy"))


def _email(x: Column, key: str, reverse: bool) -> Column:
    tail = F.length(F.substring_index(x, ".", -1)) + 1
    return F.concat(permute_text(F.substring(x, F.lit(1), F.length(x) - tail), "email", key, reverse), F.substring(x, F.length(x) - tail + 1, tail))


def _secret(x: Column, key: str, reverse: bool) -> Column:
    return F.when(x.startswith("AKIA"), F.concat(F.lit("AKIA"), permute_text(F.substring(x, 5, 16), "akia", key, reverse))).otherwise(permute_text(x, "hex", key, reverse, letters=6))


_MAKERS = {"email": _email, "phone": _phone, "ip": _ip, "date": _date, "ssn": lambda x, key, reverse: _in_place(x, permute_text(_digits(x), "ssn", key, reverse)), "card": _card, "secret": _secret}


def _named(kind: str, old: Column):
    return lambda t: F.struct(F.when(t.isNotNull(), F.lit(kind)).alias("kind"), F.coalesce(t, old).alias("text"))


def _pseudonym(x: Column, key: str, reverse: bool) -> Column:
    """(kind, text) of a found value; kind is null if it is left alone."""
    out = None
    for kind, pattern in PATTERNS.items():
        new = _MAKERS[kind](x, key, reverse)
        made = let(new, _named(kind, x))
        test = F.rlike(x, F.lit("^(?:" + pattern + ")$"))
        out = F.when(test, made) if out is None else out.when(test, made)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), x.alias("text")))


def pseudonymise(docs: DataFrame, key: str | None = None, text: str = "text", reverse: bool = False) -> DataFrame:
    """docs with pseudonyms in their texts and ``pii_kinds``, the kinds of the replaced values in order."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"no key: give one, or set {KEY_SETTING}")
    body = F.col(text)
    found = F.when(F.rlike(body, F.lit(HINT)), F.regexp_extract_all(body, F.lit(FINDER), F.lit(0)))
    out = docs.drop("pii_kinds").withColumn("__quill_found", found)
    new = F.when(F.size("__quill_found") > 0, F.transform("__quill_found", lambda x: _pseudonym(x, key, reverse)))
    out = out.withColumn("__quill_new", new)
    joined = F.array_join(F.zip_with(F.split(body, FINDER, -1), F.col("__quill_new"), lambda gap, v: F.concat(gap, F.coalesce(v["text"], F.lit("")))), "")
    kinds = F.filter(F.transform("__quill_new", lambda v: v["kind"]), lambda k: k.isNotNull())
    return out.withColumn("pii_kinds", F.coalesce(kinds, F.array().cast("array<string>"))).withColumn(text, F.when(F.col("__quill_new").isNotNull(), joined).otherwise(body)).drop("__quill_found", "__quill_new")


def report(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, the new text, n_pii and the number of values of each kind."""
    out = pseudonymise(docs.select("doc_id", "text"), key)
    count = lambda kind: F.size(F.filter("pii_kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_pii"), *[count(k) for k in PATTERNS])

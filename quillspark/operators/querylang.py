"""The search mini-language: a small syntax tree made on the driver.

``"quoted text"`` is a phrase; codes such as ``MN-114`` or ``12.345.6`` are phrases; ``word*`` is a
prefix; other words stand alone, unless they are stop words or single letters. Terms are joined by
OR or AND, and equal ones (without regard to case) count once. With a thesaurus, words and phrases
of a known concept become a group of equivalents.
"""

from __future__ import annotations

import re
import tomllib
import unicodedata
from dataclasses import dataclass, field

from quillspark.functions.fixed_values import STOP_WORDS

_QUOTED = re.compile(r'"([^"]+)"')
_TERM = re.compile(r"\w+(?:[-./_]\w+)*\*?")


@dataclass(frozen=True)
class Phrase:
    """Consecutive index words; with ``prefix`` the last one is the beginning of a word."""

    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Group:
    """Phrases of which any may occur; each scores by itself."""

    phrases: tuple[Phrase, ...]


@dataclass
class Query:
    terms: list[Group] = field(default_factory=list)
    mode: str = "OR"
    expanded: list[tuple[str, list[str]]] = field(default_factory=list)

    def phrases(self) -> list[Phrase]:
        return list(dict.fromkeys(p for g in self.terms for p in g.phrases))

    def text(self) -> str | None:
        """The query in the syntax of full-text indexes, for display; None if nothing is left."""
        show = lambda p: '"' + " ".join(p.words) + '"' + "*" * p.prefix
        parts = ["(" + " OR ".join(map(show, g.phrases)) + ")" if len(g.phrases) > 1 else show(g.phrases[0]) for g in self.terms]
        return f" {self.mode} ".join(parts) or None


def folded(text: str) -> str:
    return "".join(unicodedata.normalize("NFD", c)[0] if 0xC0 <= ord(c) < 0x250 or 0x1E00 <= ord(c) < 0x1F00 else c for c in text).lower()


def index_words(text: str) -> tuple[str, ...]:
    """The words of a text as the index has them; an underscore separates there."""
    return tuple(re.findall(r"[^\W_]+", folded(text)))


class Thesaurus:
    """Concepts and their terms; the first concept that has a term keeps it."""

    LONGEST = 4

    def __init__(self, rows: list[tuple[str, str]]):
        self.concept: dict[str, str] = {}
        self.terms: dict[str, list[str]] = {}
        for concept, term in rows:
            name = normal_term(term)
            if name and name not in self.concept:
                self.concept[name] = concept
                self.terms.setdefault(concept, []).append(term)

    @classmethod
    def from_toml(cls, text: str) -> Thesaurus:
        return cls([(c, t) for c, _, t, status in thesaurus_rows(text) if status != "no"])

    def expand(self, words: list[str]) -> list[tuple[str, list[str]]]:
        """The longest known runs of words, from left to right, with equivalents of over three letters."""
        out, i = [], 0
        while i < len(words):
            for n in range(min(self.LONGEST, len(words) - i), 0, -1):
                unit = " ".join(words[i : i + n])
                concept = self.concept.get(normal_term(unit))
                if concept is not None:
                    others = [t for t in self.terms[concept] if normal_term(t) != normal_term(unit) and len(t) > 3]
                    out.append((unit, others))
                    i += n
                    break
            else:
                i += 1
        return out


def normal_term(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return " ".join(re.findall(r"\w+", plain))


def thesaurus_rows(text: str) -> list[tuple[str, str, str, str | None]]:
    """(concept, language, term, status) of a TOML file with one table per concept; concepts need two terms."""
    rows = []
    for concept, entry in tomllib.loads(text).items():
        terms = [(lang, t) for lang, values in entry.items() if isinstance(values, list) for t in values]
        if len(terms) >= 2:
            rows += [(concept, lang, t, entry.get("status")) for lang, t in terms]
    return rows


def parse(text: str, mode: str = "OR", thesaurus: Thesaurus | None = None) -> Query:
    query = Query(mode=mode)
    found: list[Group] = [Group((Phrase(w),)) for w in map(index_words, _QUOTED.findall(text)) if w]
    terms = _TERM.findall(_QUOTED.sub(" ", text))
    known = thesaurus.expand([t for t in terms if not t.endswith("*")]) if thesaurus else []
    i = 0
    while i < len(terms):
        unit = next(((u, e) for u, e in known if e and " ".join(terms[i : i + len(u.split())]) == u), None)
        if unit is not None:
            known.remove(unit)
            query.expanded.append(unit)
            found.append(Group(tuple(dict.fromkeys(Phrase(w) for w in map(index_words, [unit[0], *unit[1]]) if w))))
            i += len(unit[0].split())
            continue
        term, i = terms[i], i + 1
        bare = term.rstrip("*")
        single = re.fullmatch(r"\w+", bare) is not None and "_" not in bare
        if single and (bare.lower() in STOP_WORDS or len(bare) < 2 and not bare.isdigit()):
            continue
        if words := index_words(bare):
            found.append(Group((Phrase(words, term.endswith("*")),)))
    query.terms = list(dict.fromkeys(found))
    return query


def parse_name_query(text: str) -> Query:
    """A query for file names: every term must occur, each as the beginning of a word."""
    plain = parse(text.replace("*", " "), "AND")
    plain.terms = [Group(tuple(Phrase(p.words, True) for p in g.phrases)) for g in plain.terms]
    return plain

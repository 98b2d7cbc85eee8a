"""Text functions, chunking and the query language."""

import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import chunking, text
from quillspark.operators import lexical
from quillspark.operators.querylang import Thesaurus, parse, parse_name_query


def value(spark, column, **given_):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given_.items()]).select(column.alias("x")).first()
    return row.x


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("a\x00b­c", "abc"),
        ("a \t  b", "a b"),
        ("a \r\n  b\r\n\r\n\r\n\r\nc", "a\nb\n\nc"),
        ("  \n x \n ", "x"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_text(spark, raw, clean):
    assert value(spark, text.clean_text(F.col("s")), s=raw) == clean


def test_folds_differ(spark):
    s = "Clôture_ÉTÉ-2 Straße"
    assert value(spark, text.fold(F.col("s")), s=s) == "cloture_ete-2 straße"
    assert value(spark, text.ascii_lower(F.col("s")), s=s) == "clôture_ÉtÉ-2 straße"
    assert value(spark, text.norm_name(F.col("s")), s=s) == "cloture ete 2 straße"
    assert value(spark, text.fold_ascii(F.col("s")), s=s) == "cloture ete 2 strae"
    assert value(spark, text.base_of(F.col("s")), s="P-12 old_bis") == "p12"


@given(st.text(alphabet="ab .,\n;?!é", max_size=9000))
@settings(max_examples=40, deadline=None)
def test_chunks_are_lossless_and_bounded(s):
    ends = chunking.cut_points(s)
    assert (ends[-1] if ends else 0) == len(s)
    assert all(0 < b - a <= 2000 for a, b in zip([0, *ends], ends))


def test_numbers_and_models(spark):
    assert value(spark, text.numbers_in(F.col("s")), s="120005849 0100710291 9120005849 12000584") == ["100710291", "120005849"]
    found = value(spark, text.models_in(F.col("s")), s="Paloma PM 4R, palomas D2-3 SQ; feed placer; Astor 0R megahector")
    assert [(m.family, m.model) for m in found] == [("Astor", ""), ("FeedPlacer", ""), ("Paloma", "Paloma 3R SQ"), ("Paloma", "Paloma 4R")]
    assert value(spark, text.family_of(F.col("s")), s="xyz 12") == "Xyz"


def test_dates(spark):
    assert str(value(spark, text.parse_date(F.col("s")), s="03.02.2024")) == "2024-02-03"
    with pytest.raises(Exception, match="not a date"):
        value(spark, text.parse_date(F.col("s")), s="soon")


def test_lines_of_recognised_text(spark):
    keep = lambda s: value(spark, text.keeps_line(F.col("s")), s=s)
    assert keep("Le moteur de l'axe X")
    assert not keep("|| -- 12 x")
    assert not keep("brr tss 44")
    assert not keep("")


def test_cards_lists_and_pictures(spark):
    assert value(spark, text.split_list(F.col("s")), s="a (x, y), b ,, c") == ["a (x, y)", "b", "c"]
    md = "# One\n\ntext here\n\n![first](a.png) and ![](b.png)\n"
    assert value(spark, text.number_pictures(F.col("s")), s=md) == "# One\n\ntext here\n\n[Image 1: first] and [Image 2]\n"
    context = value(spark, text.picture_context(F.col("s"), 1), s=md)
    assert (context.heading, context.paragraph) == ("One", "text here")
    assert value(spark, text.cut_words(F.col("s"), 8), s="some words here") == "some…"
    assert value(spark, text.link_candidates(F.col("s"), F.lit("/r/docs/a.md"), ["/r"]), s="x/y/p.png") == ["/r/docs/x/y/p.png", "/r/x/y/p.png", "/r/y/p.png"]


def test_query_language():
    assert parse("").text() is None
    assert parse("the of a").text() is None
    assert parse('le "plan de masse" MN-114 12.345.6 motor* motor').text() == '"plan de masse" OR "mn 114" OR "12 345 6" OR "motor"* OR "motor"'
    assert parse("x 7 été").text() == '"7"'
    assert parse_name_query("plan* mass").text() == '"plan"* AND "mass"*'
    known = Thesaurus([("c", "cahier des charges"), ("c", "specification"), ("c", "urs"), ("d", "offre"), ("d", "quotation")])
    q = parse("cahier des charges offre", thesaurus=known)
    assert q.text() == '("cahier des charges" OR "specification") OR ("offre" OR "quotation")'
    assert q.expanded == [("cahier des charges", ["specification"]), ("offre", ["quotation"])]


def test_bm25_equals_sqlite(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize = 'unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", [(r.doc_id, r.text) for r in docs.collect()])
    words = lexical.tokenised(docs, "doc_id", "text")
    for q in (parse("thing ered of"), parse('"of the" erth*', "AND"), parse("erth* license")):
        want = [(r[0], round(-r[1], 6)) for r in con.execute("SELECT rowid, rank FROM t WHERE t MATCH ? ORDER BY rank, rowid LIMIT 20", (q.text(),))]
        got = [(r.id, round(r.score, 6)) for r in lexical.search(words, q, 20).collect()]
        assert sorted(got) == sorted(want) or [s for _, s in got] == [s for _, s in want]


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "id long, words array<string>")
    assert lexical.search(empty, parse("word")).collect() == []

"""Facets, linkage, incremental tables, cards, sources, the API and streams on small fixtures."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.api import CorpusIndex
from quillspark.operators import cards, enrichment, facets, filters, incremental, reports, retrieval
from quillspark.plans import catalog, registry
from quillspark.sources import files
from quillspark.streaming import ingest

PATHS = [
    ("Acme/2_Mecanique/Plans/part.pdf", (None, "Acme", None, "Mecanique", "plan", "folder")),
    ("3_Archives/Acme/SAV/x.pdf", ("3_Archives", "Acme", None, "SAV", "sav", "folder")),
    ("Acme/Line 2/5_Electrique/x.pdf", (None, "Acme", "Line 2", "Electrique", "doc_electrique", "section")),
    ("Acme/FAT report.pdf", (None, "Acme", None, None, "fat", "name")),
    ("Acme/Offres/SAT protocol.pdf", (None, "Acme", None, "Vente", "sat", "name")),
    ("loose.pdf", (None, "root", None, None, None, None)),
    ("Acme/Clôture/x.pdf", (None, "Acme", None, "Cloture", "cloture", "section")),
    ("Soft/readme manual.txt", (None, "root", None, "Soft", "manuel", "name")),
]


def test_project_facets(spark):
    rows = spark.createDataFrame([(p,) for p, _ in PATHS], "path string")
    got = {r.path: (r.collection, r.project, r.subproject, r.section, r.doc_type, r.facet_source) for r in facets.project_facets(rows, root_name="root").collect()}
    assert got == dict(PATHS)


def test_other_profiles(spark):
    rows = spark.createDataFrame([("Flyers/a.pdf",), ("b.pdf",), ("Man/x_FR_DE.md",), ("Man/x_fr.md",)], "path string")
    got = {r.path: (r.category, r.language) for r in facets.documentation_facets(rows).collect()}
    assert got == {"Flyers/a.pdf": ("Flyers", None), "b.pdf": (None, None), "Man/x_FR_DE.md": ("Man", "de"), "Man/x_fr.md": ("Man", None)}


def test_folders_are_not_string_prefixes(spark):
    rows = spark.createDataFrame([("/a/b/x",), ("/a/bc/x",), ("/a/b",)], "path_key string")
    assert sorted(r.path_key for r in rows.where(filters.in_folder("path_key", "/A/b/")).collect()) == ["/a/b", "/a/b/x"]


def test_fusion_prefers_earlier_lists(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 1.0)], "id long, score double")
    b = spark.createDataFrame([(3, 9.0), (2, 8.0)], "id long, score double")
    fused = retrieval.fuse([retrieval.ranked(a, "keyword", 0), retrieval.ranked(b, "semantic", 2)])
    got = [r.id for r in fused.orderBy(F.col("score").desc(), "first_list", "first_rank").collect()]
    assert got == [2, 1, 3]


def test_hash_embedding_is_unit(spark):
    v = retrieval.query_vector(spark, "Été ete word", 32)
    assert abs(sum(x * x for x in v) - 1) < 1e-9
    assert max(v) > 0.8
    assert set(retrieval.query_vector(spark, "", 8)) == {0.0}


def test_versions_keep_one_back(spark, tmp_path):
    table = incremental.Versions(spark, f"file://{tmp_path}/t")
    assert table.current() is None
    for n in (1, 2, 3):
        table.write(spark.range(n))
    assert table.current() == 3
    assert table.read().count() == 3
    assert sorted(p.name for p in (tmp_path / "t" / "data").iterdir() if p.name.startswith("v=")) == ["v=2", "v=3"]


def test_pages_by_breaks_and_by_size(spark):
    blocks = [(1, 0, "a" * 20, False, False), (1, 1, "b" * 20, False, False), (1, 2, "H", True, False), (2, 0, "x", False, False), (2, 1, "y", False, True)]
    df = spark.createDataFrame(blocks, "doc_id long, i int, text string, is_heading boolean, is_break boolean")
    got = sorted((r.doc_id, r.page_no, r.text) for r in reports.paginate_blocks(df, 35).collect())
    assert got == [(1, 1, "a" * 20), (1, 2, "b" * 20 + ""), (1, 3, "H"), (2, 1, "x"), (2, 2, "y")] or got == [(1, 1, "a" * 20), (1, 2, "b" * 20 + "\nH"), (2, 1, "x"), (2, 2, "y")]
    assert files.paginate([(t, h, b) for d, _, t, h, b in blocks if d == 1], 35) == [t for d, _, t in got if d == 1]


def test_tree_budget(spark):
    rows = spark.createDataFrame([(["A", str(i % 3)],) for i in range(30)] + [(["B"],)], "parts array<string>")
    tree = reports.folder_tree(reports.folder_counts(rows, F.col("parts")))
    assert reports.tree_lines(tree, "all", 31) == ["all (31 documents)", "  A (30)", "    0 (10)", "    1 (10)", "    2 (10)", "  + 1 smaller folder (1 document)"]
    assert reports.tree_lines(tree, "all", 31, 30)[-1] == "... 4 more lines"


def test_engines_fail_by_row(spark):
    pages = spark.createDataFrame([(1, 1, b"good"), (2, 1, b"bad"), (3, 1, b"none")], "doc_id long, page_no int, image binary")

    def engine(image):
        if image == b"bad":
            raise RuntimeError("broken")
        return "Une ligne de texte lisible ici\n|| -- 1" if image == b"good" else ""

    got = {r.doc_id: (r.status, r.text) for r in enrichment.recognised(pages, engine).collect()}
    assert got == {1: ("text", "Une ligne de texte lisible ici"), 2: ("error", ""), 3: ("empty", "")}


def test_one_call_per_picture(spark):
    rows = spark.createDataFrame([(1, "s1", b"x"), (2, "s1", b"x"), (3, "s2", b"y")], "doc_id long, sha1 string, image binary")
    cache = spark.createDataFrame([("s2", "m", 1, "known")], "sha1 string, model string, version int, answer string")
    out, new = enrichment.described(rows, cache, lambda image: f"saw {image!r}", "m", 1)
    assert {(r.doc_id, r.answer) for r in out.collect()} == {(1, "saw b'x'"), (2, "saw b'x'"), (3, "known")}
    assert [r.sha1 for r in new.collect()] == ["s1"]


def test_card_lookup_and_vocabulary(spark):
    card = "---\ntype: t\nproject: {0}\nstatus: reviewed\nwritten: 2024-01-01\nread: 3\ninfeed: [cases, wrap case (a, b)]\n---\nbody\n"
    df = spark.createDataFrame([(f"{n}.md", card.format(n)) for n in ("Alpha", "Alpha__Beta", "Gamma__Delta", "Other__Delta")] + [("bad.md", "no header")], "file string, text string")
    parsed = cards.parse_cards(df)
    find = lambda n: [r.file for r in cards.card_for(parsed, n).collect()]
    assert (find("alpha"), find("Beta"), find("Delta"), find("none")) == (["Alpha.md"], ["Alpha__Beta.md"], [], [])
    words = spark.createDataFrame([("forms", "case", "cases"), ("forms", "case", "box"), ("forms", "tray", None)], "kind string, value string, synonym string")
    asked = spark.createDataFrame([("forms", "Boxes"), ("forms", "trays"), ("forms", "bag")], "kind string, word string")
    assert {r.word: r.value for r in cards.canonical(asked, cards.vocabulary(words)).collect()} == {"Boxes": "case", "trays": "tray", "bag": None}


def _docx() -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_index_life_cycle(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "Acme" / "SAV").mkdir(parents=True)
    (root / "Acme" / "SAV" / "note.txt").write_text("The pump of machine seven leaks.\n" * 3)
    (root / "Acme" / "plan.md").write_text("# Pump plan\n\nA drawing ![x](a.png) of the pump\n")
    (root / "Acme" / "doc.docx").write_bytes(_docx())
    (root / "Acme" / "bad.docx").write_bytes(b"no zip")
    (root / "Acme" / "blank.txt").write_bytes(b" \n")
    index = CorpusIndex(spark, f"file://{tmp_path}/index", f"file://{root}", "projects")
    assert index.index() == {"new": 5}
    assert index.index() == {"unchanged": 5}
    status = {r.path.rsplit("/", 1)[1]: r.status for r in index.docs().collect()}
    assert status == {"note.txt": "ok", "plan.md": "ok", "doc.docx": "ok", "bad.docx": "error", "blank.txt": "no_text"}
    assert index.embed() == index.chunks().count()
    hits = index.search("pump leaks", mode="hybrid").collect()
    assert "leaks" in hits[0].snippet
    assert index.search("pump", mode="keyword", section="sav").count() == 1
    assert [r.path.rsplit("/", 1)[1] for r in index.find_files("pla").collect()] == ["plan.md"]
    key = index.docs().where(F.endswith("path_key", F.lit("note.txt"))).first().path_key
    assert index.read_document(key).first().text.startswith("The pump")
    assert index.find_in_document(key, "LEAKS").count() == 3
    assert [r.text for r in index.pages().join(index.docs().where("ext = '.docx' and status = 'ok'"), "doc_id").collect()] == ["# Title\na | b"]
    (root / "Acme" / "plan.md").unlink()
    (root / "Acme" / "blank.txt").write_text("now with text, more than before")
    assert index.index() == {"gone": 1, "unchanged": 3, "updated": 1}
    assert index.docs().count() == 4
    assert index.list_projects().first().project.lower() == "acme"
    assert index.world_map()[0] == "corpus (4 documents)"


def test_upserts_from_a_stream(spark, tmp_path):
    data, table = tmp_path / "in", incremental.Versions(spark, f"file://{tmp_path}/out")
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k long, v string, t long").coalesce(1).write.parquet(str(data / "one"))
    schema = "k long, v string, t long"
    run = lambda: ingest.run_for(ingest.upsert_stream(ingest.file_stream(spark, str(data / "*"), schema), table, ["k"], str(tmp_path / "check"), order="t"), 1)
    assert run()
    assert {(r.k, r.v) for r in table.read().collect()} == {(1, "b"), (2, "c")}
    spark.createDataFrame([(2, "d", 5), (3, "e", 1)], schema).coalesce(1).write.parquet(str(data / "two"))
    assert run()
    assert {(r.k, r.v) for r in table.read().collect()} == {(1, "b"), (2, "d"), (3, "e")}


def test_registry_refuses_doubles():
    assert "bm25_topk" in catalog.queries()
    with pytest.raises(ValueError, match="twice"):
        registry.query("bm25_topk")(lambda s, d: None)


def test_hash_search_finds_long_texts(spark, tmp_path):
    from quillspark.plans.more_queries import hash_search_whole

    rows = [(1, "license version 2 0 " * 200), (2, "other words " * 100), (3, None), (4, "license")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: r.score for r in hash_search_whole(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert (got[1], got[3]) == (1.0, 0.0)


def test_dense_search_takes_every_query_in_blocks(spark):
    from quillspark.operators import retrieval

    rows = [(i, [float(i % 7), float(i % 11), 1.0]) for i in range(0, 700, 50)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id % 100 = 0")
    got = {(r.query, r.id) for r in retrieval.dense_search_blocks(vectors, asked, 3, block=2).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {(q, k) for q, v in rows if q % 100 == 0 for k, _ in sorted(rows, key=lambda r: (-dot(r[1], v), r[0]))[:3]}
    assert got == want
    assert retrieval.dense_search_blocks(vectors, asked.limit(0), 3).collect() == []


def test_short_texts_have_pages_too(spark, tmp_path):
    from quillspark.plans.more_queries import paginated_texts

    rows = [(1, "one line"), (2, "a\nb"), (3, "\n".join(["x" * 1400] * 3)), (4, "a\nb\nc\nd"), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.page_no) for r in paginated_texts(spark, str(tmp_path)).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (3, 2), (4, 1), (4, 2)]

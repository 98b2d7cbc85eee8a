"""Stored tables, the incremental index, its run loops, and its operations over HTTP."""

import io
import json
import threading
import urllib.error
import urllib.request
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark import server
from quillspark.api import CorpusIndex
from quillspark.operators import enrichment, incremental, lexical, retrieval
from quillspark.operators.querylang import parse
from quillspark.sources import files


def test_a_lost_writer_leaves_the_state_before(spark, tmp_path):
    table = incremental.Versions(spark, f"file://{tmp_path}/t")
    table.write(spark.range(1))
    # all that a writer does before its last step
    spark.range(9).write.parquet(f"{tmp_path}/t/data/v=2")
    (tmp_path / "t" / "_state" / "_draft-2").write_text("{")
    assert (table.current(), table.read().count()) == (1, 1)
    table.write(spark.range(3))
    assert (table.current(), table.read().count()) == (2, 3)
    with pytest.raises(ValueError, match="another writer"):
        table.states.put(2, {})


def test_segments_change_together(spark, tmp_path):
    docs = incremental.Segments(spark, f"file://{tmp_path}/s", {"words": ["w"]})
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id long, w string")
    gone = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    have = lambda name: sorted((r.doc_id, r.w) for r in docs.read(name).collect())
    assert not docs.has("docs")
    docs.change({"docs": rows((1, "a"), (2, "b")), "words": rows((1, "x"), (1, "y"), (2, "x"))})
    docs.change({"docs": rows((2, "c"))}, gone(2), {"n": 1})
    assert have("docs") == [(1, "a"), (2, "c")]
    assert have("words") == [(1, "x"), (1, "y")]
    docs.change({}, gone(1))
    assert (have("docs"), have("words")) == ([(2, "c")], [])
    for i in range(incremental.MAX_SEGMENTS + 3):
        docs.change({"docs": rows((10 + i, str(i)))}, gone(10 + i - 1))
    assert have("docs") == [(2, "c"), (10 + i, str(i))]
    assert len(docs.state()["tables"]["docs"]) <= incremental.MAX_SEGMENTS
    assert docs.state()["notes"] == {"n": 1}
    docs.replace("docs", rows((7, "z")))
    docs.note(n=2, m="x")
    assert (have("docs"), docs.state()["notes"]) == ([(7, "z")], {"n": 2, "m": "x"})


def test_buckets_write_what_they_touch(spark, tmp_path):
    table = incremental.Buckets(spark, f"file://{tmp_path}/b", ["k"], 16)
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v string")
    table.upsert(rows(*((i, "old") for i in range(50))))
    table.upsert(rows((3, "new"), (99, "more")))
    assert {(r.k, r.v) for r in table.read().collect()} == {(i, "new" if i == 3 else "old") for i in range(50)} | {(99, "more")}
    assert len(list((tmp_path / "b" / "data" / "2").glob("_bucket=*"))) <= 2


def test_the_stored_index_finds_what_a_scan_finds(spark):
    texts = ["apache license version two", "the license of a license", "apache tomcat licensed", "nothing here", "", "version license apache"]
    rows = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "id long, words array<string>")
    index, figures = lexical.postings(rows), lexical.corpus_figures(rows)
    for asked in ("apache license", '"apache license"', "lic*", '"license version" tomcat', "absent"):
        for mode in ("OR", "AND"):
            plain = [(r.id, round(r.score, 9)) for r in lexical.search(rows, parse(asked, mode)).collect()]
            assert [(r.id, round(r.score, 9)) for r in lexical.search_postings(index, figures, parse(asked, mode)).collect()] == plain


def _pptx() -> bytes:
    a, r = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/slides/slide2.xml", f'<x xmlns:a="{a}" xmlns:r="{r}"><a:blip r:embed="r2"/><a:blip r:embed="r1"/></x>')
        z.writestr("ppt/slides/_rels/slide2.xml.rels", '<x><y Id="r1" Target="../media/one.png"/><y Id="r2" Target="/ppt/media/two.png"/></x>')
        z.writestr("ppt/slides/slide1.xml", f'<x xmlns:a="{a}"/>')
        z.writestr("ppt/media/one.png", b"1")
        z.writestr("ppt/media/two.png", b"2")
    return out.getvalue()


def test_pictures_of_files():
    assert files.pictures_in("a/b.PNG", b"x") == [(1, 1, b"x")]
    assert files.pictures_in("s.pptx", _pptx()) == [(2, 1, b"2"), (2, 2, b"1")]
    assert files.pictures_in("s.pptx", b"broken") == []
    assert files.pictures_in("s.txt", b"x") == []


def test_legacy_files_by_a_converter(tmp_path):
    assert files.extract_bytes("a.doc", b"x")[0] in ("skipped", "error")
    tool = tmp_path / "convert"
    # what the converter's last arguments say is where its result goes
    tool.write_text('#!/bin/sh\nfor last; do :; done\ncp "$last" "$(dirname "$last")/in.pptx"\n')
    tool.chmod(0o755)
    status, _, pages, error = files.converted_pages(_pptx(), ".ppt", str(tool))
    assert (len(pages), error) == (2, None)
    tool.write_text("#!/bin/sh\nexit 3\n")
    assert files.converted_pages(b"x", ".doc", str(tool))[0] == "error"
    tool.write_text("#!/bin/sh\nexec sleep 30\n")
    assert "took over" in files.converted_pages(b"x", ".doc", str(tool), 0.2)[3]
    assert files.converted_pages(b"x", ".doc", str(tmp_path / "none"))[0] == "skipped"


@pytest.fixture()
def tree(spark, tmp_path):
    root = tmp_path / "tree [1]"
    for project in ("Acme", "Beta"):
        (root / project / "SAV").mkdir(parents=True)
        for i in range(4):
            (root / project / "SAV" / f"note {i}.txt").write_text(f"The pump of {project} number {i} leaks oil.\n" * 3)
    return root, CorpusIndex(spark, f"file://{tmp_path}/index", f"file://{root}", "projects")


def test_only_changed_files_are_read(spark, tree, monkeypatch):
    root, index = tree
    assert index.index() == {"new": 8}
    before = {r.chunk_id for r in index.chunks().collect()}
    assert index.embed() == 8
    asked = []
    plain = files.extract
    monkeypatch.setattr(files, "extract", lambda spark, root, *a: asked.append(root) or plain(spark, root, *a))
    (root / "Acme" / "SAV" / "note 1.txt").write_text("The valve is new and tight.")
    (root / "Acme" / "SAV" / "more.txt").write_text("A valve catalogue.")
    (root / "Beta" / "SAV" / "note 2.txt").unlink()
    assert index.index() == {"unchanged": 6, "updated": 1, "new": 1, "gone": 1}
    assert sorted(p.rsplit("/", 1)[1] for p in asked[0]) == ["more.txt", "note 1.txt"]
    assert len({r.chunk_id for r in index.chunks().collect()} & before) == 7  # a chunk's id is that of its place
    # vectors of changed documents went with them, and only these are made again
    assert index.tables.read("vectors").count() == 6
    assert index.embed() == 2
    assert index.embed() == 0
    with pytest.raises(ValueError, match="reset"):
        CorpusIndex(spark, index.path, dim=64).embed()
    # the figures of the stored index follow
    words = lexical.tokenised(index.chunks(), "chunk_id", "chunk")
    notes = index.tables.state()["notes"]
    assert (notes["chunks"], notes["words"]) == tuple(words.agg(F.count("*"), F.sum(F.size("words"))).first())
    hits = index.search("valve").collect()
    assert len(hits) == 8
    assert all("alve" in h.snippet for h in hits[:2])
    scan = retrieval.hybrid_search(index.chunks(), parse("valve"), mode="keyword").collect()
    stored = index.search("valve", mode="keyword").collect()
    assert [(r.id, round(r.score, 9)) for r in stored] == [(r.id, round(r.score, 9)) for r in scan]
    assert index.search("valve", mode="keyword", project="beta").collect() == []
    assert index.search("pump", project="beta", folder=str(root / "Beta")).count() == 3
    assert {r.state for r in index.live_folder(str(root)).collect()} == {"indexed"}


def test_live_reading(tree):
    root, index = tree
    index.index()
    path = root / "Acme" / "SAV" / "note 0.txt"
    key = str(path).lower()
    assert [r.live for r in index.read_fresh(key).collect()] == [False]
    path.write_text("Now it says something else.")
    assert [(r.text, r.live) for r in index.read_fresh(key).collect()] == [("Now it says something else.", True)]
    assert {(r.path_key, r.state) for r in index.live_folder(str(root / "Acme")).where("state <> 'indexed'").collect()} == {(key, "changed")}
    path.unlink()
    assert [r.live for r in index.read_fresh(key).collect()] == [False]
    with pytest.raises(ValueError, match="not indexed"):
        index.read_fresh("/none")


def test_recognition_goes_on_and_is_redone(spark, tree):
    root, index = tree
    index.index()
    docs = index.docs().orderBy("path_key").select("doc_id").collect()
    # scans: their pages have no text, and the ledger is by page
    scan = spark.createDataFrame([(r.doc_id, 1, f"page {i}".encode()) for i, r in enumerate(docs[:3])], "doc_id long, page_no int, image binary")
    plain = index.docs
    index.docs = lambda: plain().withColumns({"ext": F.lit(".pdf"), "status": F.lit("no_text")})
    index.pages = lambda: spark.createDataFrame([], "doc_id long, page_no int, text string")

    def engine(image):
        if image == b"page 1":
            raise RuntimeError("no")
        return "Le moteur tourne encore sans bruit"

    assert index.recognise(scan, engine, batch=2) == {"text": 2, "error": 1}
    assert index.recognise(scan, engine, batch=2) == {}
    assert index.recognise(scan, lambda image: "Une autre page lisible encore", retry=("error",)) == {"text": 1}
    del index.docs, index.pages
    assert [r.doc_id for r in index.search("moteur", mode="keyword").collect()] == sorted((docs[0].doc_id, docs[2].doc_id), key=lambda x: [r.doc_id for r in index.search("moteur", mode="keyword").collect()].index(x))
    # extracting a document again takes its ledger rows and its recognised text away
    name = index.docs().where(F.col("doc_id") == docs[0].doc_id).first().path.removeprefix("file:").replace("%20", " ")
    with open(name, "w") as f:
        f.write("Another text altogether.")
    index.index()
    assert {r.doc_id for r in index.tables.read("ocr").collect()} == {docs[1].doc_id, docs[2].doc_id}
    assert [r.doc_id for r in index.search("moteur", mode="keyword").collect()] == [docs[2].doc_id]


def test_runs_stop_when_the_engine_is_down(spark):
    work = spark.range(10).orderBy("id")
    kept = []
    call = lambda some: some.withColumn("status", F.when(F.col("id") < 2, "ok").otherwise("error"))
    run = lambda **more: enrichment.run_in_batches(work, call, lambda done: kept.append(done.count()), 2, **more)
    assert run(most_failures=4) == {"ok": 2, "error": 2} or run(most_failures=4)["ok"] == 2
    kept.clear()
    assert run(minutes=0) == {}
    assert kept == []
    assert run(most_failures=100)["ok"] == 2


def test_pictures_are_asked_about_once(spark, tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    (root / "a.png").write_bytes(b"same")
    (root / "b.png").write_bytes(b"same")
    (root / "c.png").write_bytes(b"bad")
    (root / "d.pptx").write_bytes(_pptx())
    index = CorpusIndex(spark, f"file://{tmp_path}/index", f"file://{root}")
    index.index()

    def engine(image):
        if image == b"bad":
            raise RuntimeError("no")
        return "saw " + image.decode()

    assert index.describe(index.pictures(), engine, "m") == {"described": 3, "error": 1}
    assert sorted(r.answer for r in index.tables.read("pictures").collect()) == ["saw 1", "saw 2", "saw same"]
    assert index.describe(index.pictures(), lambda image: "now " + image.decode(), "m") == {"described": 1}


def test_cards_and_register(spark, tree, tmp_path):
    root, index = tree
    index.index()
    (tmp_path / "r.csv").write_text("﻿project,client,country,year,group\nAcme,Client A,CH,2001,G\nbeta,Client B,FR,1999,G\nNone,Client A,DE,2005,\n")
    folder = tmp_path / "cards"
    folder.mkdir()
    (folder / "Acme.md").write_text("---\ntype: card\nproject: Acme\nstatus: reviewed\nwritten: 2024-05-01\nread: 1\n---\n## A. Facts\n- a pump [x]\n")
    (folder / "bad.md").write_text("no header")
    linked = {r["name"]: (r["project"], r["matched_by"]) for r in index.register(str(tmp_path / "r.csv")).collect()}
    assert linked == {"Acme": ("Acme", "name"), "beta": ("Beta", "name"), "None": (None, None)}
    assert index.register_summary(str(tmp_path / "r.csv")).first().leading == "Client A (2), Client B (1)"
    card = [(r.part, r.line) for r in index.project_cards(str(tmp_path / "r.csv"), str(folder), "ACME").orderBy("part").collect()]
    assert dict(card)["card"].endswith("- a pump [x]")
    # the year is that of the documents, from which the register is too far away
    assert dict(card)["register"].startswith("Acme · Client A · CH · 20")
    assert dict(card)["others"] == "Beta"
    assert dict(card)["header"].startswith("4 documents")
    assert index.catalog_coverage(str(folder)).first().asDict() == {"cards": 2, "unreadable": 1, "projects": 2, "with_card": 1}
    assert index.catalog(str(folder), text="PUMP").count() == 1
    assert set(index.overview()) == {"status", "collection", "section", "doc_type"}
    assert index.world_map("x", str(tmp_path / "none"))[0].startswith("(no map text")


def test_operations_over_http(tree):
    _, index = tree
    index.index()
    http = server.make_server(index)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_address[1]}"

    def ask(path, body=None, **headers):
        request = urllib.request.Request(base + path, None if body is None else json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=120) as a:
                return a.status, json.load(a)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    mine = {server.HEADER: "1"}
    try:
        assert ask("/api/state")[1]["notes"]["chunks"] == 8
        assert set(ask("/api/tools")[1]) == set(server.TOOLS)
        code, got = ask("/api/tools/search", {"words": "pump beta", "limit": 3, "mode": "keyword"}, **mine)
        assert (code, len(got["rows"])) == (200, 3)
        assert ask("/api/tools/world_map", {}, **mine)[1]["lines"][0] == "corpus (8 documents)"
        assert ask("/api/tools/search", {"words": "x"})[0] == 403
        assert ask("/api/state", Host="elsewhere.example")[0] == 403
        assert ask("/api/tools/embed", {}, **mine)[0] == 400
        assert ask("/api/tools/search", {"nothing": 1}, **mine)[0] == 400
        assert ask("/api/none")[0] == 404
    finally:
        http.shutdown()
        http.server_close()

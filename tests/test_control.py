"""Sources, freshness, links and the model client."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quillspark.operators import control, enrichment
from quillspark.sources.models import ModelClient, comparison_page, lazy


def test_sources_keep_their_invariants():
    s = control.Sources()
    s.add("C:\\Docs\\", 1)
    with pytest.raises(ValueError, match="inside"):
        s.add("c:/docs/sub", 2)
    with pytest.raises(ValueError, match="contains"):
        s.add("c:/", 2)
    s.exclude("C:/docs/a/b", 3)
    s.exclude("C:/docs/a", 4)
    assert s.excluded == ["c:/docs/a"]
    with pytest.raises(ValueError):
        s.exclude("c:/docs", 5)
    assert s.allows("c:/Docs/x.txt")
    assert not s.allows("c:/docs/a/x.txt")
    assert not s.allows("c:/docs2/x.txt")
    s.add("c:/docs/a", 6)
    assert s.excluded == []
    s.set_patterns([" *.tmp ", ""], 7)
    assert control.Sources.loads(s.dumps()) == s
    assert (s.needs_rescan(6.5), s.needs_rescan(7.5), s.needs_rescan(None)) == (True, False, True)
    s.exclude("c:/docs/z", 8)
    s.remove("c:/docs", 9)
    assert (s.roots, s.excluded) == ([], [])
    control.check_model(None, "a")
    control.check_model("a", "b", reset=True)
    with pytest.raises(ValueError):
        control.check_model("a", "b")


def test_counts_keys_and_links(spark):
    docs = spark.createDataFrame([("/a/x",), ("/a/y",), ("/ab/z",)], "path_key string")
    assert {(r.root, r.docs) for r in control.root_counts(docs, ["/a", "/none"]).collect()} == {("/a", 2), ("/none", 0)}
    names = spark.createDataFrame([("image10.png",), ("image2.png",), ("Image1.png",)], "n string")
    assert [r.n for r in names.orderBy(control.natural_key(F.col("n"))).collect()] == ["Image1.png", "image2.png", "image10.png"]
    links = spark.createDataFrame([(1, ["/no", "/AB/z", "/a/x"]), (2, ["/none"])], "link_id int, candidates array<string>")
    assert [(r.link_id, r.path_key) for r in control.resolve_links(links, docs).collect()] == [(1, "/ab/z")]
    f = spark.createDataFrame([(5, 1.0, 5, 1.005), (5, 1.0, 6, 1.0), (None, None, 6, 1.0)], "a int, b double, c int, d double")
    assert [r.x for r in f.select(control.is_fresh(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x")).collect()] == [True, False, True]


class Server(BaseHTTPRequestHandler):
    def _send(self, code, body):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_GET(self):
        self._send(200, {"models": [{"name": "m"}]})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if "think" in body:
            self._send(400, {"error": "unknown field"})
        else:
            self._send(200, {"message": {"content": json.dumps({"description": body["messages"][0]["images"][0]})}})

    def log_message(self, *args):
        pass


def test_model_client(spark):
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert ModelClient(url, "m", "p").available()
    assert not ModelClient(url, "other", "p").available()
    assert json.loads(ModelClient(url, "m", "p").describe(b"abc")) == {"description": "YWJj"}
    rows = spark.createDataFrame([(1, "s", b"abc")], "doc_id long, sha1 string, image binary")
    cache = spark.createDataFrame([], "sha1 string, model string, version int, answer string")
    out, _ = enrichment.described(rows, cache, lazy(lambda: ModelClient(url, "m", "p").describe), "m", 1)
    assert json.loads(out.first().answer) == {"description": "YWJj"}
    server.shutdown()
    assert not ModelClient("http://127.0.0.1:9", "m", "p", 0.5).available()
    calls = spark.createDataFrame([("m", 1.0, None), ("m", 3.0, "x")], "model string, seconds double, error string")
    page = comparison_page(enrichment.compare_models(calls), spark.createDataFrame([("m", "s", "<b>")], "model string, sha1 string, answer string"))
    assert "<td>2.00</td>" in page
    assert "&lt;b&gt;" in page

"""Command line, HTTP service, page source, index files and model calls."""

from __future__ import annotations

import http.server
import json
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from lexmill import __main__ as cli
from lexmill import service
from lexmill.operators import bloom, completion, crawl, signposts, toc
from lexmill.plans import retrieve, streams
from lexmill.sources import files, pages

PAGES = {
    "/": "<html><body><h1>Start</h1><p>" + "This page says where things are kept. " * 5 + "</p><a href='/keys;v=1'>keys</a> <a href=\"/slow\">s</a> <a href='mailto:x'>m</a> <a href='http://elsewhere.example/'>e</a></body></html>",
    "/keys": "<html><body><h1>Keys</h1><p>" + "Tokens are renewed by the zebra command every night. " * 5 + "</p></body></html>",
}


@pytest.fixture(scope="module")
def site():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            body = PAGES.get(self.path, "").encode()
            self.send_response(200 if body else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            status = 400 if asked["model"] == "wrong" else 200
            Handler.calls.append(asked)
            self.send_response(status)
            self.end_headers()
            if status == 200 and asked.get("stream"):
                for t in ("<thi", "nk>no</think>", "y", "es"):
                    self.wfile.write(f"data: {json.dumps({'choices': [{'delta': {'content': t}}]})}\n\n".encode())
                self.wfile.write(b"data: [DONE]\n\n")
            elif status == 200:
                self.wfile.write(json.dumps({"choices": [{"message": {"content": "ok"}}]}).encode())

        def log_message(self, *args):
            pass

    Handler.calls = []
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", Handler.calls
    server.shutdown()


@pytest.fixture(scope="module")
def index(spark):
    body = [("auth1", "OAuth2 tokens authenticate requests. Use a bearer token.", "Authentication"), ("rate1", "Requests are limited per minute.", "Rate limits"), ("error1", "Errors have codes.", "Errors")]
    chunks = spark.createDataFrame([(k, 0, i, c, h, 1, c, c, None, [], None) for k, (i, c, h) in enumerate(body)], "doc_id long, pos int, chunk_id string, content string, header string, header_level int, first_sentence string, last_sentence string, parent_id string, children_ids array<string>, source_url string")
    return toc.build(chunks, signposts.generate(chunks), "api")


def test_command_line(spark, site, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("DATA_DIR", str(tmp_path))
    monkeypatch.setenv("CRAWL_DELAY_MS", "0")
    (tmp_path / "none").mkdir()
    assert cli.run(["query", "what?", "--index", str(tmp_path / "none")], spark) == 1
    assert cli.run(["pipeline", site[0] + "/", "--name", "first", "--depth", "1"], spark) == 0
    assert cli.run(["query", "Which command renews tokens?", "--index", str(tmp_path / "index" / "first")], spark) == 0
    assert "zebra" in capsys.readouterr().out
    assert cli.run(["crawl", site[0] + "/", "--depth", "1", "--pages", "2", "--output", str(tmp_path / "two")], spark) == 0
    assert "2 pages" in capsys.readouterr().out
    assert cli.run(["convert", str(tmp_path / "two"), "--output", str(tmp_path / "md")], spark) == 0
    assert cli.run(["index", "second", "--input", str(tmp_path / "md"), "--output", str(tmp_path / "made")], spark) == 0
    assert files.read_toc(spark, str(tmp_path / "made")).filter("source_name = 'second'").count() == 2
    assert cli.run(["crawl", site[0], "--js"], spark) == 2


def test_links_and_limits_of_pages(spark, site):
    pages.register(spark)
    root = site[0]
    r = spark.read.format("pages").option("urls", f"{root}/").load()
    assert r.select("links").first()[0] == [f"{root}/keys", f"{root}/slow", "http://elsewhere.example"]
    assert r.select(F.explode("links")).collect() == r.select(F.explode(crawl.L.links(F.col("content"), F.col("url")))).collect()
    assert pages.fetch(f"{root}/", "x", most=10)[-1] == "Larger than 10 bytes"
    assert pages.fetch(f"{root}/", "x", timeout=0.000001)[-1] == "Timeout"


def test_pages_as_a_stream(spark, site):
    pages.register(spark)
    stream = spark.readStream.format("pages").options(urls="\n".join(f"{site[0]}{x}" for x in ("/", "/keys", "/gone"))).load()
    assert {r["status_code"] for r in streams.run_available(stream.select("url", "status_code")).collect()} == {200, 404}
    reader = pages._StreamReader({"urls": "a\nb\nc", "per_batch": "2"})
    assert [reader.initialOffset(), reader.latestOffset(), reader.latestOffset()] == [{"at": 0}, {"at": 2}, {"at": 3}]
    assert [p.urls for p in reader.partitions({"at": 2}, {"at": 3})] == [["c"]]


def test_index_files_of_many_lines(spark, index, tmp_path):
    files.write_toc(index, str(tmp_path / "lines"))
    one = json.loads(files.toc_documents(index).toJSON().first())
    for k in range(2):
        (tmp_path / f"indented{k}.json").write_text(json.dumps(one | {"source_name": f"s{k}"}, indent=2))
    (tmp_path / "bad.json").write_text("{no json")
    assert {r["source_name"]: r["entry_count"] for r in toc.stats(files.read_toc(spark, str(tmp_path / "*.json"))).collect()} == {"s0": 3, "s1": 3}
    assert files.read_toc(spark, str(tmp_path / "lines")).count() == 3


def test_model_over_http(site):
    root, calls = site
    ask = completion.http_completer(root, "m")
    assert completion.is_alive(ask) and completion.flush_cache(ask)
    assert not completion.is_alive(completion.http_completer("http://127.0.0.1:1", "m", attempts=1))
    calls.clear()
    with pytest.raises(OSError):
        completion.http_completer(root, "wrong")("", "x", 0.0, 1)
    assert len(calls) == 1  # what is refused is not asked again
    tokens = completion.http_stream(root, "m")("", "x", 0.0, 9)
    assert "".join(completion.without_thinking(tokens)) == "yes"


def test_service_streams_and_health(spark, index):
    s = service.Service(spark, index, lambda *a: "ok")
    assert s.health()[1] | {"version": ""} == {"status": "healthy", "llm_connected": True, "index_loaded": True, "index_entries": 3, "version": ""}
    rules = service.Service(spark, index)
    assert rules.stats()[1]["source_name"] == "api" and rules.query([])[0] == 422
    server = service.serve(rules, "127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/query/stream", json.dumps({"query": "bearer token"}).encode())
    with urllib.request.urlopen(ask) as r:
        assert r.headers.get_content_type() == "text/plain" and "bearer token" in r.read().decode()
    server.shutdown()


def test_what_is_prepared_changes_nothing(spark, index):
    q = spark.createDataFrame([(0, "zebra"), (1, "minute codes"), (2, "token")], "query_id long, query string")
    rows = lambda **kw: sorted(map(tuple, retrieve.retrieve(q, index, **kw).collect()))
    assert rows() == rows(ready=retrieve.prepared(index))


def test_bloom_add(spark):
    b = bloom.Bloom(1000, 0.01)
    urls = lambda *x: spark.createDataFrame([(u,) for u in x], "url string")
    first, fresh = b.add(b.empty(spark), urls("a", "b", "a", None), "url")
    assert sorted(r["url"] for r in fresh.collect()) == ["a", "b"]
    second, fresh = b.add(first, urls("b", "c"), "url")
    assert [r["url"] for r in fresh.collect()] == ["c"]
    assert second.orderBy("bucket").collect() == b.build(urls("a", "b", "c"), "url").orderBy("bucket").collect()


def test_count_urls(spark):
    rows = spark.createDataFrame([("http://a/",), ("http://a",), ("http://a/#x",), ("http://b",)], "url string")
    assert tuple(crawl.count_urls(rows).first()) == (2, 2)

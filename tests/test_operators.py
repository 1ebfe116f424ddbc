"""Operators on small inputs whose results are known."""

from __future__ import annotations

import http.server
import json
import threading

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill import options, service
from lexmill.operators import bloom, bm25, chunking, convert, crawl, dom, postings, signposts, toc
from lexmill.plans import retrieve
from lexmill.sources import files, pages
from lexmill.streaming.thinking import END, START, step

LONG = "word " * 30


def chunks_of(spark, text, **kw):
    df = spark.createDataFrame([(1, text)], "doc_id long, markdown string")
    return chunking.chunk_markdown(df, **kw).orderBy("pos").collect()


def test_a_short_header_does_not_close_its_elders(spark):
    got = chunks_of(spark, f"# A\n{LONG}\n## B\n{LONG}\n## c\nx\n### D\n{LONG}")
    assert [r["header"] for r in got] == ["A", "B", "D"]
    assert got[2]["parent_id"] == got[1]["chunk_id"] and got[1]["parent_id"] == got[0]["chunk_id"]
    assert got[1]["children_ids"] == [got[2]["chunk_id"]]


def test_chunk_edges(spark):
    assert [(r["header"], r["header_level"], r["content"]) for r in chunks_of(spark, " tiny ")] == [("Document", 0, " tiny ")]
    got = chunks_of(spark, f"{LONG}\n#\n\nText\n{LONG}\n####### no\n```\n# in code\n```\n{LONG}", min_chars=5)
    assert [r["header"] for r in got] == ["Preamble", "Text", "in code"]
    assert chunks_of(spark, "a\x01b\n# H\x01\nc", min_chars=1)[1]["header"] == "H\x01"
    assert chunks_of(spark, f"# H\n{LONG}", with_header=False)[0]["content"] == LONG.strip()


def test_prune():
    out, gone = dom.Pruner().prune("<body><nav><ul><li><a>x</a></li></ul></nav><!-- c --><script>var a='</p>'</script><p>" + LONG + "</p><p>Short</p><div class='page-header'>" + LONG + "</div><div hidden='hidden'>y</div><div style='display: none'>z</div><video><source></video></body>")
    assert gone == {"comment": 1, "script": 1, "video": 1, "nav": 1, "ad_pattern": 1, "hidden": 1, "hidden_style": 1, "empty": 1}
    assert "word word" in out and "Short" not in out and out.startswith("<body>")
    assert dom.Pruner(min_text_length=0).prune("<p>Content</p>")[0] == "<p>Content</p>"
    assert dom.Pruner().prune("") == ("", {})


def test_main_content():
    assert dom.Pruner().main_content(f"<div><article><p>{LONG}</p></article></div>").startswith("<article>")
    assert dom.Pruner().main_content(f"<div id='PostBody'>{LONG}{LONG}</div><p>{LONG}</p>").startswith('<div id="PostBody">')


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab <>p/div\n", max_size=300), st.integers(1, 5))
def test_split_keeps_all(html, most):
    got = dom.Splitter(max_tokens=most).split(html)
    assert "".join(c.content for c in got) == html


def test_split_overlap():
    html = "<p>" + "a " * 20 + "</p><p>" + "b " * 20 + "</p>"
    got = dom.Splitter(max_tokens=25, overlap_tokens=2).split_with_overlap(html)
    assert len(got) == 2 and got[1].content.startswith("<!-- continued -->\n") and got[0].split_tag == "p"


def test_to_markdown():
    html = '<h2>T</h2><p>a <b>b</b> <a href="u">l</a></p><ul><li>x</li><li>y</li></ul><table><tr><th>h</th></tr><tr><td>1</td></tr></table><pre><code class="language-py">x = 1\n</code></pre><img src="s" alt="t">'
    assert dom.to_markdown(html) == "## T\n\na **b** [l](u)\n\n- x\n- y\n\n| h |\n| --- |\n| 1 |\n\n```py\nx = 1\n```\n\n![t](s)"


def test_bm25_small_indexes_find_nothing(spark):
    q = spark.createDataFrame([(0, "alpha")], "query_id long, query string")
    for n in (1, 2):
        docs = spark.createDataFrame([(k, "alpha beta" if k == 0 else "gamma") for k in range(n)], "doc_id long, text string")
        assert bm25.search(docs, q).count() == 0
    docs = spark.createDataFrame([(0, "alpha beta"), (1, "gamma"), (2, "delta")], "doc_id long, text string")
    assert [r["doc_id"] for r in bm25.search(docs, q).collect()] == [0]
    assert bm25.search(docs.limit(0), q).count() == 0
    assert bm25.search(docs.limit(2), q, never_negative=True).count() == 1


def test_bloom(spark):
    assert (bloom.Bloom(1_000_000, 0.01).bits, bloom.Bloom(1_000_000, 0.01).hashes) == (9585058, 6)
    assert (bloom.Bloom(100, 0.01).bits, bloom.Bloom(100, 0.01).hashes) == (958, 6)
    assert bloom.murmur3(b"hello") == 0x248BFA47 and bloom.murmur3(b"", 1) == 0x514E28B7
    urls = spark.createDataFrame([(f"url{k}",) for k in range(100)], "url string")
    b = bloom.Bloom(1000, 0.01)
    built = b.build(urls, "url")
    assert b.contains(built, urls, "url").filter("not maybe").count() == 0
    others = spark.createDataFrame([(f"other{k}",) for k in range(200)], "url string")
    assert b.contains(built, others, "url").filter("maybe").count() < 10


def test_crawl(spark):
    links = spark.createDataFrame([("http://a", "http://a/1"), ("http://a/1", "http://a"), ("http://a/1", "http://b/x"), ("http://a/1", "http://a/2"), ("http://a/2", "http://a/3")], "src string, dst string")
    seeds = spark.createDataFrame([("http://a/",)], "url string")
    got = {r["url"]: r["depth"] for r in crawl.crawl(links, seeds, max_depth=2).collect()}
    assert got == {"http://a": 0, "http://a/1": 1, "http://a/2": 2}
    failed = spark.createDataFrame([("http://a/1",)], "url string")
    assert crawl.crawl(links, seeds, max_depth=3, failed=failed).count() == 2
    assert crawl.crawl(links, seeds, max_depth=3, same_domain=False, max_pages=3).count() == 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "<", "<think>", "</think>", "</", "think>", "<thi", "nk>", "x<think"]), max_size=12))
def test_think_filter(tokens):
    buffer, inside, out = "", False, ""
    for t in tokens:
        shown, buffer, inside = step(buffer, inside, t)
        out += shown
    out += "" if inside else buffer
    text, want = "".join(tokens), ""
    while text:
        head, mark, text = text.partition(START)
        want += head
        text = text.partition(END)[2] if mark else text
    assert out == want


@pytest.fixture(scope="module")
def index(spark):
    body = [("auth1", "OAuth2 tokens authenticate requests. Use a bearer token.", "Authentication"), ("rate1", "Requests are limited per minute.", "Rate limits"), ("error1", "Errors have codes.", "Errors")]
    chunks = spark.createDataFrame([(k, 0, i, c, h, 1, c, c, None, [], None) for k, (i, c, h) in enumerate(body)], "doc_id long, pos int, chunk_id string, content string, header string, header_level int, first_sentence string, last_sentence string, parent_id string, children_ids array<string>, source_url string")
    return toc.build(chunks, signposts.generate(chunks), "api")


def test_toc_round_trip(spark, index, tmp_path):
    path = str(tmp_path / "toc")
    files.write_toc(index, path)
    (tmp_path / "toc" / "bad.json").write_text("{no json\n")
    back = files.read_toc(spark, path)
    assert back.select("source_name", *toc.COLUMNS).orderBy("chunk_id").collect() == index.select("source_name", *toc.COLUMNS).orderBy("chunk_id").collect()
    assert toc.stats(toc.merge([back, back], "m")).first()["entry_count"] == 6


def test_retrieve_by_rules(spark, index):
    q = spark.createDataFrame([(0, "Which token do requests use?"), (1, "zebra")], "query_id long, query string")
    got = {r["query_id"]: r for r in retrieve.retrieve(q, index).collect()}
    assert got[0]["success"] and "bearer token" in got[0]["answer"]
    assert not got[1]["success"] and got[1]["layer_used"] == "bm25_fallback"


def scripted(system, prompt, temperature, max_tokens):
    """A model whose answers are fixed by what it is asked."""
    if system == retrieve.SIEVE:
        return '<think>t</think>{"action": "expand", "queries": ["a", "b"]}'
    if system == retrieve.ROUTE:
        return '["rate1", "nowhere", "auth1"]' if prompt.startswith("Question:\na\n") else "[]"
    if system == retrieve.EXTRACT:
        return '{"action": "explore_parent", "target": "error1"}' if "Section rate1" in prompt else f"fact of {prompt.split('Section ')[1].split(',')[0]}"
    if system == retrieve.SYNTHESIZE:
        return " and ".join(x.split(":")[0] for x in prompt.split("From ")[1:])
    raise ValueError("unexpected")


def test_retrieve_by_model(spark, index):
    q = spark.createDataFrame([(0, "how")], "query_id long, query string")
    r = retrieve.retrieve(q, index, scripted).first()
    assert (r["answer"], r["layer_used"], r["chunks_used"]) == ("error1 and auth1", "explorer", 3)


def test_every_prompt_is_asked_once(spark, index, monkeypatch, tmp_path):
    """One sieve, two routes, two chunks and a parent, one synthesis."""
    path = str(tmp_path / "calls")

    def counted(system, prompt, temperature, max_tokens):
        with open(path, "a") as f:
            f.write(json.dumps([system, prompt]) + "\n")
        return scripted(system, prompt, temperature, max_tokens)

    q = spark.createDataFrame([(0, "how")], "query_id long, query string")
    assert retrieve.retrieve(q, index, counted).first()["answer"] == "error1 and auth1"
    calls = [json.loads(x) for x in open(path)]
    assert len(calls) == len({tuple(x) for x in calls}) == 1 + 2 + 3 + 1


def test_signposts_may_be_missing(spark, index):
    chunks = index.selectExpr("doc_id", "pos", "chunk_id", "raw_markdown as content", "header", "header_level", "first_sentence", "last_sentence", "parent_id", "children_ids", "source_url")
    some = signposts.generate(chunks).filter("chunk_id <> 'rate1'")
    got = {r["chunk_id"]: r["dense_signpost"] for r in toc.build(chunks, some, "api").collect()}
    assert len(got) == 3 and got["rate1"] == "" and got["auth1"]


def test_crawl_of_a_tree(spark):
    """Failed pages are visited and not expanded; plans grow with the depth and no more."""
    n = 60
    links = [(f"http://h/{i}", f"http://h/{j}") for i in range(n) for j in (2 * i + 1, 2 * i + 2, 5 * i + 3) if j < n]
    failed = {f"http://h/{i}" for i in range(5, n, 11)}
    want = {"http://h/0": (0, None)}
    level = ["http://h/0"]
    for depth in range(1, 5):
        steps = {}
        for a, b in links:
            if a in level and a not in failed and b not in want:
                steps[b] = min(a, steps.get(b, a))
        want |= {b: (depth, a) for b, a in steps.items()}
        level = list(steps)
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = crawl.crawl(df(links, "src string, dst string"), df([("http://h/0",)], "url string"), 4, failed=df([(x,) for x in failed], "url string"))
    assert {r["url"]: (r["depth"], r["parent_url"]) for r in found.collect()} == want
    joins = [crawl.crawl(df(links, "src string, dst string"), df([("http://h/0",)], "url string"), d)._jdf.queryExecution().optimizedPlan().toString().count("Join") for d in (2, 7)]
    assert joins == [0, 0]


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x" * 30 + "</div>" * 100_000, "<div>" + "<p>a paragraph of some length</p>" * 100_000 + "</div>", "<span>" * 100_000 + "<b>" * 100_000 + "text"])
def test_pages_of_any_shape(page):
    pruner = dom.Pruner()
    pruner.prune(page)
    assert isinstance(pruner.main_content(page), str) and dom.to_markdown(page).strip()


def test_rows_of_one_key_stay_apart(spark):
    rows = [(1, "<p>" + "one " * 30 + "</p>"), (1, "<p>" + "two " * 30 + "</p>"), (1, "<p>" + "one " * 30 + "</p>"), (2, None)]
    got = convert.convert(spark.createDataFrame(rows, "doc_id long, html string")).collect()
    assert sorted((r["doc_id"], r["markdown"][:3]) for r in got) == [(1, "one"), (1, "two"), (2, "")]


def test_bloom_hash():
    """Published values of the hash function."""
    assert bloom.hashes([b"", b"test", b"Hello, world!", b"The quick brown fox jumps over the lazy dog"]).tolist() == [0, 0xBA6BD213, 0xC0363E43, 0x2E4FF723]
    assert bloom.hashes([b"test"], np.array([0x9747B28C], np.uint32)).tolist() == [0x704B81DC]


def test_a_failed_call_costs_one_row(spark):
    html = spark.createDataFrame([(1, "<p>" + LONG + "</p>")], "doc_id long, html string")
    def broken(*args):
        raise RuntimeError
    assert convert.convert(html, completer=broken).first()["markdown"] == ""


def test_pages_source(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            ok = self.path == "/ok"
            self.send_response(404 if self.path == "/gone" else 200)
            self.send_header("Content-Type", "text/html" if ok else "text/plain")
            self.end_headers()
            self.wfile.write(b"<a href='/x'>y</a>")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    pages.register(spark)
    got = {r["url"].removeprefix(root): r for r in spark.read.format("pages").options(urls=f"{root}/ok\n{root}/text\n{root}/gone\nhttp://127.0.0.1:1/").load().collect()}
    server.shutdown()
    assert got["/ok"]["error"] is None and "href" in got["/ok"]["content"]
    assert got["/text"]["error"].startswith("Non-HTML") and got["/gone"]["status_code"] == 404
    assert got["http://127.0.0.1:1/"]["status_code"] == 0


def test_service(spark, index):
    s = service.Service(spark, index)
    assert s.health()[1]["status"] == "degraded" and s.health()[1]["index_loaded"]  # no model answers
    assert service.Service(spark, None).query({"query": "x"})[0] == 503
    assert s.query({"query": ""})[0] == 422 and s.stats()[1]["indexes"][0]["entry_count"] == 3
    server = service.serve(s, "127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    import urllib.request
    ask = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/query", json.dumps({"query": "bearer token"}).encode())
    assert json.load(urllib.request.urlopen(ask))["success"]
    server.shutdown()


def test_options(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# x\nMAX_DEPTH=4\nOTHER=1\n")
    assert options.load({"llm_model": "m"}, str(env)) == options.Options(max_depth=4, llm_model="m")
    with pytest.raises(ValueError):
        options.Options(max_depth=11)


def test_page_files(spark):
    rows = spark.createDataFrame([("u1", "same", 1), ("u2", "same", 2), ("u3", "else", 3)], "url string, content string, depth int").withColumn("crawled_at", F.expr("timestamp_seconds(depth)"))
    got = files.page_files(rows).collect()
    assert len(got) == 2 and any("<!-- URL: u2 -->" in r["value"] for r in got)


def test_bm25_scores_are_not_shuffled_before_the_best_are_known(spark):
    docs = spark.createDataFrame([(k, f"a b{k} c{k % 3} d{k % 2}") for k in range(20)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "a c1 b3"), (1, "d1 d1 c2")], "query_id long, query string")
    terms = bm25.tokenized(docs)
    posted = postings.postings(terms)
    totals = postings.counts(posted)
    by_rows = bm25.search(docs, asked)
    by_index = postings.search(posted, totals, postings.statistics(terms.select(F.size("terms").alias("dl")), totals), asked)
    by_terms = bm25.search(docs, asked, ready=bm25.prepared(docs))
    for found in (by_rows, by_index, by_terms):
        assert "hashpartitioning(query_id#" in (plan := found._jdf.queryExecution().executedPlan().toString())
        assert not [x for x in plan.splitlines() if "hashpartitioning(query_id#" in x and "doc_id#" in x]
    rows = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect())
    assert rows(by_rows) == rows(by_index) == rows(by_terms) and len(rows(by_rows)) == 10


@pytest.mark.parametrize("digits", [1, 2])
def test_pieces_are_postings(spark, digits):
    texts = ["a b a _ é1 東京 É1 b", "", None, "x", " ".join(f"w{k % 40}" for k in range(100))]
    terms = bm25.tokenized(spark.createDataFrame([(k // 2, v) for k, v in enumerate(texts * 2)], "doc_id long, text string"))
    pieces = postings.pieces(terms, digits=digits)
    found, plain = postings.of_pieces(pieces), postings.postings(terms, digits=digits)
    assert found.dtypes == plain.dtypes and sorted(found.collect()) == sorted(plain.collect())


def test_postings_are_written_without_a_sort(spark):
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    with pytest.raises(OSError), postings.open_files(spark):
        assert int(spark.conf.get(name)) == postings.MOST_OPEN
        raise OSError
    assert spark.conf.get(name) == before


def test_chunks_are_trimmed_of_any_white_space_and_keep_the_mark(spark):
    white, body = " 　\x85 \t\n", "\x01" + "b" * 120 + "\x01"
    rows = spark.createDataFrame([(1, f"{white}{body}{white}\n# one\xa0 two　\n{body}{white}")], "doc_id long, markdown string")
    got = chunking.chunk_markdown(rows).orderBy("pos").collect()
    assert [r["header"] for r in got] == ["Preamble", "one\xa0 two"]
    assert [r["content"] for r in got] == [body, f"# one\xa0 two　\n{body}"]

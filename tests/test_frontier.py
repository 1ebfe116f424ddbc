"""The crawl that feeds itself: against the crawl by joins, over HTTP, and broken off in between."""

from __future__ import annotations

import http.server
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.functions import urls as L
from lexmill.operators import crawl as joins
from lexmill.streaming import frontier

ROOT = "http://a.com"


def web(spark, links):
    """A table of pages from {path: hrefs}."""
    rows = [(ROOT + k, "".join(f'<a href="{x}">x</a>' for x in v)) for k, v in links.items()]
    return spark.createDataFrame(rows, "url string, html string")


def some_web(n=40, seed=5):
    rng = random.Random(seed)
    return {"" if k == 0 else f"/p{k}": [f"/p{rng.randrange(1, n + 9)}" for _ in range(rng.randint(1, 3))] + ["/p1", "/p2"] * (k == 0) + ["http://b.com/x"] * (k % 5 == 0) for k in range(n)}


def short(df):
    return sorted((r["url"], r["depth"], r["parent_url"]) for r in df.select("url", "depth", "parent_url").collect())


@pytest.mark.parametrize(("depth", "same_domain", "most"), [(9, True, None), (2, False, None), (9, True, 11), (0, True, None)])
def test_is_the_crawl_by_joins(spark, tmp_path, depth, same_domain, most):
    pages = web(spark, some_web())
    seeds = spark.createDataFrame([(f"{ROOT}/",), (None,), (f"{ROOT}/#top",)], "url string")
    got = frontier.crawl(seeds, str(tmp_path / "c"), frontier.from_table(pages), frontier.Rules(depth, same_domain, most))
    links = joins.edges(pages)
    missing = links.select(F.col("dst").alias("url")).join(pages, "url", "left_anti")
    plain = joins.crawl(links, seeds.filter("url is not null"), depth, same_domain, most, failed=missing)
    assert short(got) == short(plain) and (depth == 0 or len(short(got)) > 5) and (most is None or len(short(got)) == most)
    assert got.filter("(error is null) != (status_code = 200)").isEmpty()


def test_goes_on_where_it_broke_off(spark, tmp_path):
    """A fetch that fails once in each level, after some tables were written or before, leads to the same pages, each fetched into one batch."""
    pages = web(spark, some_web())
    seeds = spark.createDataFrame([(ROOT,)], "url string")
    whole = short(frontier.crawl(seeds, str(tmp_path / "whole"), frontier.from_table(pages), frontier.Rules(9)))
    fetch, tried = frontier.from_table(pages), Counter()

    def breaks(rows):
        n = rows.select(F.max("depth")).first()[0]
        tried[n] += 1
        if tried[n] == 1 and n in (1, 2):
            raise OSError("no network")
        return fetch(rows)

    def after(got, known, rules, plain=frontier.links_to_visit, seen=[]):  # noqa: B006
        if len(seen) == 1:
            seen.append(1)
            raise OSError("an executor is gone")
        seen.append(1)
        return plain(got, known, rules)

    frontier.links_to_visit, kept = after, frontier.links_to_visit
    try:
        for k in range(9):
            try:
                got = frontier.crawl(seeds, str(tmp_path / "c"), breaks, frontier.Rules(9))
                break
            except Exception as e:
                assert "no network" in str(e) or "executor is gone" in str(e)
    finally:
        frontier.links_to_visit = kept
    assert k == 3 and short(got) == whole
    assert got.count() == got.select("asked").distinct().count()
    assert frontier.frontier(spark, str(tmp_path / "c")).count() == len(whole)
    # run again, with a seed that was visited and one that is new: only that is fetched
    more = spark.createDataFrame([(ROOT,), ("http://c.com",)], "url string")
    got = frontier.crawl(more, str(tmp_path / "c"), fetch, frontier.Rules(9))
    assert short(got.filter("site = 'a.com'")) == whole and short(got.filter("site = 'c.com'")) == [("http://c.com", 0, None)]


def test_of_a_site_over_http(spark, tmp_path):
    links = {"/": ["/b", "/c#x", "/text"], "/b": ["/d", "/"], "/c": ["/b", "/gone"], "/d": ["/e"], "/e": []}
    asked = Counter()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked[self.path or "/"] += 1
            body = "".join(f"<a href='{x}'>x</a>" for x in links.get(self.path or "/", [])).encode()
            self.send_response(200 if self.path in links or self.path == "/text" else 404)
            self.send_header("Content-Type", "text/plain" if self.path == "/text" else "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    seeds = spark.createDataFrame([(f"{root}/",)], "url string")
    got = {r["asked"].removeprefix(root): r for r in frontier.crawl(seeds, str(tmp_path / "c"), frontier.from_web(parallel=2), frontier.Rules(2)).collect()}
    assert {k: (r["depth"], r["status_code"]) for k, r in got.items()} == {"": (0, 200), "/b": (1, 200), "/c": (1, 200), "/text": (1, 200), "/d": (2, 200), "/gone": (2, 404)}
    assert got["/text"]["error"].startswith("Non-HTML") and got["/gone"]["error"] and got["/d"]["parent_url"] == f"{root}/b"
    frontier.crawl(seeds, str(tmp_path / "c"), frontier.from_web(), frontier.Rules(2))
    assert max(asked.values()) == 1  # nothing is fetched twice
    server.shutdown()


def test_links_keep_their_digits(spark):
    df = spark.createDataFrame([("http://a.com/", "<a href='/p0'><a href='1/p1'><a href=' /p2 '>")], "url string, html string")
    assert df.select(L.links(F.col("html"), F.col("url"))).first()[0] == ["http://a.com/p0", "http://a.com/1/p1", "http://a.com/p2"]


def test_urls_by_event_time(spark, tmp_path):
    """A repeat within the time is dropped, one after it is not, and what comes too late is nothing."""
    from lexmill.plans import streams
    from lexmill.streaming import urls

    def run(*rows):
        spark.createDataFrame(rows, "url string, s long").select("url", F.timestamp_seconds("s").alias("at")).write.mode("append").parquet(str(tmp_path / "in"))
        seen = urls.unique(streams.read_stream(spark, str(tmp_path / "in")), time="at", within="60 seconds")
        return sorted(r["url"] for r in streams.run_available(seen.select("url"), str(tmp_path / "c")).collect())

    assert run(("http://a/", 100), ("http://a#x", 101), ("http://b", 100)) == ["http://a", "http://b"]
    assert run(("http://a", 130), ("http://c", 42)) == ["http://a", "http://b", "http://c"]  # a is a repeat, c just in time
    assert run(("http://d", 69), ("http://e", 300)) == ["http://a", "http://b", "http://c", "http://e"]  # d is too late
    assert run(("http://a", 301)) == ["http://a", "http://a", "http://b", "http://c", "http://e"]  # a was forgotten

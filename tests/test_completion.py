"""Calls of models: accounts, failures, order, how many at once and how fast; and counts that merge."""

from __future__ import annotations

import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from lexmill.operators import completion, crawl


def prompts(spark, n, parts=3):
    return spark.range(0, n, 1, parts).select("id", F.when(F.col("id") % 7 != 5, F.concat(F.lit("p"), "id")).alias("prompt"))


def test_replies_with_accounts(spark):
    def model(system, prompt, temperature, max_tokens):
        k = int(prompt[1:])
        time.sleep(0.002 * (k % 3))  # later calls may end earlier
        if k % 7 == 3:
            raise TimeoutError("no answer")
        return f"{system}{prompt}" if k % 2 else completion.Reply(prompt, "length" if k % 4 else "stop", k, 1)

    got = {r["id"]: r["reply"] for r in completion.ask(prompts(spark, 60), model, "s", at_once=4).collect()}
    for k, r in got.items():
        if k % 7 == 5:
            assert r is None
        elif k % 7 == 3:
            assert tuple(r) == (None, None, None, None, "TimeoutError: no answer")
        elif k % 2:
            assert tuple(r) == (f"sp{k}", None, None, None, None)
        else:
            assert tuple(r) == (f"p{k}", "length" if k % 4 else "stop", k, 1, None)
    u = completion.usage(completion.ask(prompts(spark, 60), model)).first()
    even = [k for k in range(60) if k % 7 not in (3, 5) and k % 2 == 0]
    assert tuple(u) == (sum(k % 7 != 5 for k in range(60)), sum(k % 7 == 3 for k in range(60)), sum(k % 4 > 0 for k in even), sum(even), len(even))
    plain = {r["id"]: r["answer"] for r in completion.complete(prompts(spark, 60), model, "s").collect()}
    assert all(plain[k] == (r["answer"] if r else None) for k, r in got.items())
    assert tuple(completion.usage(completion.ask(prompts(spark, 0), model)).collect()) == () or completion.usage(completion.ask(prompts(spark, 0), model)).first()["calls"] == 0


@pytest.mark.parametrize("at_once", [1, 4])
def test_so_many_calls_at_once(spark, tmp_path, at_once):
    """A task has as many calls under way as it may, and no more."""
    path = str(tmp_path / "calls")

    def model(system, prompt, temperature, max_tokens):
        with open(path, "a") as f:
            f.write(f"{time.monotonic()} 1\n")
        time.sleep(0.02)
        with open(path, "a") as f:
            f.write(f"{time.monotonic()} -1\n")
        return "ok"

    assert completion.ask(prompts(spark, 40, 1), model, at_once=at_once).filter("reply.answer = 'ok'").count() == sum(k % 7 != 5 for k in range(40))
    under_way = most = 0
    for _, change in sorted((float(a), int(b)) for a, b in map(str.split, open(path))):
        under_way += change
        most = max(most, under_way)
    assert most == at_once


def test_pace():
    at, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 6))
        at[0] += s

    pace = completion.Pace(10, burst=2, now=lambda: at[0], sleep=sleep)
    for _ in range(5):
        pace.wait()
    assert slept == [0.1, 0.1, 0.1]  # two at once, then one in a tenth of a second
    at[0] += 9
    for _ in range(3):
        pace.wait()
    assert slept == [0.1, 0.1, 0.1, 0.1]  # a rest gives no more than two


def test_calls_keep_their_pace(spark):
    began = time.monotonic()
    assert completion.ask(prompts(spark, 14, 1), lambda *a: "x", at_once=2, per_second=20).filter("reply.answer = 'x'").count() == 12
    assert time.monotonic() - began >= 10 / 20


def test_accounts_over_http():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": [{"type": "text", "text": "o"}, "k"]}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 7, "completion_tokens": 2}}).encode())

        def log_message(self, *args):
            pass

    asked = []
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    call = completion.http_completer(f"http://127.0.0.1:{server.server_port}", "m", stop=["\n"])
    assert call("s", "p", 0.5, 9) == completion.Reply("ok", "stop", 7, 2)
    assert asked[0]["stop"] == ["\n"] and asked[0]["messages"] == [{"role": "system", "content": "s"}, {"role": "user", "content": "p"}] and asked[0]["max_tokens"] == 9
    assert completion.is_alive(call)
    server.shutdown()
    assert completion.reply_of({}) == completion.reply_of("") == completion.Reply("", None, None, None)


def test_sketches_unite(spark):
    """United sketches of overlapping parts are the sketch of all, within its bound."""
    pages = spark.range(30_000).select(F.concat(F.lit("http://h/"), F.col("id") % 20_000).alias("url"), (F.col("id") % 3).alias("part"))
    all_ = crawl.united_count(crawl.url_sketches(pages)).first()[0]
    parts = crawl.url_sketches(pages.unionByName(pages.withColumn("part", F.lit(9).cast("long"))), "part")
    assert abs(crawl.united_count(parts).first()[0] - all_) <= 0.005 * all_ and abs(all_ - 20_000) <= 3 * 0.008 * 20_000
    assert crawl.united_count(crawl.url_sketches(spark.createDataFrame([(None,), ("http://a/",), ("http://a",)], "url string"))).first()[0] == 1

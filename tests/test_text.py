"""Text, URL and answer expressions on edge cases, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from urllib.parse import urljoin

from pyspark.sql import functions as F

from lexmill.functions import answers as A
from lexmill.functions import text as X
from lexmill.functions import urls as L


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


def test_sentences(spark):
    cases = ["", "no end here", " ".join(["w"] * 30), " ".join(["w"] * 31), "A. B! C?", "# Head\nFirst one. Then. tail", "wait... what?!", "été. naïve fin", "  x 　"]
    rows = spark.createDataFrame([(c,) for c in cases], "v string").select("v", X.first_sentence(F.col("v")).alias("f"), X.last_sentence(F.col("v")).alias("l"), X.word_count(F.col("v")).alias("n"), X.tokens(F.col("v")).alias("t")).collect()
    for r in rows:
        body = re.sub(r"\s+", " ", re.sub(r"\A#+\s+.+\n", "", r["v"]).strip())
        ends = re.findall(r"[^.!?]*[.!?]", body)
        words = body.split()
        assert r["f"] == (ends[0].strip() if ends else " ".join(words[:30]) + ("..." if len(words) >= 30 else "")), r["v"]
        whole = re.sub(r"\s+", " ", r["v"]).strip()
        ends, words = re.findall(r"[^.!?]*[.!?]", whole), whole.split()
        assert r["l"] == (ends[-1].strip() if ends else ("..." if len(words) > 30 else "") + " ".join(words[-30:])), r["v"]
        assert r["n"] == len(words)
        assert r["t"] == re.findall(r"\b\w+\b", r["v"].lower())


def test_ids(spark):
    text = "é" * 150
    assert one(spark, text, lambda c: X.chunk_id(F.lit("h"), c)) == hashlib.sha256(("h:" + text[:100]).encode()).hexdigest()[:12]
    assert one(spark, "Content here.", lambda c: X.chunk_id(F.lit("Header"), F.concat(F.lit("# Header\n\n"), c))) == "b8b2bd1cc481"


def test_clean_markdown(spark):
    assert one(spark, "  a  \n\n\n\n\tb \n \n \n```\n  code\n```\n", X.clean_markdown) == "a\n\nb\n\n```\ncode\n```"
    assert one(spark, "```markdown\n# A\n```", X.strip_fence) == "# A"
    assert one(spark, "", X.clean_markdown) == ""


def test_clean_markdown_line_by_line(spark):
    """Against a definition, with white space of other scripts and many blank lines; lines are not made rows of an array."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(["\n", "\n", " ", "\t", "\xa0", "\u2003", "\u2028", "\r", "\x0b", "\x1c", "\u200b", "a", "é", "```", "```markdown"]) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    texts += ["a" + "\n\xa0" * 20_000 + "\nb", "a" + " " * 20_000 + "b", "```", "``````", "```markdown", "```markdown```", "```markdown\n```\n"]
    white = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    strip = lambda t: re.sub(f"^{white}+|{white}+\\Z", "", t)

    def clean(t):
        t = re.sub("\n{3,}", "\n\n", t)
        lines = [x.strip(" \t") for x in t.split("\n")]
        return strip("\n".join(x for k, x in enumerate(lines) if strip(x) or not k or strip(lines[k - 1])))

    def fence(t):
        return re.sub(f"{white}*```\\Z", "", re.sub(f"\\A```markdown{white}*", "", strip(t)))

    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", X.clean_markdown(F.col("t")).alias("c"), X.strip_fence(F.col("t")).alias("f"))
    assert {r["k"]: (r["c"], r["f"]) for r in df.collect()} == {k: (clean(t), fence(t)) for k, t in enumerate(texts)}
    assert "lambdafunction" not in df._jdf.queryExecution().executedPlan().toString()


def test_urls(spark):
    base = "http://h.example:80/a/b/c;p?q=1#f"
    for link in ["x", "./x", "../x", "../../../x", "/x", "//o.example/y", "?z=2", "http://k/", "x?y#z", "/a/./b/../c", "x/.."]:
        got = one(spark, link, lambda c: L.join(F.lit(base), c))
        want = urljoin(base, link)
        assert got.rstrip("/") == want.rstrip("/"), link
    assert one(spark, "HTTP://H.example/a;x/b;y//?q#f", L.normalize) == "http://H.example/a;x/b;y//?q"
    assert one(spark, "http://h/a;x/b;y/", L.normalize) == "http://h/a;x/b;y" and one(spark, "http://h/a;x/b;y#f", L.normalize) == "http://h/a;x/b"
    html = '<a href="/x">1</a><a HREF=\'/x\'>2</a><a href="mailto:a@b">3</a><a href="#t">4</a><link href="s.css">'
    assert one(spark, html, lambda c: L.links(c, F.lit("http://h/p"))) == ["http://h/x", "http://h/s.css"]


def test_answers(spark):
    assert one(spark, 'x ["a", 1, "b"] y', A.routed) == ["a", "b"]
    assert one(spark, "nothing", A.routed) == []
    r = one(spark, "<think>why</think> {\"queries\": [\"p\", \"q\"]}", lambda c: A.sieved(c, F.lit("o")))
    assert (r["action"], r["queries"], r["reasoning"]) == ("search", ["p", "q"], "why")
    assert one(spark, "broken {", lambda c: A.sieved(c, F.lit("o")))["queries"] == ["o"]
    r = one(spark, '{"action": "explore_parent", bad', lambda c: A.extracted(c, F.lit("p")))
    assert not r["needs_parent"] and r["facts"]
    assert one(spark, '{"choices": [{"message": {"content": [{"text": "a"}, {"text": "b"}]}}]}', lambda c: A.content_of(F.parse_json(c))) == "ab"

"""Metrics, progress and times; settings that take effect; pages that share an id."""

from __future__ import annotations

import logging

import pytest

from lexmill import __main__ as cli
from lexmill import observe, options
from lexmill.operators import completion, dom
from lexmill.plans import index, streams


def test_mean_tokens_of_signposts(spark):
    made = spark.createDataFrame([("a", 3), ("b", 4), ("c", 6)], "chunk_id string, token_count int").repartition(3)
    df, seen = observe.mean_tokens(made)
    assert df.count() == 3 and seen.values() == {"count": 3, "mean_tokens": 4}
    df, seen = observe.mean_tokens(made.filter("token_count > 9"))
    assert df.collect() == [] and seen.values() == {"count": 0, "mean_tokens": 0}


def test_progress_of_a_stream(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "lexmill")
    for k in range(2):
        spark.range(5 * k, 5 * k + 5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with observe.stream_progress(spark, "ids") as batches:
        streams.run_available(streams.read_stream(spark, str(tmp_path / "in"), 1).dropDuplicates(["id"]))
    assert sum(b["rows"] for b in batches) == 10 and batches[-1]["kept"] == 10 and len([b for b in batches if b["rows"]]) == 2
    assert "ids: batch 1, 5 rows in" in caplog.text and "ids: stream ended" in caplog.text


def test_times(caplog):
    caplog.set_level(logging.DEBUG, "lexmill")
    with observe.timed("step"):
        pass
    with pytest.raises(KeyError), observe.timed("broken"):
        raise KeyError("x")
    assert "step: 0 ms" in caplog.text and "broken: failed after" in caplog.text


def test_settings_take_effect(spark, tmp_path, monkeypatch):
    """What the command line makes of its settings: the splitter's limit, the model's defaults, the level of the log."""
    made, asked = {}, []
    monkeypatch.setenv("MAX_TOKENS_PER_CHUNK", "123")
    monkeypatch.setenv("LLM_TEMPERATURE", "0.7")
    monkeypatch.setenv("LLM_MAX_TOKENS", "77")
    monkeypatch.setenv("LOG_LEVEL", "ERROR")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<!-- URL: http://a/ --><p>" + "word " * 60 + "</p>")

    def splitter(**kw):
        made.update(kw)
        return plain(**kw)

    plain = dom.Splitter
    monkeypatch.setattr(cli.dom, "Splitter", splitter)
    try:
        assert cli.run(["convert", str(tmp_path / "in"), "--output", str(tmp_path / "out")], spark) == 0
        assert made == {"max_tokens": 123} and observe.log.level == logging.ERROR
    finally:
        observe.log.setLevel(logging.NOTSET)
        for h in list(observe.log.handlers):
            observe.log.removeHandler(h)
    assert (tmp_path / "out" / "a.md").read_text().startswith("<!-- Source: http://a/ -->\n\nword word")
    monkeypatch.setattr(completion, "_request", lambda *a, **kw: asked.append(a) or (_ for _ in ()).throw(ValueError("asked")))
    opts = options.load()
    ask = completion.http_completer("http://h", "m", temperature=opts.llm_temperature, max_tokens=opts.llm_max_tokens)
    for given in ((None, None), (0.0, 5)):
        with pytest.raises(ValueError, match="asked"):
            ask("s", "p", *given)
    assert [a[-2:] for a in asked] == [(0.7, 77), (0.0, 5)]


def test_pages_that_share_an_id_are_indexed_apart(spark):
    body = lambda *names: "".join(f"<h{1 + (k > 0)}>{n}</h{1 + (k > 0)}><p>{n} " + "says this and that of it. " * 8 + "</p>" for k, n in enumerate(names))
    rows = [(1, "http://a/1", body("One", "Two")), (1, "http://a/2", body("Three", "Four")), (1, "http://a/2", body("Three", "Four")), (2, "http://a/3", body("One", "Two")), (None, None, body("Five"))]
    got = index.index_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), "s").collect()
    assert sorted((str(r["doc_id"]), r["header"], str(r["source_url"])) for r in got) == sorted([("1", "One", "http://a/1"), ("1", "Two", "http://a/1"), ("1", "Three", "http://a/2"), ("1", "Four", "http://a/2"), ("2", "One", "http://a/3"), ("2", "Two", "http://a/3"), ("None", "Five", "None")])
    parents = {(r["doc_id"], r["header"]): r["parent_id"] for r in got}
    ids = {(r["doc_id"], r["header"]): r["chunk_id"] for r in got}
    assert parents[(1, "Two")] == ids[(1, "One")] and parents[(1, "Four")] == ids[(1, "Three")]

"""Pages, Markdown and indexes as files: read back as they were written, and nothing left of tasks that failed."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import signposts, toc
from lexmill.sources import files, texts


def names(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if not p.name.startswith("."))


def test_pages_come_back(spark, tmp_path):
    at = dt.datetime(2024, 5, 1)
    rows = [("http://a/1", "<p>é one</p>", at, 0), ("http://a/2", "<p>two</p>", at, 1), ("http://a/3", "<p>two</p>", at + dt.timedelta(1), 1), ("http://a/4", "", at, 2)]
    pages = spark.createDataFrame(rows, "url string, content string, crawled_at timestamp, depth int").repartition(3)
    files.write_pages(pages, str(tmp_path / "raw"))
    read = {r["name"]: r for r in files.read_html(spark, str(tmp_path / "raw")).collect()}
    hashes = {r["content"]: f"{r['h']}.html" for r in pages.select("content", X.content_hash(F.col("content")).alias("h")).collect()}
    assert names(tmp_path / "raw") == sorted(hashes.values()) == sorted(read)
    assert {n: r["source_url"] for n, r in read.items()} == {hashes["<p>é one</p>"]: "http://a/1", hashes["<p>two</p>"]: "http://a/3", hashes[""]: "http://a/4"}
    assert read[hashes["<p>é one</p>"]]["html"] == "<!-- URL: http://a/1 -->\n<!-- Crawled: 2024-05-01 00:00:00 -->\n<!-- Depth: 0 -->\n<p>é one</p>"


def test_markdown_comes_back(spark, tmp_path):
    docs = spark.createDataFrame([("ab12.html", "# T\nx", "http://a"), ("7", "y", None)], "doc_id string, markdown string, source_url string")
    files.write_markdown(docs, str(tmp_path))
    assert names(tmp_path) == ["7.md", "ab12.md"]
    assert (tmp_path / "ab12.md").read_text() == "<!-- Source: http://a -->\n\n# T\nx"
    assert {(r["name"], r["source_url"]) for r in files.read_markdown(spark, str(tmp_path)).collect()} == {("7.md", None), ("ab12.md", "http://a")}


def test_an_index_is_one_indented_file(spark, tmp_path):
    rows = [(1, k, f"c{k}", f"text {k} é", f"H{k}", 1, "f", "l", None if k else "p", ["a", "b"] if k else [], None) for k in range(3)]
    chunks = spark.createDataFrame(rows, "doc_id long, pos int, chunk_id string, content string, header string, header_level int, first_sentence string, last_sentence string, parent_id string, children_ids array<string>, source_url string")
    made = toc.build(chunks, signposts.generate(chunks), "api")
    both = toc.merge([made], "api").unionByName(toc.merge([made], "other"))
    files.write_toc(both, str(tmp_path))
    assert names(tmp_path) == ["api.json", "other.json"]
    told = json.loads((tmp_path / "api.json").read_text())
    assert told["entry_count"] == 3 and [e["chunk_id"] for e in told["entries"]] == ["c0", "c1", "c2"] and told["entries"][1]["parent_id"] is None and "\n  " in (tmp_path / "api.json").read_text()
    key = lambda df: sorted(map(str, df.select("source_name", "pos", *toc.COLUMNS).collect()))
    files.write_toc(both, str(tmp_path / "lines"), indented=False)
    back = files.read_toc(spark, str(tmp_path / "*.json"))
    assert key(back) == key(files.read_toc(spark, str(tmp_path / "lines"))) and back.count() == 6


def test_modes_and_names(spark, tmp_path):
    df = lambda *rows: spark.createDataFrame(rows, "name string, value string")
    (tmp_path / "kept").mkdir()
    texts.write(df(("a", "1"), ("b", None)), str(tmp_path))
    texts.write(df(("b", "2"), ("c", "3")), str(tmp_path), "append")
    assert {n: (tmp_path / n).read_text() for n in "abc"} == {"a": "1", "b": "2", "c": "3"}
    texts.write(df(("d", "4")), f"file:{tmp_path}")
    assert names(tmp_path) == ["d", "kept"]
    texts.write(df().limit(0), str(tmp_path))
    assert names(tmp_path) == ["kept"]
    for bad in ("../x", "", None, "_x", ".x", "a/b"):
        with pytest.raises(Exception, match="plain name"):
            texts.write(df((bad, "1")), str(tmp_path), "append")
    with pytest.raises(Exception, match="name and value"):
        df(("a", "1")).withColumn("value", F.lit(1)).write.format("text_files").mode("append").save(str(tmp_path))


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    """The first tasks have written their files by the time that the last one fails."""
    texts.write(spark.createDataFrame([("old", "as it was")], "name string, value string"), str(tmp_path))
    rows = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 39, "no/name").otherwise(F.concat(F.lit("f"), "id")).alias("name"), F.lit("x").alias("value"))
    with pytest.raises(Exception, match="plain name"):
        texts.write(rows, str(tmp_path))
    assert names(tmp_path) == ["old"] and (tmp_path / "old").read_text() == "as it was"

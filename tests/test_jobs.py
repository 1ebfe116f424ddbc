"""The jobs: growing input, repeated and broken runs, settings, and their SQL."""

from __future__ import annotations

import json
import logging
import os
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobs import common, queries, search_index, site_map
from lexmill.operators import bm25

from .conftest import ROOT
from .oracle import compare, connect

DOCS, PAGES = "doc_id long, text string, lang string", "page_id long, url string, html string"


def add_file(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    compare(queries.QUERIES[name](spark, data), connect(data), queries.SQL[name])


# The index.


def fresh(df):
    return Counter(map(tuple, df.select("term", "df", "doc_id", "tf", "dl").collect()))


def by_hand(texts):
    """The index of {id: text}, all in lower case words."""
    of = {k: (v or "").split() for k, v in texts.items()}
    df = Counter(t for ts in of.values() for t in set(ts))
    return Counter((t, df[t], k, n, len(ts)) for k, ts in of.items() for t, n in Counter(ts).items())


def test_index_takes_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    source, target = tmp_path / "docs", str(tmp_path / "index")
    first = {1: "ant bee ant", 2: "bee cat", 3: None, 4: ""}
    add_file(spark, [(k, v, "en") for k, v in first.items()] + [(None, "no id here", "en")], DOCS, source)
    assert fresh(search_index.run(spark, str(source), target)) == by_hand(first)
    assert "read 5 rows in 1 batches" in caplog.text
    before = {p: p.read_bytes() for p in (tmp_path / "index").rglob("*.parquet")}

    caplog.clear()
    assert fresh(search_index.run(spark, str(source), target)) == by_hand(first)
    assert "read 0 rows" in caplog.text and {p: p.read_bytes() for p in (tmp_path / "index").rglob("*.parquet")} == before

    # one document is new, one comes again, one loses its text
    caplog.clear()
    add_file(spark, [(5, "dog ant", "en"), (1, "cat cat", "fr"), (2, None, "en")], DOCS, source)
    then = first | {5: "dog ant", 1: "cat cat", 2: None}
    assert fresh(search_index.run(spark, str(source), target)) == by_hand(then)
    assert "read 3 rows in 1 batches" in caplog.text
    assert all(p.read_bytes() == b for p, b in before.items())  # no segment is written again

    add_file(spark, [(1, "ant", "fr"), (1, "ant zoo", "fr")], DOCS, source)
    assert fresh(search_index.run(spark, str(source), target)) == by_hand(then | {1: "ant zoo"})
    assert search_index.live_documents(spark, target).count() == 5


def test_index_survives_a_batch_that_breaks(spark, tmp_path, monkeypatch):
    """Wherever a batch ends early, the next run gives the index that a whole run gives."""
    texts = {k: f"word{k % 7} word{k % 3} all" for k in range(40)}
    source, whole = tmp_path / "docs", common.write_partitions
    add_file(spark, [(k, v, "en") for k, v in texts.items()], DOCS, source)
    for breaks_at in range(5):
        target, calls = str(tmp_path / f"index{breaks_at}"), []

        def write(*args, at=breaks_at, calls=calls):
            calls.append(args)
            if len(calls) == at + 1:
                raise OSError("the disk is gone")
            whole(*args)

        monkeypatch.setattr(common, "write_partitions", write)
        with pytest.raises(Exception, match="the disk is gone"):
            search_index.run(spark, str(source), target)
        monkeypatch.setattr(common, "write_partitions", whole)
        assert fresh(search_index.run(spark, str(source), target)) == by_hand(texts)
        n, avgdl, _, _ = spark.read.parquet(f"{target}/statistics").select("n", "avgdl", "mean", "segment").first()
        assert (n, avgdl) == (40, 3.0)


def test_index_of_batches_is_that_of_all(spark, tmp_path):
    """Segments of one file each hold what one segment of all files holds."""
    source, rows = tmp_path / "docs", [(k, f"t{k % 5} t{k % 3} x", "en") for k in range(30)]
    for k in range(3):
        add_file(spark, rows[10 * k : 10 * k + 10], DOCS, source)
    conf = common.settings("search_index")
    one = search_index.run(spark, str(source), str(tmp_path / "one"), conf)
    many = search_index.run(spark, str(source), str(tmp_path / "many"), conf | {"files_per_batch": 1})
    assert fresh(one) == fresh(many) == by_hand({k: t for k, t, _ in rows})
    assert spark.read.parquet(str(tmp_path / "many/documents")).select("segment").distinct().count() == 3


def test_an_index_keeps_its_shards(spark, tmp_path):
    conf = common.settings("search_index")
    add_file(spark, [(1, "ant", "en")], DOCS, tmp_path / "docs")
    search_index.run(spark, str(tmp_path / "docs"), str(tmp_path / "index"), conf)
    with pytest.raises(ValueError, match="shards of 1 digits"):
        search_index.run(spark, str(tmp_path / "docs"), str(tmp_path / "index"), conf | {"shard_digits": 2})


def test_search_of_the_index_is_bm25(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    asked = spark.read.parquet(f"{data}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    target = str(tmp_path / "index")
    search_index.run(spark, f"{data}/documents.parquet", target)
    found = search_index.search(spark, target, asked)
    plain = bm25.search(docs, asked, 5)
    key = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect())
    assert key(found) == key(plain)
    few = search_index.search(spark, target, spark.createDataFrame([(0, "the")], "query_id long, query string"))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "shard#" in plan  # other shards' folders are not read


def test_whole_index_shuffles_only_postings_of_rare_terms(spark, tmp_path, monkeypatch):
    """Where terms are too many to be broadcast, the most frequent ones are; the result is that of all."""
    texts = {k: f"all t{k % 2} u{k % 5} rare{k}" for k in range(30)}
    add_file(spark, [(k, v, "en") for k, v in texts.items()], DOCS, tmp_path / "docs")
    monkeypatch.setattr(search_index.signposts, "MOST_BROADCAST", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = search_index.run(spark, str(tmp_path / "docs"), str(tmp_path / "index"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 2 and "Union" in plan
        assert fresh(found) == by_hand(texts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_index_of_nothing(spark, tmp_path):
    add_file(spark, [], DOCS, tmp_path / "docs")
    assert search_index.run(spark, str(tmp_path / "docs"), str(tmp_path / "index")).count() == 0


# The map.

SITE = "http://a.com"


def page(k, path, *links, text=""):
    return (k, f"{SITE}/{path}", text + "".join(f'<a href="{x}">x</a>' for x in links))


def test_map_tells_what_changed(spark, tmp_path):
    target = str(tmp_path / "map")
    first = [page(1, "x", "/y", "/z", "http://b.com/q"), page(2, "y", "/x#top", "/z"), page(3, "w", text="same"), page(4, "v", text="same"), (5, None, "<a href='/n'>"), (6, f"{SITE}/u", None)]
    add_file(spark, first, PAGES, tmp_path / "p1")
    got = {r["url"]: r for r in site_map.run(spark, str(tmp_path / "p1"), target, "d1").collect()}
    short = lambda r: (r["page_id"], r["same_as"], r["n_out"], r["n_in"], r["inside"], r["state"])
    assert {k.removeprefix(SITE): short(r) for k, r in got.items()} == {
        "/x": (1, None, 3, 1, True, "new"), "/y": (2, None, 2, 1, True, "new"), "/w": (3, None, 0, 0, False, "new"), "/v": (4, 3, 0, 0, False, "new"), "/u": (6, None, 0, 0, False, "new"),
        "/z": (None, None, 0, 2, True, "linked"), "http://b.com/q": (None, None, 0, 1, False, "linked"),
    }
    assert [(r["url"], r["rank"]) for r in site_map.to_fetch(site_map.snapshots(spark, target)).collect()] == [(f"{SITE}/z", 1)]

    # /x is fetched anew and lost its links, /z is new, /y has gone
    second = [page(7, "x", text="other"), page(1, "x", "/y"), page(8, "z"), *first[2:4]]
    add_file(spark, second, PAGES, tmp_path / "p2")
    for _ in range(2):
        got = {r["url"]: r["state"] for r in site_map.run(spark, str(tmp_path / "p2"), target, "d2").collect()}
        assert got == {f"{SITE}/x": "changed", f"{SITE}/y": "gone", f"{SITE}/w": "same", f"{SITE}/v": "same", f"{SITE}/u": "gone", f"{SITE}/z": "new"}
    again = {r["url"]: r["state"] for r in site_map.run(spark, str(tmp_path / "p1"), target, "d1").collect()}
    assert again[f"{SITE}/x"] == "new" and again[f"{SITE}/z"] == "linked"
    assert site_map.snapshots(spark, target).groupBy("snapshot").count().count() == 2


def test_map_of_a_snapshot_leaves_nothing_of_an_earlier_run_of_it(spark, tmp_path):
    target = str(tmp_path / "map")
    add_file(spark, [(k, f"http://s{k}.org/", "") for k in range(40)], PAGES, tmp_path / "many")
    add_file(spark, [(1, "http://s1.org/", "")], PAGES, tmp_path / "few")
    assert site_map.run(spark, str(tmp_path / "many"), target, "d").count() == 40
    assert site_map.run(spark, str(tmp_path / "few"), target, "d").count() == 1
    add_file(spark, [], PAGES, tmp_path / "none")
    assert site_map.run(spark, str(tmp_path / "none"), target, "c").count() == 0


# Settings and command lines.


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"rows_a_file": 7}))
    assert common.settings("site_map", str(tmp_path / "c.json")) == {"shard_digits": 1, "rows_a_file": 7}
    (tmp_path / "c.json").write_text(json.dumps({"row_a_file": 7}))
    with pytest.raises(ValueError, match="row_a_file"):
        common.settings("site_map", str(tmp_path / "c.json"))


def test_a_table_that_is_broken_is_no_table_that_is_missing(spark, tmp_path):
    assert common.stored(spark, str(tmp_path / "none"), "a long").collect() == []
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="x.parquet"):
        common.stored(spark, str(tmp_path / "t"), "a long").collect()


def test_as_processes(tmp_path, data):
    """The command lines make a session, log to the console, answer, and end; a second run takes nothing."""
    env = os.environ | {"PYTHONPATH": ROOT}
    job = lambda *args: subprocess.run([sys.executable, "-m", *args], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    index = ["jobs.search_index", "--source", f"{data}/documents.parquet", "--target", str(tmp_path / "i")]
    first = job(*index)
    assert first.returncode == 0 and "read 200 rows in 1 batches" in first.stderr
    again = job(*index, "--ask", "the")
    assert again.returncode == 0 and "read 0 rows in 0 batches" in again.stderr
    assert [line.split("\t")[0] for line in again.stdout.splitlines()] == list("12345")[: len(again.stdout.splitlines())]
    mapped = job("jobs.site_map", "--source", f"{data}/pages.parquet", "--target", str(tmp_path / "m"), "--snapshot", "d1")
    assert mapped.returncode == 0 and "wrote snapshot d1, after None" in mapped.stderr
    assert job("jobs.site_map", "--source", str(tmp_path / "nowhere"), "--target", str(tmp_path / "m"), "--snapshot", "d2").returncode != 0


def test_command_lines(spark, data, tmp_path, monkeypatch):
    """They read their arguments and settings; the session they would make and end is the tests' here."""
    monkeypatch.setattr(common, "main", lambda run, name: run(spark) and 0)
    (tmp_path / "c.json").write_text(json.dumps({"shard_digits": 2}))
    search_index.main(["--source", f"{data}/documents.parquet", "--target", str(tmp_path / "i"), "--config", str(tmp_path / "c.json")])
    site_map.main(["--source", f"{data}/pages.parquet", "--target", str(tmp_path / "m"), "--snapshot", "s", "--config", str(tmp_path / "c.json")])
    for folder in (tmp_path / "i/postings/segment=0", tmp_path / "m/snapshot=s"):
        assert {len(p.name) for p in folder.glob("shard=*")} == {len("shard=") + 2}

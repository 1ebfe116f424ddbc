"""Answers that never end: what they hold back comes out in time, and their state goes."""

from __future__ import annotations

import datetime as dt
import random

from lexmill.plans import streams
from lexmill.streaming import thinking

SCHEMA = "answer_id long, seq long, token string, last boolean, at timestamp"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def batch(spark, folder, rows):
    spark.createDataFrame([(i, k, t, last, at(s)) for i, k, t, last, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, source, target):
    stream = streams.read_stream(spark, str(source))
    before = spark.conf.get(streams._PROVIDER[0])
    spark.conf.set(*streams._PROVIDER)
    try:
        q = thinking.filter_thinking_within(stream, 10_000).writeStream.format("parquet").option("path", f"{target}/out").option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(streams._PROVIDER[0], before)
    rows = spark.read.parquet(f"{target}/out").orderBy("answer_id", "seq").collect()
    found = {}
    for r in rows:
        text, _ = found.get(r["answer_id"], ("", None))
        found[r["answer_id"]] = (text + r["shown"], r["ended"])
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return found, kept[-1] if kept else None


def test_answers_that_never_end(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "t"
    batch(spark, source, [(1, 0, "a<th", False, 0), (2, 0, "b<think>no", False, 0), (3, 0, "c<", False, 8), (4, 0, "d<th", False, 0), (4, 1, "ink>x</think>e", True, 1)])
    found, _ = run(spark, source, target)
    assert found == {1: ("a", None), 2: ("b", None), 3: ("c", None), 4: ("de", "last")}
    # time goes on: 1 and 2 are given up; 3 spoke later and goes on
    batch(spark, source, [(3, 1, "x", False, 12), (5, 0, "", None, 12)])
    found, kept = run(spark, source, target)
    assert found == {1: ("a<th", "timeout"), 2: ("b", "timeout"), 3: ("c<x", None), 4: ("de", "last")}
    # what comes too late for an answer that was given up is not heard
    batch(spark, source, [(1, 1, "late", True, 3), (6, 0, "f", True, 60)])
    found, kept = run(spark, source, target)
    assert found == {1: ("a<th", "timeout"), 2: ("b", "timeout"), 3: ("c<x", "timeout"), 4: ("de", "last"), 5: ("", "timeout"), 6: ("f", "last")}
    assert kept == 0  # no state is left


def test_the_setting_is_put_back(spark, tmp_path):
    before = spark.conf.get(streams._PROVIDER[0])
    batch(spark, tmp_path / "in", [(1, 0, "a", True, 0)])
    got = streams.run_timed(thinking.filter_thinking_within(streams.read_stream(spark, str(tmp_path / "in")), 1000))
    assert [tuple(r) for r in got.collect()] == [(1, 0, "a", "last")] and spark.conf.get(streams._PROVIDER[0]) == before


def test_tokens_are_united_before_they_are_shuffled(spark):
    rows = [(1, 0, "a<th", False, 0), (1, 1, None, None, 0), (1, 2, "ink>é", True, 0), (1, 3, "b", False, 0), (1, 5, "c", False, 0), (2, 6, "d", False, 0), (2, 7, "e", False, 1), (None, 8, "f", False, 1), (None, 9, "", False, 1)]
    df = spark.createDataFrame([(i, k, t, last, at(s)) for i, k, t, last, s in rows], SCHEMA).coalesce(1)
    found = [(r["answer_id"], r["seq"], r["token"], r["last"]) for r in thinking.united(df).collect()]
    assert found == [(1, 2, "a<think>é", True), (1, 3, "b", False), (1, 5, "c", False), (2, 6, "d", False), (2, 7, "e", False), (None, 8, "f", False), (None, 9, "", False)]


def test_united_tokens_let_through_the_same():
    pick = random.Random(7)
    for _ in range(2000):
        text = "".join(pick.choice(["<think>", "</think>", "<th", "</", "<", "x", "ink>"]) for _ in range(pick.randrange(12)))
        buffer, inside, shown = "", False, []
        for k in range(0, len(text), 4):
            through, buffer, inside = thinking.step(buffer, inside, text[k : k + 4])
            shown.append(through)
        assert thinking.step("", False, text) == ("".join(shown), buffer, inside)


def test_a_row_for_what_a_batch_lets_through(spark, tmp_path):
    batch(spark, tmp_path / "in", [(1, k, t, k == 5, 0) for k, t in enumerate(["a<", "thin", "k>no", "</th", "ink>b", "c<"])])
    got = streams.run_timed(thinking.filter_thinking(streams.read_stream(spark, str(tmp_path / "in")).drop("at")))
    assert [tuple(r) for r in got.collect()] == [(1, 5, "abc<")]

"""Exploration against a queue worked off section by section."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import explore, toc
from lexmill.plans import retrieve


def by_hand(todo, target, most):
    """Visits in order: ``target`` has what each known section asks for, None for nothing."""
    todo, seen, sent = list(todo), [], 0
    while todo:
        c = todo.pop(0)
        if c in seen:
            continue
        seen.append(c)
        if target.get(c) and sent < most and target[c] not in seen:
            todo.insert(0, target[c])
            sent += 1
    return seen, sent


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_visits_in_order(spark, most):
    rng = random.Random(most)
    known = {f"c{k}": rng.choice([None, f"c{rng.randrange(9)}", f"c{rng.randrange(14)}"]) for k in range(10)}  # c10 to c13 are not in the index
    asked = {q: [f"c{rng.randrange(12)}" for _ in range(rng.randint(1, 6))] for q in range(60)}
    table = spark.createDataFrame([(k, v) for k, v in known.items()], "chunk_id string, target string")
    calls = []

    def extract(rows):
        calls.append({(r["query_id"], r["chunk_id"]) for r in rows.collect()})
        return rows.join(table, "chunk_id").select("query_id", "query", "chunk_id", F.lit("f").alias("facts"), F.col("target").isNotNull().alias("needs_parent"), "target")

    wanted = spark.createDataFrame([(q, "?", k, c) for q, cs in asked.items() for k, c in enumerate(cs)], "query_id long, query string, rank int, chunk_id string")
    got = {}
    for r in explore.walk(wanted, extract, most).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], len(r["rank"]) > 1, r["facts"]))
    for q, todo in asked.items():
        seen, sent = by_hand(todo, known, most)
        assert [c for c, _, _ in got[q]] == seen and sum(s for _, s, _ in got[q]) == sent
        assert all((f is not None) == (c in known) for c, _, f in got[q])
    assert sum(map(len, calls)) == len(set().union(*calls)) == sum(len(v) for v in got.values())  # each once, and none in vain


def test_sections_without_an_answer_lead_to_their_parents(spark):
    rows = [("a", None, "The zebra is kept here."), ("b", "a", "Nothing of it."), ("c", "b", "Other things. And more."), ("d", None, "No. Not here.")]
    chunks = spark.createDataFrame([(1, k, i, t, i, 1, t, t, p, [], None) for k, (i, p, t) in enumerate(rows)], "doc_id long, pos int, chunk_id string, content string, header string, header_level int, first_sentence string, last_sentence string, parent_id string, children_ids array<string>, source_url string")
    index = toc.build(chunks, spark.createDataFrame([], "chunk_id string, signpost string, core_theme string, key_entities array<string>, questions_answered array<string>"), "s")
    ask = lambda *ids: spark.createDataFrame([(0, "zebra", k, i) for k, i in enumerate(ids)], "query_id long, query string, rank int, chunk_id string")
    found = lambda *ids: tuple(retrieve.explore(ask(*ids), index).first())
    assert found("c") == (0, "From a:\nThe zebra is kept here.", 3, 2)
    assert found("d", "b", "none") == (0, "From a:\nThe zebra is kept here.", 4, 1)
    assert found("d") == (0, retrieve.NOT_FOUND, 1, 0)
    assert retrieve.explore(ask("c"), index, most_parents=1).first()["answer"] == retrieve.NOT_FOUND

"""Signposts by terms of which only some may be broadcast."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexmill import queries as engine
from lexmill.functions import text as X
from lexmill.operators import postings, signposts


def test_how_frequent_terms_must_be(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 3), ("e", 9)], "term string, df long")
    for most, least in ((5, 1), (4, 2), (3, 2), (2, 4), (1, 4), (0, 16)):
        monkeypatch.setattr(signposts, "MOST_BROADCAST", most)
        assert signposts.least_broadcast(df) == least
    assert signposts.least_broadcast(df.filter("false")) == 1


@pytest.mark.parametrize("most", [0, 100])
def test_only_rare_terms_are_joined_by_term(spark, data, monkeypatch, most):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    whole = rows(engine.QUERIES["signposts_by_terms"](spark, data))
    monkeypatch.setattr(signposts, "MOST_BROADCAST", most)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        some = engine.QUERIES["signposts_by_terms"](spark, data)
        plan = some._jdf.queryExecution().executedPlan().toString()
        found = rows(some)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == whole and "BroadcastHashJoin" in plan and "LeftAnti" in plan


def test_tokens_of_a_row_are_found_and_sorted_once(spark):
    """A filter on the runs' size, put under them, would do so for every term of a text."""
    docs = spark.createDataFrame([(1, "b a b"), (2, "")], "doc_id long, text string")
    found = postings.within_rows(docs.select("doc_id", X.tokens(F.col("text")).alias("terms")), "doc_id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") == plan.count("regexp_extract_all(") == 1
    assert sorted(tuple(r) for r in found.collect()) == [(1, 3, "a", 1), (1, 3, "b", 2)]


@pytest.mark.parametrize("name", ["route_by_words", "toc_build", "toc_signposts"])
def test_no_filter_sorts_tokens(spark, data, name):
    plan = engine.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") == 1 and not [x for x in plan.split("\n") if "Filter" in x and "sort_array(" in x]

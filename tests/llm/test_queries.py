"""The registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lexmill.llm import queries as llm
from tests.oracle import compare, connect


def test_all_are_registered():
    names = sorted(llm.queries(), key=lambda n: int(n.split("_")[0][2:]))
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 13)]
    assert set(names) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, data, name):
    table = "pages" if name.startswith("op5") else "documents"
    n = spark.read.parquet(f"{data}/{table}.parquet").count()
    found = entry.queries()[name](spark, data).count()
    assert found >= n if name.startswith("op4") else found == n


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_against_sql(spark, data, name):
    compare(entry.queries()[name](spark, data), connect(data), llm.oracle_sql()[name])


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data).cache()
        n = docs.count()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0.8 * before < n <= before
            before = n
    assert docs.select("doc_id").distinct().count() == before


def test_pipeline_of_awkward_rows(spark, docs, nothing):
    for start in (docs, nothing):
        found = start
        for _, stage in corpus_pipeline.STAGES:
            found = stage(spark, found, "")
        found.count()

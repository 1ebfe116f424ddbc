"""HTML operators hold little at a time, and a page is converted by one worker."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.operators import convert, dom


class Caught:
    """Stands for a DataFrame and gives back the function that it is asked to map."""

    schema = StructType().add("page_id", "long").add("html", "string")

    def select(self, *columns):
        return self

    def mapInArrow(self, f, schema):  # noqa: N802
        return f


def test_results_are_sent_on_in_small_batches(spark):
    n, page = 2000, "<p>" + "word " * 1000 + "</p>"
    run = dom.split(Caught(), ["page_id"])
    rows = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "html": [page, None] * (n // 2)})
    made = list(run(iter([rows])))
    assert max(b.nbytes for b in made) < 2 * dom.BATCH_CHARS
    assert [i for b in made for i in b.column("page_id").to_pylist()] == list(range(n))
    assert [t for b in made for t in b.column("content").to_pylist()] == [page, ""] * (n // 2)


def test_pages_are_converted_by_one_worker(spark):
    texts = ["", None, "<nav>x</nav><h1>Title</h1><p>" + "word " * 40 + "</p>", "".join(f"<div><p>{'many words ' * 30}{k}</p></div>" for k in range(40))]
    pages = spark.createDataFrame(list(enumerate(texts)), "doc_id long, html string")
    splitter = dom.Splitter(max_tokens=300)
    got = convert.convert(pages, splitter=splitter)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    pieces = dom.split(dom.prune(pages, ["doc_id"]), ["doc_id"], "pruned_html", splitter)
    apart = dom.markdown(pieces, ["doc_id", "chunk_index"], "content")
    together = dom.to_pieces(pages, ["doc_id"], "html", None, splitter)
    rows = lambda df: sorted((r["doc_id"], r["chunk_index"], r["markdown"]) for r in df.collect())
    assert rows(together) == rows(apart) and got.agg(F.max("chunks_processed")).first()[0] > 1

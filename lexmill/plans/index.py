"""From pages to an index; what is read several times on the way is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, convert, dom, signposts, toc
from ..operators.completion import Completer
from ..steps import keep


def index_markdown(docs: DataFrame, source_name: str, completer: Completer | None = None, min_chars: int = 100) -> DataFrame:
    """Index of ``doc_id``, ``markdown`` and, if there, ``source_url``.

    Chunks are kept: signposts read them several times, and pages should be converted once.
    """
    chunks = keep(chunking.chunk_markdown(docs, min_chars))
    return toc.build(chunks, signposts.generate(chunks, completer), source_name)


def index_pages(pages: DataFrame, source_name: str, completer: Completer | None = None, min_chars: int = 100, splitter: dom.Splitter | None = None) -> DataFrame:
    """Index of ``page_id``, ``url``, ``html``.  Rows that share an id are documents of their own, each with its URL."""
    named = pages.select("page_id", F.col("url").alias("source_url"), "html")
    made = convert.convert(named, "page_id", "html", completer, splitter=splitter, carry=("source_url",))
    docs = made.select(F.struct("page_id", "row").alias("doc_id"), "markdown", "source_url")  # chunks of rows that share an id stay apart
    return index_markdown(docs, source_name, completer, min_chars).withColumn("doc_id", F.col("doc_id.page_id"))

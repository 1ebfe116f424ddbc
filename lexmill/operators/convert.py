"""HTML pages to clean Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..steps import keep
from . import dom
from .completion import Completer, complete

SYSTEM = "You rewrite HTML as Markdown without leaving out any text. Reply with the Markdown and nothing else."


def convert(pages: DataFrame, key: str = "doc_id", html: str = "html", completer: Completer | None = None, pruner: dom.Pruner | None = None, splitter: dom.Splitter | None = None, prune: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``markdown``, ``original_html_size``, ``markdown_size``, ``chunks_processed``, ``compression_ratio`` of each page.

    With ``carry``, also those columns of the page, which tell rows apart like the key,
    and ``row``, a hash that does so alone.

    Pages are pruned, split at the token limit and converted piece by piece, by
    the given model or by rules; the pieces of a page are joined in order.  Rows
    with one key and different pages give a document each, equal rows one.
    """
    # A row is told by a hash of its key and page: rows of one key stay apart, and equal rows become one document.
    row = F.sha2(F.concat(*[x for c in (key, *carry) for x in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n"))], F.coalesce(html, F.lit(""))), 256)
    kept = [key, *carry, "original_html_size", "_row"]
    rows = pages.select(key, *carry, F.length(html).alias("original_html_size"), row.alias("_row"), F.col(html).alias("html"))
    if completer is None:
        made = dom.to_pieces(rows, kept, "html", pruner, splitter, prune).withColumnRenamed("markdown", "answer")
    else:
        if prune:
            rows = dom.prune(rows, kept, "html", pruner).select(*kept, F.col("pruned_html").alias("html"))
        asked = dom.split(rows, kept, "html", splitter).select(*kept, "chunk_index", F.format_string("HTML:\n%s", "content").alias("prompt"))
        made = keep(complete(asked, completer, SYSTEM)).withColumn("answer", X.strip_fence(F.col("answer")))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "answer")))
    parts = F.filter(parts, lambda x, i: (i == 0) | (x["chunk_index"] != F.element_at(parts, F.greatest(i, F.lit(1)))["chunk_index"]))  # equal rows
    joined = made.groupBy(*kept).agg(F.array_join(F.transform(parts, lambda x: x["answer"]), "\n\n").alias("markdown"), F.count_distinct("chunk_index").cast("int").alias("chunks_processed"))
    clean = joined.withColumn("markdown", X.clean_markdown(F.col("markdown")))
    size = F.length("markdown")
    return clean.select(key, "markdown", "original_html_size", size.alias("markdown_size"), "chunks_processed", F.when(F.col("original_html_size") > 0, size / F.col("original_html_size")).otherwise(0.0).alias("compression_ratio"), *carry, *([F.col("_row").alias("row")] if carry else []))

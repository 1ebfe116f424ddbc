"""Markdown cut at its headers into chunks that know their place in the document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

LEVELS = 6
_MARK, _STAND_IN = "\x01", "﷑"


def chunk_markdown(docs: DataFrame, min_chars: int = 100, with_header: bool = True, also: dict[str, F.Column] | None = None) -> DataFrame:
    """Chunks of ``doc_id``, ``markdown`` and, if there, ``source_url``: the chunk columns with ``doc_id`` and ``pos``.

    A document without headers is one chunk of level 0 and any size.  Otherwise
    chunks shorter than ``min_chars`` are dropped before parents are found.  A
    chunk's parent is the nearest one before it of a smaller level; where ids
    repeat in a document, the last chunk of an id gets the children.

    One shuffle by document finds parents and children; texts are cut by
    built-in expressions only.  What is told of a chunk's ``content``, and more columns
    of it (``also``), is computed before, so a plan that leaves the content out does
    not shuffle it.
    """
    if "source_url" not in docs.columns:
        docs = docs.withColumn("source_url", F.lit(None).cast("string"))
    # Mark each header, then cut at the marks; a mark in the text itself is put aside meanwhile.
    body = F.replace("markdown", F.lit(_MARK), F.lit(_STAND_IN))
    parts = F.split(F.regexp_replace(body, f"(?dmU)^{X.HEADER}$", f"{_MARK}$0"), _MARK)
    cut = docs.select("doc_id", "source_url", F.length("markdown").alias("chars"), F.posexplode(parts).alias("pos", "part"))
    part = F.replace("part", F.lit(_STAND_IN), F.lit(_MARK))
    is_head, whole = F.col("pos") > 0, (F.col("pos") == 0) & (F.length("part") == F.col("chars"))
    start = rf"(?dU)\A{X.HEADER}"
    header = F.when(whole, "Document").when(~is_head, "Preamble").otherwise(X.trimmed(F.regexp_extract(part, start, 2)))
    content = F.when(whole, part).when(is_head & F.lit(not with_header), X.trimmed(F.regexp_replace(part, start, ""))).otherwise(X.trimmed(part))
    rows = (
        cut.select("doc_id", "source_url", "pos", whole.alias("whole"), is_head.alias("is_head"), header.alias("header"), F.when(is_head, F.length(F.regexp_extract(part, start, 1))).otherwise(0).alias("header_level"), content.alias("content"))
        .filter(F.col("whole") | (F.length("content") >= min_chars))
        .withColumns({
            "chunk_id": X.chunk_id(F.when(F.col("whole"), "root").when(~F.col("is_head"), "preamble").otherwise(F.col("header")), F.col("content")),
            "first_sentence": X.first_sentence(F.col("content")),
            "last_sentence": X.last_sentence(F.col("content")),
            "char_count": F.length("content"),
            "word_count": X.word_count(F.col("content")),
            **(also or {}),
        })
    )
    earlier = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last_of = [F.max(F.when(F.col("header_level") == k, F.struct("pos", "chunk_id"))).over(earlier) for k in range(1, LEVELS)]
    parent = F.coalesce(*[F.when(F.col("header_level") == level, F.greatest(*last_of[: level - 1]) if level > 2 else last_of[0]) for level in range(2, LEVELS + 1)])
    placed = rows.withColumn("parent_id", parent["chunk_id"])
    same_id = Window.partitionBy("doc_id", "chunk_id")
    children = placed.filter(F.col("parent_id").isNotNull()).groupBy("doc_id", F.col("parent_id").alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("chunk_id").alias("child")))).alias("found"))
    return (
        placed.withColumn("is_last", F.col("pos") == F.max("pos").over(same_id))
        .join(children, ["doc_id", "chunk_id"], "left")
        .select(
            "doc_id", "pos", "chunk_id", "content", "header", "header_level", "first_sentence", "last_sentence", "parent_id",
            F.when(F.col("is_last") & F.col("found").isNotNull(), F.transform("found", lambda x: x["child"])).otherwise(F.array().cast("array<string>")).alias("children_ids"),
            "source_url", "char_count", "word_count", *(also or {}),
        )
    )

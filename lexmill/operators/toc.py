"""Table of contents: chunks with their signposts, as the index to search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ["chunk_id", "dense_signpost", "first_sentence", "last_sentence", "raw_markdown", "header", "header_level", "parent_id", "children_ids", "source_url", "core_theme", "key_entities", "questions_answered"]


def build(chunks: DataFrame, signposts: DataFrame, source_name: str, at: F.Column | None = None) -> DataFrame:
    """Entries in order of ``seq``: every chunk with its signpost, empty where it has none.

    Where signposts share an id, the last one (by ``seq``, or ``doc_id`` and
    ``pos``) counts.
    """
    order = [c for c in ("seq", "doc_id", "pos") if c in signposts.columns]
    last = signposts.groupBy(F.col("chunk_id").alias("of")).agg(F.max_by(F.struct("signpost", "core_theme", "key_entities", "questions_answered"), F.struct(*order) if order else F.lit(0)).alias("s"))
    none = F.array().cast("array<string>")
    kept = [c for c in ("doc_id", "pos") if c in chunks.columns]
    return chunks.join(last, chunks["chunk_id"] == last["of"], "left").select(
        F.lit(source_name).alias("source_name"), (F.current_timestamp() if at is None else at).alias("created_at"), *kept, "chunk_id",
        F.coalesce("s.signpost", F.lit("")).alias("dense_signpost"), "first_sentence", "last_sentence", F.col("content").alias("raw_markdown"), "header", "header_level", "parent_id", "children_ids", "source_url",
        F.coalesce("s.core_theme", F.lit("")).alias("core_theme"), F.coalesce("s.key_entities", none).alias("key_entities"), F.coalesce("s.questions_answered", none).alias("questions_answered"),
    )


def entries(toc: DataFrame) -> DataFrame:
    """The first entry of every chunk id, in index order."""
    order = Window.partitionBy("chunk_id").orderBy("doc_id", "pos")
    return toc.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def lookup(toc: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries of the ``chunk_id``s in ``ids``."""
    return entries(toc.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi"))


def signposts_only(toc: DataFrame) -> DataFrame:
    return toc.select("chunk_id", F.col("dense_signpost").alias("signpost"), "header")


def parents(toc: DataFrame, ids: DataFrame) -> DataFrame:
    """``child_id`` and the columns of its parent's entry."""
    found = lookup(toc, ids).filter(F.col("parent_id").isNotNull()).select(F.col("chunk_id").alias("child_id"), F.col("parent_id").alias("wanted"))
    return found.join(entries(toc), F.col("wanted") == F.col("chunk_id")).drop("wanted")


def children(toc: DataFrame, ids: DataFrame) -> DataFrame:
    """``of_id``, ``k`` and the columns of each child's entry, in order; ids that lead nowhere are left out."""
    listed = lookup(toc, ids).select(F.col("chunk_id").alias("of_id"), F.posexplode("children_ids").alias("k", "wanted"))
    return listed.join(entries(toc), F.col("wanted") == F.col("chunk_id")).drop("wanted")


def merge(tocs: list[DataFrame], name: str) -> DataFrame:
    """All entries, repeated ids included, under a new name; each index's entries follow those before."""
    out = None
    for k, t in enumerate(tocs):
        t = t.withColumns({"source_name": F.lit(name), "created_at": F.current_timestamp(), "part": F.lit(k)})
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def stats(toc: DataFrame) -> DataFrame:
    """``source_name``, ``entry_count``, ``created_at``."""
    return toc.groupBy("source_name").agg(F.count(F.lit(1)).alias("entry_count"), F.max("created_at").alias("created_at"))

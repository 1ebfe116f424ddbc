"""A BM25 index in tables: postings by term, counts that add up, and searches that read only what they ask for.

Documents are indexed in segments.  A segment is written once; what changes later
is said by later segments: a document that comes again is indexed there, its older
form is listed as replaced, and the segment's counts of terms take the older
form's back.  So the counts of all segments add up to those of the documents that
are there, and no segment is ever rewritten.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bm25

SHARD_DIGITS = 1


def shard(term: F.Column, digits: int = SHARD_DIGITS) -> F.Column:
    """A term's shard: the first hexadecimal digits of its SHA-256."""
    return F.substring(F.sha2(term, 256), 1, digits)


def _runs(terms: DataFrame, *keys: str) -> tuple[DataFrame, F.Column]:
    """``keys`` and ``dl`` of each row, and a column of it: the terms with their ``tf`` in order, as a row's terms are sorted and their runs counted where they are."""
    in_order = terms.select(*keys, F.sort_array("terms").alias("s"), F.size("terms").alias("dl"))
    begins = F.filter(F.sequence(F.lit(0), F.greatest(F.col("dl") - 1, F.lit(0))), lambda i: (i < F.col("dl")) & ((i == 0) | (F.get("s", i) != F.get("s", i - 1))))
    at = in_order.select(*keys, "s", "dl", begins.alias("b"))
    return at, F.transform("b", lambda i, k: F.struct(F.get("s", i).alias("term"), (F.coalesce(F.get("b", k + 1), F.col("dl")) - i).cast("long").alias("tf")))


def _counted(terms: DataFrame, *keys: str) -> DataFrame:
    """``keys``, ``dl`` and ``each``, the terms with their ``tf`` in order."""
    at, each = _runs(terms, *keys)
    return at.select(*keys, "dl", each.alias("each"))


def within_rows(terms: DataFrame, *keys: str) -> DataFrame:
    """``keys``, ``dl``, ``term``, ``tf`` from ``keys``, ``terms``; nothing is shuffled.

    The runs are exploded as an expression: of a column, Spark would first ask for
    its size in a filter on the text, where tokens are found and sorted for every term.
    """
    at, each = _runs(terms, *keys)
    return at.select(*keys, "dl", F.explode(each).alias("x")).select(*keys, "dl", "x.term", "x.tf")


def postings(terms: DataFrame, key: str = "doc_id", digits: int = SHARD_DIGITS) -> DataFrame:
    """``term``, ``key``, ``tf``, ``dl``, ``shard`` from ``key``, ``terms``, a document a row; equal keys stay documents of their own."""
    return within_rows(terms, key).select("term", key, "tf", "dl", shard(F.col("term"), digits).alias("shard"))


def pieces(terms: DataFrame, key: str = "doc_id", digits: int = SHARD_DIGITS) -> DataFrame:
    """What postings() gives, to be shuffled: ``key``, ``dl``, ``shard``, ``words``, ``tfs``, one row for a document's terms of a shard.

    The terms stand in one string, with blanks between them, which tokens do not have:
    half of what rows of single postings take.  of_pieces() makes postings of it.
    """
    tagged = F.transform("each", lambda x: F.struct(shard(x["term"], digits).alias("shard"), x["term"].alias("term"), x["tf"].cast("int").alias("tf")))
    in_order = _counted(terms, key).filter("dl > 0").select(key, "dl", F.sort_array(tagged).alias("s"))
    begins = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i)["shard"] != F.get("s", i - 1)["shard"]))
    at = in_order.select(key, "dl", "s", begins.alias("b"))
    of_shard = F.transform("b", lambda i, k: F.slice("s", i + 1, F.coalesce(F.get("b", k + 1), F.size("s")) - i))
    x = F.col("x")
    return at.select(key, "dl", F.explode(of_shard).alias("x")).select(key, "dl", x[0]["shard"].alias("shard"), F.array_join(x["term"], " ").alias("words"), x["tf"].alias("tfs"))


def of_pieces(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Postings from what pieces() gives, wherever it was sent to; further columns stay."""
    each = F.explode(F.arrays_zip(F.split("words", " ").alias("term"), F.col("tfs").alias("tf"))).alias("x")
    more = [c for c in found.columns if c not in (key, "dl", "shard", "words", "tfs")]
    return found.select("*", each).select("x.term", key, F.col("x.tf").cast("long").alias("tf"), "dl", "shard", *more)


#: Files, at most, that a task has open at once where it writes postings.
MOST_OPEN = 64


@contextmanager
def open_files(spark: SparkSession) -> Iterator[None]:
    """Meanwhile a task that writes partitions keeps their files open in place of sorting its rows by partition."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, MOST_OPEN)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def with_counts(posted: DataFrame, totals: DataFrame, least: int) -> DataFrame:
    """``posted`` with the ``df`` of its term.

    The counts of terms in ``least`` or more documents are broadcast, see
    signposts.least_broadcast(); so only postings of rarer ones are shuffled.
    """
    frequent = F.broadcast(totals.filter(F.col("df") >= least))
    found = posted.join(frequent, "term")
    if least > 1:
        rare = posted.join(frequent.select("term"), "term", "left_anti").join(totals.filter(F.col("df") < least), "term")
        found = found.unionByName(rare)
    return found


def counts(posted: DataFrame, sign: int = 1) -> DataFrame:
    """``term``, ``shard``, ``df``: how many documents have a term, to be added (1) or taken back (-1)."""
    return posted.groupBy("term", "shard").agg((F.lit(sign) * F.count(F.lit(1))).alias("df"))


def added_up(counted: DataFrame) -> DataFrame:
    """Terms that are in some document, over all segments' counts."""
    return counted.groupBy("term", "shard").agg(F.sum("df").alias("df")).filter("df > 0")


def live(posted: DataFrame, replaced: DataFrame, key: str = "doc_id") -> DataFrame:
    """Postings of the forms of documents that nothing has replaced."""
    return posted.join(replaced.select(key, F.col("old_segment").alias("segment")), [key, "segment"], "left_anti")


def statistics(documents: DataFrame, totals: DataFrame) -> DataFrame:
    """One row: ``n`` and ``avgdl`` of the documents (``dl``), and ``mean``, that of all terms' weights before any is replaced."""
    of = documents.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))  # one row
    return of.join(totals.join(F.broadcast(of.select("n")), how="cross").agg(F.avg(_raw()).alias("mean")), how="cross")  # one row each


def _raw() -> F.Column:
    return F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def search(posted: DataFrame, totals: DataFrame, stats: DataFrame, queries: DataFrame, top_k: int = 5, key: str = "doc_id", digits: int = SHARD_DIGITS) -> DataFrame:
    """``query_id``, ``rank``, ``key``, ``score``: as bm25.search(), from an index that is there already.

    The shards of the queries' terms are named in the plan, so other folders are
    not read; there can be no more of them than shards.  Few weights (see
    bm25.MOST_BROADCAST) are broadcast.  Then only postings that are asked for are
    shuffled, once and by document, and of the scores only the best of each task.
    """
    asked = queries.select("query_id", F.explode(bm25.X.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")).withColumn("shard", shard(F.col("term"), digits))
    asked = bm25.keep(asked)
    wanted = [r["shard"] for r in asked.select("shard").distinct().collect()]  # 16 ** digits at most
    few = asked.count() <= bm25.MOST_BROADCAST
    small = F.broadcast if few else lambda x: x
    one = F.broadcast(stats)  # one row
    idf = F.when(_raw() < 0, bm25.EPSILON * F.col("mean")).otherwise(_raw())
    weights = totals.filter(F.col("shard").isin(wanted)).join(small(asked.drop("shard")), "term").join(one, how="cross").select("query_id", "term", "times", idf.alias("idf"))
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("times") * F.col("idf") * tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * dl / F.col("avgdl")))
    found = posted.filter(F.col("shard").isin(wanted)).select("term", key, "tf", "dl")
    if few:
        n_docs, n_queries = stats.select("n").first(), asked.select("query_id").distinct().count()
        found = bm25.by_document(found.join(small(asked.select("term").distinct()), "term", "left_semi"), key, n_docs[0] if n_docs else 0, n_queries)
    found = found.join(small(weights), "term").join(one, how="cross")
    scored = found.groupBy("query_id", key).agg(F.sum(part).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= top_k) & (F.col("score") > 0)).select("query_id", "rank", key, "score")

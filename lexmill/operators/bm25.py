"""BM25 ranking over an index of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..steps import keep

K1, B, EPSILON = 1.5, 0.75, 0.25


def entry_text(toc: DataFrame) -> DataFrame:
    """The searchable text of each entry: its bookends, header, signpost and the beginning of its body."""
    return toc.withColumn("body", F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("first_sentence", "last_sentence", "header", "dense_signpost")], F.substring(F.coalesce("raw_markdown", F.lit("")), 1, 1000)))


def tokenized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``terms`` of each document."""
    return docs.select(key, X.tokens(F.coalesce(text, F.lit(""))).alias("terms"))


def term_counts(terms: DataFrame) -> DataFrame:
    """``term``, ``df`` and, of the one row without a term, the number of documents as ``df`` and of their tokens as ``tokens``.

    One pass; counts are added up in every task before they are shuffled.
    """
    each = terms.select(F.size("terms").alias("dl"), F.explode(F.array_append(F.array_distinct("terms"), F.lit(None).cast("string"))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("tokens"))


def corpus(counts: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length."""
    return counts.filter("term is null").select(F.col("df").alias("n"), (F.col("tokens") / F.col("df")).alias("avgdl"))


def idf(counts: DataFrame, never_negative: bool = False) -> DataFrame:
    """``term`` and ``idf`` of every term.

    Terms in more than half of the documents have a negative one, replaced by a
    share of the mean over all terms; with ``never_negative`` the variant that
    adds one inside the logarithm is used instead.
    """
    df = counts.filter("term is not null").join(F.broadcast(corpus(counts)), how="cross")  # one row
    n = F.col("n")
    if never_negative:
        return df.select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    raw = df.select("term", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.join(F.broadcast(mean), how="cross").select("term", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


#: Rows of queries' terms, at most, that are broadcast.
MOST_BROADCAST = 200_000


#: Scores of a query and a document that a task adds up.
PAIRS_A_TASK = 1_000_000
#: Tasks for that, at most; beyond them a task has more pairs.
MOST_TASKS = 4096


def by_document(rows: DataFrame, key: str, n_docs: int, n_queries: int) -> DataFrame:
    """``rows`` dealt out by document, so that what is made of a document's rows is added up where they are: its scores for all queries are never shuffled."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, -(-n_docs * n_queries // PAIRS_A_TASK)))
    return rows.repartition(n, key)


def prepared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """What searches need of the documents, made once: their terms, and the counts of those."""
    terms = keep(tokenized(docs, key, text))
    return terms, keep(term_counts(terms))


def search(docs: DataFrame, queries: DataFrame, top_k: int = 5, key: str = "doc_id", text: str = "text", never_negative: bool = False, ready: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``key``, ``score`` of the best documents for ``queries`` (``query_id``, ``query``).

    Documents are read twice, to count terms and to score; with ``ready``, what
    prepared() made of them is read instead.  Tokens that no query asks for are
    dropped where they are read, if the queries' terms are few enough to be
    broadcast.  Then documents are shuffled whole, once, and of their scores only the
    best of each task.  Ties go to the smaller key.
    """
    terms = tokenized(docs, key, text) if ready is None else ready[0]
    counts = keep(term_counts(terms)) if ready is None else ready[1]
    asked = queries.select("query_id", F.explode(X.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    weights = keep(asked.join(idf(counts, never_negative), "term"))
    few = weights.count() <= MOST_BROADCAST
    small = F.broadcast if few else lambda x: x
    if few:
        n_docs, n_queries = counts.filter("term is null").agg(F.sum("df")).first()[0], weights.select("query_id").distinct().count()
        dealt = lambda rows: by_document(rows, key, n_docs or 0, n_queries)
        terms = tokenized(dealt(docs.select(key, text)), key, text) if ready is None else dealt(terms)
    tokens = terms.select(key, F.size("terms").alias("dl"), F.explode("terms").alias("term")).join(small(weights.select("term").distinct()), "term", "left_semi")
    posted = tokens.groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    scored = posted.join(small(weights), "term").join(F.broadcast(corpus(counts)), how="cross").groupBy("query_id", key).agg(F.sum(part).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= top_k) & (F.col("score") > 0)).select("query_id", "rank", key, "score")

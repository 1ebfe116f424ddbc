"""Keep a BM25 index of documents up to date: only files that are new are read.

    python -m jobs.search_index --source /data/documents.parquet --target /data/search [--config mine.json] [--ask "what to look for"]

``source`` is a folder of Parquet files with ``doc_id`` and ``text``, to which files
are added.  They are read as a stream that ends with what is there; its checkpoint,
in ``<target>/checkpoint``, remembers the files that have been indexed.  A batch
becomes a segment of the index (lexmill.operators.postings), in ``<target>``:

* ``postings``: ``term``, ``doc_id``, ``tf``, ``dl``, by ``segment`` and ``shard`` of the term
* ``documents``: ``doc_id``, ``dl``, by ``segment``
* ``replaced``: ``doc_id``, ``old_segment``: forms of documents that this segment replaces, by ``segment``
* ``counts``: ``term``, ``df`` to be added, by ``segment`` and ``shard``
* ``statistics``: one row, written by each run that indexed something, by the last ``segment``

Everything of a segment depends on its batch and on earlier segments only, and
replaces that segment's partitions.  So a batch that is repeated after a failure,
wherever it struck, gives the same index, and a run without new files changes nothing.

Documents without an id could never be replaced or found; they are left out and
counted in the log.  Of rows of one id in one batch, the one of the greatest text
counts.  Null and empty texts are documents without terms.
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import bm25, postings, signposts
from lexmill.plans import streams

from . import common

NAME = "search_index"
log = logging.getLogger(f"jobs.{NAME}")
SCHEMAS = {
    "postings": "term string, doc_id long, tf long, dl int, segment long, shard string",
    "documents": "doc_id long, dl int, segment long",
    "replaced": "doc_id long, old_segment long, segment long",
    "counts": "term string, df long, segment long, shard string",
    "statistics": "n long, avgdl double, mean double, segment long",
}


def _table(spark: SparkSession, target: str, name: str) -> DataFrame:
    return common.stored(spark, f"{target}/{name}", SCHEMAS[name])


def _one_a_document(batch: DataFrame) -> DataFrame:
    """Rows with an id, each id once; texts are only shuffled where an id comes twice."""
    rows = batch.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    twice = rows.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if twice.isEmpty():
        return rows
    again = rows.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    return rows.join(twice, "doc_id", "left_anti").unionByName(again)


def index_batch(batch: DataFrame, segment: int, target: str, conf: dict) -> int:
    """Write one segment; how many rows the batch has."""
    found = common.numbers(batch, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("without_id"))
    log.info("batch %d: %s", segment, found)
    spark, digits = batch.sparkSession, conf["shard_digits"]
    write = lambda df, name, *by, unpack=None: common.write_partitions(df.withColumn("segment", F.lit(segment).cast("long")), f"{target}/{name}", ["segment", *by], log, conf["rows_a_file"], *([unpack] if unpack else []))
    read = lambda name: _table(spark, target, name)
    terms = bm25.tokenized(_one_a_document(batch))  # made twice: they take more room than the texts
    write(terms.select("doc_id", F.size("terms").alias("dl")), "documents")
    with postings.open_files(spark):
        write(postings.pieces(terms, digits=digits), "postings", "shard", unpack=postings.of_pieces)
    mine, earlier = F.col("segment") == segment, F.col("segment") < segment
    documents = read("documents")
    again = documents.filter(earlier).join(documents.filter(mine).select("doc_id"), "doc_id", "left_semi")  # first, as few come again
    gone = again.join(read("replaced").filter(earlier).select("doc_id", F.col("old_segment").alias("segment")), ["doc_id", "segment"], "left_anti")
    write(gone.select("doc_id", F.col("segment").alias("old_segment")), "replaced")
    posted, replaced = read("postings"), read("replaced").filter(mine).select("doc_id", F.col("old_segment").alias("segment"))
    change, n_replaced = postings.counts(posted.filter(mine)), replaced.count()
    if n_replaced:  # else the earlier postings need not be read
        change = change.unionByName(postings.counts(posted.filter(earlier).join(replaced, ["doc_id", "segment"], "left_semi"), -1))
    write(change.groupBy("term", "shard").agg(F.sum("df").alias("df")), "counts", "shard")
    written = common.numbers(documents.filter(mine), F.count(F.lit(1)).alias("documents"), F.sum("dl").alias("tokens"))
    log.info("segment %d: %s, %d postings, replacing %d documents", segment, written, posted.filter(mine).count(), n_replaced)
    return found["rows"]


def run(spark: SparkSession, source: str, target: str, conf: dict | None = None) -> DataFrame:
    """Index what is new in ``source``; the index as it then stands, as whole_index() gives it."""
    conf, target = conf or common.settings(NAME), target.rstrip("/")
    before = _table(spark, target, "counts").select(F.length("shard")).first()
    if before and before[0] != conf["shard_digits"]:
        raise ValueError(f"the index has shards of {before[0]} digits, not of {conf['shard_digits']}; index into another folder")
    stream = streams.read_stream(spark, source, conf["files_per_batch"], maxFileAge=conf["longest_delay_of_a_file"])
    rows: list[int] = []
    query = stream.writeStream.foreachBatch(lambda df, k: rows.append(index_batch(df, k, target, conf))).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d rows in %d batches from %s", sum(rows), len(rows), source)
    write_statistics(spark, target, conf)
    return whole_index(spark, target)


def write_statistics(spark: SparkSession, target: str, conf: dict) -> None:
    """Statistics as of the last segment, unless a run has written them; so one that ended early leaves none out."""
    of_last = lambda name: _table(spark, target, name).agg(F.max("segment")).first()[0]
    last = of_last("documents")
    if last is None or last == of_last("statistics"):
        return
    made = postings.statistics(live_documents(spark, target), postings.added_up(_table(spark, target, "counts")))
    common.write_partitions(made.withColumn("segment", F.lit(last).cast("long")), f"{target}/statistics", ["segment"], log, conf["rows_a_file"])


def live_documents(spark: SparkSession, target: str) -> DataFrame:
    return postings.live(_table(spark, target, "documents"), _table(spark, target, "replaced"))


def whole_index(spark: SparkSession, target: str) -> DataFrame:
    """``term``, ``df``, ``doc_id``, ``tf``, ``dl``, ``shard`` of every document that is there."""
    there = postings.live(_table(spark, target, "postings"), _table(spark, target, "replaced"))
    totals = postings.added_up(_table(spark, target, "counts")).select("term", "df")
    return postings.with_counts(there, totals, signposts.least_broadcast(totals)).select("term", "df", "doc_id", "tf", "dl", "shard")


def search(spark: SparkSession, target: str, queries: DataFrame, top_k: int = 5, digits: int = postings.SHARD_DIGITS) -> DataFrame:
    """The best documents of the index for ``queries`` (``query_id``, ``query``); see lexmill.operators.postings.search()."""
    stats = _table(spark, target, "statistics")
    last = stats.agg(F.max_by(F.struct("n", "avgdl", "mean"), "segment").alias("s")).select("s.*")  # one row
    there = postings.live(_table(spark, target, "postings"), _table(spark, target, "replaced"))
    return postings.search(there, postings.added_up(_table(spark, target, "counts")), last, queries, top_k, digits=digits)


def answer(spark: SparkSession, target: str, question: str, conf: dict) -> None:
    """Print the best documents for a question."""
    asked = spark.createDataFrame([(0, question)], "query_id long, query string")
    for r in search(spark, target, asked, digits=conf["shard_digits"]).orderBy("rank").collect():  # five rows
        print(r["rank"], r["doc_id"], round(r["score"], 4), sep="\t")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="search_index", description="Keep a BM25 index of documents up to date.")
    p.add_argument("--source", required=True)
    p.add_argument("--target", required=True)
    p.add_argument("--config", help="a JSON file with settings of your own")
    p.add_argument("--ask", help="then print the best documents for this")
    a = p.parse_args(args)
    conf = common.settings(NAME, a.config)

    def work(spark: SparkSession) -> None:
        run(spark, a.source, a.target, conf)
        if a.ask:
            answer(spark, a.target.rstrip("/"), a.ask, conf)

    return common.main(work, NAME)


if __name__ == "__main__":
    sys.exit(main())

"""A map of the web that was crawled: what links where, what is there twice, what has changed, what to fetch next.

    python -m jobs.site_map --source /data/pages.parquet --target /data/site_map --snapshot 2024-05-01 [--config mine.json]

``source`` has ``page_id``, ``url``, ``html``.  A snapshot is a folder
``<target>/snapshot=<name>`` of a row for every URL, fetched or only linked to, by
``shard`` of its site:

* ``url`` (normalized), ``site``, ``page_id`` of the last page of that URL, or null where none was fetched
* ``content_hash`` and ``same_as``: the least page of equal content, where it is another
* ``n_out``, ``n_in``: pages it links to and pages that link to it, itself left out
* ``inside``: whether a page of its own site links to it
* ``state``: against the last snapshot before by name: ``new``, ``changed``, ``same`` or, of a page that is no longer fetched, ``gone``; ``linked`` if no snapshot has fetched it

URLs to fetch next are those of state ``linked``, most links first.

A run writes its own snapshot and no other, and reads earlier ones only, so it may be
repeated at any time with the same result.  Pages with a null URL have no place in
the map; they are counted in the log.  A page with null html has empty content.
Pages of one URL: the greatest ``page_id`` counts, and of equal ones the greatest hash.
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.functions import urls as L
from lexmill.operators import crawl

from . import common

NAME = "site_map"
log = logging.getLogger(f"jobs.{NAME}")
COLUMNS = "url string, site string, page_id long, content_hash string, same_as long, n_out long, n_in long, inside boolean, state string"
SCHEMA = f"{COLUMNS}, snapshot string, shard string"


def _fetched(pages: DataFrame) -> DataFrame:
    """The last page of each normalized URL: ``url``, ``page_id``, ``content_hash``, ``same_as``; pages are compared by their hashes, html is not shuffled."""
    html = F.coalesce("html", F.lit(""))
    hashed = pages.filter("url is not null").select(L.normalize(F.col("url")).alias("url"), F.col("page_id").cast("long").alias("page_id"), X.content_hash(html).alias("content_hash"))
    last = hashed.groupBy("url").agg(F.max(F.struct("page_id", "content_hash")).alias("p")).select("url", "p.*")
    first = last.groupBy("content_hash").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("content_hash", "first")
    return last.join(first, "content_hash", "left").select("url", "page_id", "content_hash", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("same_as"))


def site_map(pages: DataFrame) -> DataFrame:
    """The columns of the map without ``state``; links are those of all pages of a URL, each counted once."""
    links = crawl.edges(pages.filter("url is not null").select("url", F.coalesce("html", F.lit("")).alias("html"))).distinct().filter("src != dst")
    out = links.groupBy(F.col("src").alias("url")).agg(F.count(F.lit(1)).alias("n_out"))
    into = links.groupBy(F.col("dst").alias("url")).agg(F.count(F.lit(1)).alias("n_in"), F.bool_or(L.same_domain(F.col("src"), F.col("dst"))).alias("inside"))
    zero = F.lit(0).cast("long")
    joined = _fetched(pages).join(out, "url", "left").join(into, "url", "full")
    return joined.select("url", L.authority(F.col("url")).alias("site"), "page_id", "content_hash", "same_as", F.coalesce("n_out", zero).alias("n_out"), F.coalesce("n_in", zero).alias("n_in"), F.coalesce("inside", F.lit(False)).alias("inside"))


def with_state(found: DataFrame, before: DataFrame) -> DataFrame:
    """``found`` with ``state`` against an earlier map, and a row for each URL that has gone since."""
    old = before.filter("page_id is not null").select("url", F.col("content_hash").alias("old_hash"))
    there = F.col("page_id").isNotNull()
    state = F.when(there & F.col("old_hash").isNull(), "new").when(there, F.when(F.col("old_hash") == F.col("content_hash"), "same").otherwise("changed")).when(F.col("old_hash").isNotNull(), "gone").otherwise("linked")
    joined = found.join(old, "url", "full")
    zero = F.lit(0).cast("long")
    filled = joined.withColumns({"site": L.authority(F.col("url")), "n_out": F.coalesce("n_out", zero), "n_in": F.coalesce("n_in", zero), "inside": F.coalesce("inside", F.lit(False))})
    return filled.withColumn("state", state).drop("old_hash")


def snapshots(spark: SparkSession, target: str) -> DataFrame:
    return common.stored(spark, target, SCHEMA)


def run(spark: SparkSession, source: str, target: str, snapshot: str, conf: dict | None = None) -> DataFrame:
    """Write the map of ``source`` as ``snapshot`` and read it again."""
    conf, target = conf or common.settings(NAME), target.rstrip("/")
    pages = spark.read.parquet(source)
    log.info("read %s from %s", common.numbers(pages, F.count(F.lit(1)).alias("pages"), F.count_if(F.col("url").isNull()).alias("without_url")), source)
    known = snapshots(spark, target).filter(F.col("snapshot") < snapshot)
    last = known.agg(F.max("snapshot")).first()[0]
    made = with_state(site_map(pages), known.filter(F.col("snapshot") == last) if last is not None else known.limit(0))
    made = made.withColumn("shard", F.substring(F.sha2("site", 256), 1, conf["shard_digits"]))
    path = f"{target}/snapshot={snapshot}"
    made.hint("rebalance", "shard").write.mode("overwrite").option("maxRecordsPerFile", conf["rows_a_file"]).partitionBy("shard").parquet(path)
    written = spark.read.schema(f"{COLUMNS}, shard string").parquet(path)
    log.info("wrote snapshot %s, after %s: %s", snapshot, last, {r["state"]: r["count"] for r in written.groupBy("state").count().collect()})  # five states
    return written


def to_fetch(written: DataFrame) -> DataFrame:
    """``url``, ``n_in``, ``rank`` in each site: where a crawl of a site goes on, pages that its own pages link to."""
    order = Window.partitionBy("site").orderBy(F.desc("n_in"), "url")
    return written.filter("state = 'linked' and inside").select("site", "url", "n_in", F.row_number().over(order).alias("rank"))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="site_map", description="Map what was crawled.")
    p.add_argument("--source", required=True)
    p.add_argument("--target", required=True)
    p.add_argument("--snapshot", required=True, help="a name that sorts after those of earlier snapshots, such as a date")
    p.add_argument("--config", help="a JSON file with settings of your own")
    a = p.parse_args(args)
    conf = common.settings(NAME, a.config)
    return common.main(lambda spark: run(spark, a.source, a.target, a.snapshot, conf), NAME)


if __name__ == "__main__":
    sys.exit(main())

"""A crawl as a stream that feeds itself.

The frontier is a table of URLs to visit, and a stream reads its files.  A batch
fetches the URLs that are new in it, stores the pages, and writes the links that
nobody has found before to the frontier; so they are the next batch.  The stream
has come to rest when a batch finds nothing new.  A level of the breadth-first
walk is one batch, whatever its size: it is fetched by as many tasks as asked for
and found links are deduplicated by joins, none of them on the driver.

In the crawl's folder:

* ``frontier/found_in=<batch>``: ``url``, ``site``, ``depth``, ``parent_url``, every URL once; seeds in batch -1
* ``pages/batch=<batch>``: the pages fetched, failures included
* ``checkpoint``: which files of the frontier have been visited

A crawl that ended early goes on from there when it is run again.  A batch that was
under way is fetched again and replaces what it had written, so no URL is lost or
visited twice.

URLs are visited at their least depth and, within a level, from the least parent.
Pages that failed (an error, or a status that is no success) are visited and lead
nowhere.  Null URLs are dropped; links of a page without content are none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas
from ..functions import urls as L
from ..operators.crawl import is_success
from ..sources import pages as source

FRONTIER = "url string, site string, depth int, parent_url string"
#: ``asked``, ``site`` and ``parent_url`` of the frontier, and the page as it came.
VISITED = f"asked string, site string, parent_url string, {schemas.PAGE}"

#: Rows of the frontier -> pages, each asked for once.
Fetch = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Rules:
    """How far a crawl goes; ``max_pages`` counts by site (of the seed), in order of depth and URL."""

    max_depth: int = 3
    same_domain: bool = True
    max_pages: int | None = None


def from_web(agent: str = "lexmill", delay_ms: int = 0, parallel: int = 5, timeout: float = source.TIMEOUT, connect_timeout: float = source.CONNECT_TIMEOUT, most: int = source.MOST_BYTES) -> Fetch:
    """Fetch over HTTP, in ``parallel`` tasks that each wait ``delay_ms`` before a page."""
    schema = to_arrow_schema(schemas.struct(VISITED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                source.time.sleep(delay_ms / 1000)
                page = source.fetch(row["url"], agent, timeout, row["depth"], connect_timeout, most)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((row["url"], row["site"], row["parent_url"], *page), schema, strict=True)], schema=schema)

    return lambda rows: rows.repartition(parallel, "url").mapInArrow(run, VISITED)


def from_table(pages: DataFrame) -> Fetch:
    """Fetch from a table of ``url`` (normalized, each once) and ``html``; URLs that it lacks are not found."""
    html = F.coalesce("html", F.lit(""))
    there = pages.select(F.col("url").alias("asked"), html.alias("content"), L.links(html, F.col("url")).alias("found"))

    def fetch(rows: DataFrame) -> DataFrame:
        known = F.col("content").isNotNull()
        joined = rows.withColumnRenamed("url", "asked").join(there, "asked", "left")
        return joined.select(
            "asked", "site", "parent_url", F.col("asked").alias("url"), F.when(known, 200).otherwise(404).alias("status_code"), F.coalesce("content", F.lit("")).alias("content"), F.when(known, "text/html").otherwise("").alias("content_type"),
            F.coalesce(F.length("content"), F.lit(0)).alias("content_length"), F.current_timestamp().alias("crawled_at"), "depth", F.coalesce("found", F.array().cast("array<string>")).alias("links"), F.when(~known, "Not found").alias("error"),
        )

    return fetch


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def frontier(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark, f"{folder}/frontier", f"{FRONTIER}, found_in long")


def visited(spark: SparkSession, folder: str) -> DataFrame:
    """All pages of a crawl, as VISITED and ``batch``."""
    return _stored(spark, f"{folder}/pages", f"{VISITED}, batch long")


def add_seeds(seeds: DataFrame, folder: str) -> None:
    """Put ``url``s into a crawl's frontier that are not there yet."""
    spark = seeds.sparkSession
    fresh = seeds.filter("url is not null").select(L.normalize(F.col("url")).alias("url")).distinct()
    try:
        fresh = fresh.join(frontier(spark, folder).select("url"), "url", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # there is no frontier yet
            raise
    fresh.select("url", L.authority(F.col("url")).alias("site"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url")).write.mode("append").parquet(f"{folder}/frontier/found_in=-1")


def links_to_visit(got: DataFrame, known: DataFrame, rules: Rules) -> DataFrame:
    """The frontier's next rows: links of pages ``got`` that ``known`` lacks, as far as the rules go."""
    good = got.filter(is_success() & (F.col("depth") < rules.max_depth))
    found = good.select(F.explode("links").alias("url"), "site", (F.col("depth") + 1).alias("depth"), F.col("url").alias("parent_url"))
    if rules.same_domain:
        found = found.filter(L.authority(F.col("url")) == F.col("site"))
    least = found.groupBy("url").agg(F.min(F.struct("depth", "parent_url", "site")).alias("x")).select("url", "x.site", "x.depth", "x.parent_url")
    fresh = least.join(known.select("url"), "url", "left_anti")
    if rules.max_pages is None:
        return fresh
    so_far = known.groupBy("site").agg(F.count(F.lit(1)).alias("so_far"))
    order = Window.partitionBy("site").orderBy("depth", "url")
    numbered = fresh.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= rules.max_pages)
    return numbered.join(so_far, "site").filter(F.col("k") + F.col("so_far") <= rules.max_pages).select("url", "site", "depth", "parent_url")


def visit(batch: DataFrame, k: int, folder: str, fetch: Fetch, rules: Rules) -> None:
    """One level: fetch, store, and put what is new into the frontier.

    A batch replaces what it has written before; all that it reads was written by others.
    """
    if batch.isEmpty():  # the last level found nothing
        return
    spark = batch.sparkSession
    fetch(batch.select("url", "site", "depth", "parent_url")).write.mode("overwrite").parquet(f"{folder}/pages/batch={k}")
    got = visited(spark, folder).filter(F.col("batch") == k)
    known = frontier(spark, folder).filter(F.col("found_in") != k)
    links_to_visit(got, known, rules).write.mode("overwrite").parquet(f"{folder}/frontier/found_in={k}")


def crawl(seeds: DataFrame, folder: str, fetch: Fetch, rules: Rules = Rules()) -> DataFrame:
    """Crawl from ``seeds`` (``url``) until nothing new is found; all pages of the folder, as visited() gives them."""
    spark, folder = seeds.sparkSession, folder.rstrip("/")
    add_seeds(seeds, folder)
    stream = spark.readStream.schema(f"{FRONTIER}, found_in long").option("maxFileAge", "3650d").parquet(f"{folder}/frontier")
    query = stream.writeStream.foreachBatch(lambda df, k: visit(df, k, folder, fetch, rules)).option("checkpointLocation", f"{folder}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return visited(spark, folder)

"""Crawl semantics over tables of pages and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as L
from ..steps import keep


def is_success(status: str = "status_code", error: str = "error") -> F.Column:
    return F.col(status).between(200, 299) & F.col(error).isNull()


def is_html(content_type: F.Column) -> F.Column:
    return F.contains(F.lower(content_type), F.lit("text/html"))


def edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``src`` and ``dst``: every page's distinct links, normalized."""
    return pages.select(L.normalize(F.col(url)).alias("src"), F.explode(L.links(F.col(html), F.col(url))).alias("dst"))


def unique_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """Normalized URLs, each once: an exact form of what a Bloom filter estimates."""
    return pages.select(L.normalize(F.col(url)).alias("url")).distinct()


def count_urls(pages: DataFrame, url: str = "url", error: float = 0.01) -> DataFrame:
    """One row: ``n_urls``, distinct normalized URLs, and ``n_urls_about``, the same by a sketch within some relative error."""
    u = L.normalize(F.col(url)).alias("url")
    about = pages.select(u).agg(F.approx_count_distinct("url", error).alias("n_urls_about"))
    return pages.select(u).agg(F.count_distinct("url").alias("n_urls")).join(about, how="cross")  # one row each


def url_sketches(pages: DataFrame, *by: str, url: str = "url", lg_k: int = 14) -> DataFrame:
    """A sketch of the distinct normalized URLs of each part (``by``); ``sketch`` is kept and united later.

    Sketches of parts that were made at different times add up: united_count() of
    them is that of one sketch of all.  With 2^14 registers the relative standard
    error is 0.8 %.  Null URLs are not counted.
    """
    return pages.groupBy(*by).agg(F.hll_sketch_agg(L.normalize(F.col(url)), F.lit(lg_k)).alias("sketch"))


def united_count(sketches: DataFrame, *by: str) -> DataFrame:
    """``n_urls_about`` from the ``sketch`` of several parts."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_urls_about"))


def crawl(links: DataFrame, seeds: DataFrame, max_depth: int = 3, same_domain: bool = True, max_pages: int | None = None, failed: DataFrame | None = None) -> DataFrame:
    """``seed``, ``url``, ``depth``, ``parent_url`` of the pages that a breadth-first crawl visits.

    One join and one anti join a level, and each level is kept, so the work and the
    plans grow with the depth and no more; a URL is visited at its least depth and,
    within a level, by the least parent.  Links are followed only on the seed's
    own domain if ``same_domain``.  ``failed`` (``url``) are visited and not
    expanded.  With ``max_pages`` the first pages by depth and URL are kept.
    """
    level = seeds.select(L.normalize(F.col("url")).alias("seed")).distinct().select("seed", F.col("seed").alias("url"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url"))
    level = seen = keep(level)
    for depth in range(1, max_depth + 1):
        from_pages = level if failed is None else level.join(failed.select("url").distinct(), "url", "left_anti")
        step = from_pages.join(links, from_pages["url"] == links["src"]).select("seed", F.col("dst").alias("url"), F.col("src").alias("parent_url"))
        if same_domain:
            step = step.filter(L.same_domain(F.col("url"), F.col("seed")))
        step = step.groupBy("seed", "url").agg(F.min("parent_url").alias("parent_url"))
        level = keep(step.join(seen.select("seed", "url"), ["seed", "url"], "left_anti").select("seed", "url", F.lit(depth).alias("depth"), "parent_url"))
        seen = seen.unionByName(level)
    if max_pages is not None:
        order = Window.partitionBy("seed").orderBy("depth", "url")
        seen = seen.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= max_pages).drop("_k")
    return seen


def keep_last_of_content(pages: DataFrame, order: str, html: str = "html") -> DataFrame:
    """One row for each distinct content, the last by ``order``, with ``content_hash``: what a store that names files by content keeps."""
    hashed = pages.withColumn("content_hash", X.content_hash(F.col(html)))
    last = Window.partitionBy("content_hash").orderBy(F.desc(order))
    return hashed.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")

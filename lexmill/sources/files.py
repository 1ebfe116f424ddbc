"""Pages, Markdown and indexes in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X
from ..operators.crawl import keep_last_of_content
from ..operators.toc import COLUMNS
from . import texts


def _whole(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))


def read_html(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """``path``, ``name``, ``html``, ``source_url``: pages of a folder, with the URL in their comment."""
    return _whole(spark, path, pattern).select("path", "name", F.col("content").alias("html"), X.page_url(F.col("content")).alias("source_url"))


def read_markdown(spark: SparkSession, path: str, pattern: str = "*.md", source_url: str | None = None) -> DataFrame:
    """``path``, ``name``, ``markdown``, ``source_url``; a URL that is given comes before that in the text."""
    given = F.lit(source_url).cast("string")
    return _whole(spark, path, pattern).select("path", "name", F.col("content").alias("markdown"), X.source_url(F.col("content"), given).alias("source_url"))


def page_files(pages: DataFrame, order: str = "crawled_at", html: str = "content", keep: str = "true") -> DataFrame:
    """``name`` and ``value`` of the files that a crawl stores: named by content, of equal contents the last; of pages that ``keep`` holds for."""
    kept = keep_last_of_content(pages.filter(keep), order, html)
    return kept.select(F.concat("content_hash", F.lit(".html")).alias("name"), F.concat(X.page_header(F.col("url"), F.col("crawled_at"), F.col("depth")), F.col(html)).alias("value"), "content_hash")


def write_pages(pages: DataFrame, path: str, order: str = "crawled_at", html: str = "content", mode: str = "overwrite", keep: str = "true") -> None:
    """Store pages as ``<hash of the content>.html``, with their URL, time and depth in comments."""
    texts.write(page_files(pages, order, html, keep), path, mode)


def markdown_files(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``name`` and ``value`` of files of ``markdown``, named by ``key`` without the ending of a page, with the source in a comment."""
    url = F.col("source_url") if "source_url" in docs.columns else F.lit(None).cast("string")
    stem = F.regexp_replace(F.col(key).cast("string"), r"\.html\z", "")
    return docs.select(F.concat(stem, F.lit(".md")).alias("name"), X.with_source(F.col("markdown"), url).alias("value"))


def write_markdown(docs: DataFrame, path: str, key: str = "doc_id", mode: str = "overwrite") -> None:
    """Store documents as ``<key>.md``."""
    texts.write(markdown_files(docs, key), path, mode)


def toc_documents(toc: DataFrame) -> DataFrame:
    """One row an index: ``version``, ``source_name``, ``created_at``, ``entry_count``, ``entries`` in order."""
    order = [c for c in ("part", "doc_id", "pos") if c in toc.columns]
    listed = F.array_sort(F.collect_list(F.struct(*order, F.struct(*COLUMNS).alias("entry"))))
    grouped = toc.groupBy("source_name").agg(F.max("created_at").alias("created_at"), listed.alias("found"))
    return grouped.select(F.lit("1.0").alias("version"), "source_name", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at"), F.size("found").alias("entry_count"), F.transform("found", lambda x: x["entry"]).alias("entries"))


def toc_files(toc: DataFrame) -> DataFrame:
    """``name`` and ``value`` of an indented JSON file for each index.  A file holds a whole index, so it must fit into a task."""
    docs = toc_documents(toc)
    return docs.select(F.concat("source_name", F.lit(".json")).alias("name"), F.to_json(F.struct(*docs.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))


def write_toc(toc: DataFrame, path: str, indented: bool = True, mode: str = "overwrite") -> None:
    """Store indexes as ``<source>.json``, or not ``indented``, as JSON lines, one an index."""
    if indented:
        texts.write(toc_files(toc), path, mode)
    else:
        toc_documents(toc).write.mode(mode).option("ignoreNullFields", False).json(path)


def read_toc(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the indexes in JSON files: ``source_name``, ``created_at``, ``doc_id``, ``pos`` and the entry's columns.

    A file has one index a line, or one that takes many lines.  Files that are
    not of the format are skipped.
    """
    kinds = schemas.struct(schemas.TOC_FILE).add("_corrupt_record", "string")
    reader = spark.read.schema(kinds).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    read = reader.json(path)
    well = F.col("_corrupt_record").isNull() & F.col("entries").isNotNull()
    told = read.select("version", well.alias("well"), F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.max("well").alias("by_line"))
    indented = [r["file"] for r in told.filter("not by_line").collect()]  # names of files, which the driver lists anyway
    if indented:
        read = read.unionByName(reader.option("multiLine", True).json(indented))
    good = read.filter(well)
    rows = good.select(F.coalesce("version", F.lit("1.0")).alias("version"), "source_name", F.to_timestamp("created_at").alias("created_at"), F.posexplode("entries").alias("pos", "e"))
    return rows.select("version", "source_name", "created_at", F.lit(0).cast("long").alias("doc_id"), "pos", "e.*")

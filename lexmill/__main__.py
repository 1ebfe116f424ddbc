"""Command line: crawl, convert, index, query, serve, pipeline."""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import observe, options, service
from .operators import convert, dom, toc
from .operators.completion import Completer, http_completer
from .plans.index import index_markdown
from .plans.retrieve import retrieve
from .sources import files
from .steps import shared_folder
from .streaming import frontier


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexmill", description=__doc__)
    p.add_argument("--model", action="store_true", help="use the configured language model; else rules stand in")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("crawl", help="fetch pages, breadth first")
    c.add_argument("url")
    c.add_argument("--depth", type=int, default=2)
    c.add_argument("--pages", type=int, default=50)
    c.add_argument("--output")
    c.add_argument("--state", help="folder of the crawl's frontier and pages; given again, the crawl goes on where it was")
    c.add_argument("--js", action="store_true", help="render pages in a browser: not supported, ends with status 2")
    c = sub.add_parser("convert", help="HTML files to Markdown")
    c.add_argument("input")
    c.add_argument("--output")
    c = sub.add_parser("index", help="Markdown to an index")
    c.add_argument("name")
    c.add_argument("--input")
    c.add_argument("--output")
    c = sub.add_parser("query", help="answer a question")
    c.add_argument("question")
    c.add_argument("--index")
    c = sub.add_parser("serve", help="answer questions over HTTP")
    c.add_argument("--host")
    c.add_argument("--port", type=int)
    c = sub.add_parser("pipeline", help="crawl, convert and index")
    c.add_argument("url")
    c.add_argument("--name", default="default")
    c.add_argument("--depth", type=int, default=2)
    c.add_argument("--pages", type=int, default=100)
    return p


def crawl(spark: SparkSession, opts: options.Options, url: str, depth: int, most: int, output: str, state: str | None = None) -> int:
    """Crawl a site and store its pages as files; with ``state``, go on with a crawl that has that folder."""
    folder = state or f"{shared_folder(spark)}/crawl-{uuid.uuid4().hex}"
    fetch = frontier.from_web(opts.user_agent, opts.crawl_delay_ms, opts.max_concurrent_requests)
    with observe.stream_progress(spark, "crawl"):
        got = frontier.crawl(spark.createDataFrame([(url,)], "url string"), folder, fetch, frontier.Rules(depth, True, most))
    watched, seen = observe.watched(got, "pages", pages=F.count(F.lit(1)), failed=F.count("error"), characters=F.sum("content_length"))
    files.write_pages(watched, output, keep="error is null")
    seen.log()
    return got.count()


def stored_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages in HTML files."""
    return files.read_html(spark, path).select(F.col("name").alias("doc_id"), "html")


def run(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    opts = options.load()
    if getattr(a, "js", False):
        print("pages are not rendered in a browser; leave --js out to fetch them as they are", file=sys.stderr)
        return 2
    observe.log_to_console(opts.log_level)
    spark = spark or SparkSession.builder.appName("lexmill").getOrCreate()
    completer: Completer | None = http_completer(opts.llm_base_url, opts.llm_model, opts.llm_api_key, opts.llm_timeout, temperature=opts.llm_temperature, max_tokens=opts.llm_max_tokens) if a.model else None

    def to_markdown(source: str, target: str) -> None:
        found = stored_pages(spark, source).withColumn("source_url", files.X.page_url(F.col("html")))
        files.write_markdown(convert.convert(found, "doc_id", "html", completer, splitter=dom.Splitter(max_tokens=opts.max_tokens_per_chunk), carry=("source_url",)), target)

    def to_index(name: str, source: str, target: str) -> None:
        docs = files.read_markdown(spark, source).withColumn("doc_id", F.xxhash64("name"))
        files.write_toc(index_markdown(docs, name, completer), target)

    def load_index(path: str | None) -> DataFrame | None:
        found = files.read_toc(spark, path or str(opts.index_dir / "*"))
        return None if found.isEmpty() else found if path else toc.merge([found], "merged")

    if a.command == "crawl":
        print(f"{crawl(spark, opts, a.url, a.depth, a.pages, a.output or str(opts.raw_dir), a.state)} pages")
    elif a.command == "convert":
        to_markdown(a.input, a.output or str(opts.markdown_dir))
    elif a.command == "index":
        to_index(a.name, a.input or str(opts.markdown_dir), a.output or str(opts.index_dir / a.name))
    elif a.command == "query":
        index = load_index(a.index)
        if index is None:
            print("no index found", file=sys.stderr)
            return 1
        r = retrieve(spark.createDataFrame([(0, a.question)], "query_id long, query string"), index, completer).first()
        print(r["answer"], f"[{r['layer_used']}]", sep="\n")
    elif a.command == "serve":
        service.serve(service.Service(spark, load_index(None), completer), a.host or opts.api_host, a.port or opts.api_port).serve_forever()
    elif a.command == "pipeline":
        crawl(spark, opts, a.url, a.depth, a.pages, str(opts.raw_dir))
        to_markdown(str(opts.raw_dir), str(opts.markdown_dir))
        to_index(a.name, str(opts.markdown_dir), str(opts.index_dir / a.name))
    return 0


if __name__ == "__main__":
    sys.exit(run())

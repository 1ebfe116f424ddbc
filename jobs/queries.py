"""The jobs as registered queries: each runs twice into a new folder and returns what is there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexmill import queries as engine
from lexmill.steps import shared_folder

from . import search_index, site_map


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _new_folder(spark, "job1")
    search_index.run(spark, f"{sf_dir}/documents.parquet", target)
    return search_index.run(spark, f"{sf_dir}/documents.parquet", target)


def job2_site_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _new_folder(spark, "job2")
    site_map.run(spark, f"{sf_dir}/pages.parquet", target, "2024-01-01")
    return site_map.run(spark, f"{sf_dir}/pages.parquet", target, "2024-01-01")


QUERIES = {f.__name__: f for f in (job1_search_index, job2_site_map)}

SQL = {
    "job1_search_index": f"""WITH t AS (SELECT doc_id, terms, unnest(terms) AS term FROM (SELECT doc_id, {engine.sql_tokens("coalesce(text, '')")} AS terms FROM documents WHERE doc_id IS NOT NULL)),
  posted AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf, len(terms)::INT AS dl FROM t GROUP BY ALL)
  SELECT term, count(*) OVER (PARTITION BY term) AS df, doc_id, tf, dl, substr(sha256(term), 1, 1) AS shard FROM posted""",
    "job2_site_map": f"""WITH last AS MATERIALIZED (SELECT {engine.sql_normal('url')} AS url, max(page_id) AS page_id, max_by(substr(sha256(coalesce(html, '')), 1, 16), (page_id, substr(sha256(coalesce(html, '')), 1, 16))) AS content_hash FROM pages WHERE url IS NOT NULL GROUP BY ALL),
  links AS MATERIALIZED (SELECT DISTINCT src, dst FROM ({engine._SQL_EDGES}) WHERE src <> dst),
  outs AS (SELECT src AS url, count(*) AS n_out FROM links GROUP BY ALL),
  ins AS (SELECT dst AS url, count(*) AS n_in, bool_or({engine.SQL_AUTHORITY.format('src')} = {engine.SQL_AUTHORITY.format('dst')}) AS inside FROM links GROUP BY ALL)
  SELECT url, {engine.SQL_AUTHORITY.format('url')} AS site, page_id, content_hash, nullif(min(page_id) OVER (PARTITION BY coalesce(content_hash, url)), page_id) AS same_as, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, coalesce(inside, false) AS inside,
    CASE WHEN page_id IS NULL THEN 'linked' ELSE 'new' END AS state, substr(sha256({engine.SQL_AUTHORITY.format('url')}), 1, 1) AS shard
  FROM last LEFT JOIN outs USING (url) FULL JOIN ins USING (url)""",
}

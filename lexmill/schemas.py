"""Row types of the engine's files and sources, as Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T

PAGE = "url string, status_code int, content string, content_type string, content_length int, crawled_at timestamp, depth int, links array<string>, error string"
TOC_ENTRY = "chunk_id string, dense_signpost string, first_sentence string, last_sentence string, raw_markdown string, header string, header_level int, parent_id string, children_ids array<string>, source_url string, core_theme string, key_entities array<string>, questions_answered array<string>"
TOC_FILE = f"version string, source_name string, created_at string, entry_count int, entries array<struct<{TOC_ENTRY.replace(' ', ':').replace(',:', ', ')}>>"


def struct(ddl: str) -> T.StructType:
    """A schema of its column list."""
    return T.StructType.fromDDL(ddl)

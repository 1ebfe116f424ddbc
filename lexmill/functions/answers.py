"""Expressions that read a language model's answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, strip_thinking, thinking


def _object(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def lenient_json(c: Column) -> Column:
    """The JSON in an answer as a variant: the whole, a code fence, the widest object, or the widest array; else null."""
    c = strip(c)
    candidates = [c, strip(F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))), _object(c), F.nullif(F.regexp_extract(c, r"(?s)(\[.*\])", 1), F.lit(""))]
    return F.coalesce(*[F.try_parse_json(x) for x in candidates])


def strings_of(variant: Column) -> Column:
    """The strings of a JSON array, other items left out; null if it is no array."""
    items = F.try_variant_get(variant, "$", "array<variant>")
    is_string = lambda v: F.schema_of_variant(v) == "STRING"
    return F.transform(F.filter(items, is_string), lambda v: F.try_variant_get(v, "$", "string"))


def sieved(answer: Column, query: Column) -> Column:
    """``action``, ``queries`` and ``reasoning`` of an answer about a query; the query itself where there are none."""
    data = F.try_parse_json(_object(strip(strip_thinking(answer))))
    asked = F.try_variant_get(data, "$.queries", "array<string>")
    return F.struct(
        F.coalesce(F.try_variant_get(data, "$.action", "string"), F.lit("search")).alias("action"),
        F.when(F.size(F.coalesce(asked, F.array().cast("array<string>"))) > 0, asked).otherwise(F.array(query)).alias("queries"),
        thinking(answer).alias("reasoning"),
    )


def routed(answer: Column) -> Column:
    """Chunk ids in a routing answer."""
    return F.coalesce(strings_of(lenient_json(answer)), F.array().cast("array<string>"))


def extracted(answer: Column, parent: Column) -> Column:
    """``facts``, ``needs_parent`` and ``parent_target`` of an extraction answer."""
    c = strip(answer)
    asks = c.rlike(r"\{\s*\"action\"\s*:\s*\"explore_parent\"") & F.try_parse_json(_object(c)).isNotNull()
    target = F.coalesce(F.try_variant_get(F.try_parse_json(_object(c)), "$.target", "string"), parent)
    return F.struct(
        F.when(asks | F.contains(c, F.lit("NO_RELEVANT_FACTS")), "").otherwise(c).alias("facts"),
        asks.alias("needs_parent"),
        F.when(asks, target).alias("parent_target"),
    )


def content_of(response: Column) -> Column:
    """Text of a raw response: a string, a list of blocks with text, or the old ``text`` field."""
    body = F.coalesce(F.try_variant_get(response, "$.choices[0].message.content", "variant"), F.try_variant_get(response, "$.choices[0].text", "variant"))
    blocks = F.transform(F.try_variant_get(body, "$", "array<variant>"), lambda v: F.coalesce(F.try_variant_get(v, "$.text", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.lit("")))
    return F.when(F.schema_of_variant(body) == "STRING", F.try_variant_get(body, "$", "string")).otherwise(F.array_join(blocks, ""))

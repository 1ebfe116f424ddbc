"""Signposts: a line for each chunk that says what it is about."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..steps import keep
from . import bm25, postings
from .completion import Completer, complete

# Fixed value: the form of a signpost.
SYSTEM = "You label passages. Reply with one line and nothing else, in the form [theme] + [names, separated by commas] + [questions that the passage answers, separated by commas]."


def prompts(chunks: DataFrame) -> DataFrame:
    """``chunks`` with the ``prompt`` for each."""
    template = "Passage titled %s:\n%s\n\nIt begins: %s\nIt ends: %s"
    return chunks.withColumn("prompt", F.format_string(template, "header", F.substring("content", 1, 2000), "first_sentence", "last_sentence"))


def from_answers(answered: DataFrame) -> DataFrame:
    """Signpost rows from ``chunk_id``, ``header`` and ``answer``; answers of another form are put into it."""
    p = X.parse_signpost(X.strip(F.col("answer")))
    rows = answered.withColumn("p", p)
    made = F.when(F.col("p.is_signpost"), X.strip(F.col("answer"))).otherwise(X.format_signpost(F.col("p.core_theme"), F.col("p.key_entities"), F.col("header")))
    keep = [c for c in ("doc_id", "pos") if c in answered.columns]
    return rows.select(*keep, "chunk_id", made.alias("signpost"), "p.core_theme", "p.key_entities", "p.questions_answered").withColumn("token_count", X.signpost_tokens(F.col("signpost")))


def generate(chunks: DataFrame, completer: Completer | None = None, top_terms: int = 3) -> DataFrame:
    """Signposts of all chunks, by the given model or, without one, by term statistics."""
    if completer is not None:
        return from_answers(keep(complete(prompts(chunks), completer, SYSTEM, max_tokens=50)))
    return from_answers(by_terms(chunks, top_terms))


#: Terms, at most, whose counts are broadcast: some 60 MB.
MOST_BROADCAST = 1_000_000


def least_broadcast(df: DataFrame) -> int:
    """The least power of two so that no more than MOST_BROADCAST terms of ``term``, ``df`` have at least that ``df``."""
    power = F.length(F.bin("df")) - 1
    sizes = {r["power"]: r["n"] for r in df.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 64 rows at most
    least, most = max(sizes, default=0) + 1, 0
    while least > 0 and most + sizes.get(least - 1, 0) <= MOST_BROADCAST:
        least -= 1
        most += sizes.get(least, 0)
    return 1 << least


def by_terms(chunks: DataFrame, top_terms: int = 3) -> DataFrame:
    """``answer``: the header as theme and the terms of the highest TF-IDF as entities; a stand-in for a model.

    Terms are counted within a chunk's row.  The most frequent ones, as many as may be
    broadcast, are weighed there, and of those only a chunk's best leave its task.  The
    others, if there are more, are in few chunks each: they alone are joined by term.
    """
    keys = ["doc_id", "pos"]
    terms = chunks.select(*keys, X.tokens(F.col("content")).alias("terms"))
    counts = keep(bm25.term_counts(terms))
    n = counts.filter("term is null").select(F.col("df").alias("n"))  # one row, or none
    df = counts.filter("term is not null")
    weight = F.round(F.col("tf") * F.log(F.col("n") / F.col("df")), 9)
    best = Window.partitionBy(*keys).orderBy(F.desc("weight"), "term")
    least = least_broadcast(df)
    frequent = F.broadcast(df.filter(F.col("df") >= least))

    def leading(found: DataFrame) -> DataFrame:
        weighed = found.join(F.broadcast(n), how="cross").select(*keys, "term", weight.alias("weight"))
        return weighed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_terms)

    top = leading(postings.within_rows(terms, *keys).join(frequent, "term"))
    if least > 1:
        rare = postings.within_rows(terms, *keys).join(frequent, "term", "left_anti").join(df.filter(F.col("df") < least), "term")
        top = top.drop("rank").unionByName(leading(rare).drop("rank")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_terms)
    listed = top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("terms"))
    clean = F.regexp_replace("header", r"[\[\],]", " ")
    return chunks.join(listed, keys, "left").select(*keys, "chunk_id", "header", F.format_string("[%s] + [%s] + [What is %s?]", clean, F.coalesce("terms", clean), clean).alias("answer"))

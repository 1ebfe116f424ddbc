"""The retrieval cascade: sieve, route, explore, and BM25 where routing finds nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as X
from ..operators import bm25
from ..operators.completion import Completer, complete
from ..operators.explore import walk
from ..operators.toc import entries, lookup
from ..steps import keep

SIEVE = "You plan searches over an index. Reply with JSON only, an object with the keys action (the word search, or expand where the question has several parts) and queries (one to three strings to search for)."
ROUTE = "You pick sections from a list by their ids. Reply with JSON only, an array of at most five ids, best first."
# The reply without facts, and the action and its keys that ask for a parent.
EXTRACT = "You copy out what a section says about a question, one statement a line. Reply NO_RELEVANT_FACTS where it says nothing. Where only the enclosing section can tell, reply {\"action\": \"explore_parent\", \"target\": its id}."
SYNTHESIZE = "You answer questions from notes. Use the notes only."
FALLBACK = "You answer questions from one passage. Use the passage only."
# Fixed value: the phrase by which an answer counts as none.
NOT_FOUND = "I could not find relevant information to answer this query."
SIGNPOSTS, ROUTES, CONTEXT, PARENTS = 50, 5, 3000, 2


def sieve(queries: DataFrame, completer: Completer | None = None) -> DataFrame:
    """``query_id``, ``query``, ``action``, ``queries``, ``reasoning``; without a model, the query as it is."""
    rows = queries.select("query_id", "query")
    if completer is None:
        return rows.select("*", F.lit("search").alias("action"), F.array("query").alias("queries"), F.lit("").alias("reasoning"))
    asked = keep(complete(rows.withColumn("prompt", F.format_string("Question:\n%s", "query")), completer, SIEVE, temperature=0.3))
    return asked.withColumn("s", A.sieved(F.coalesce("answer", F.lit("")), F.col("query"))).select("query_id", "query", "s.*")


def visible_signposts(toc: DataFrame, most: int = SIGNPOSTS) -> DataFrame:
    """The first entries of the index, which are all that a routing request shows."""
    return toc.orderBy("doc_id", "pos").limit(most)


def route(subqueries: DataFrame, toc: DataFrame, completer: Completer | None = None, most: int = SIGNPOSTS) -> DataFrame:
    """``query_id``, ``sub``, ``chunk_ids``, ``confidence`` for ``subqueries`` (``query_id``, ``sub``, ``subquery``).

    Only ids that the index has count.  Without a model, the entries whose
    signposts share most words with the query, if any.
    """
    if completer is None:
        return _route_by_words(subqueries, toc, most)
    line = F.format_string("%s | %s | %s", "chunk_id", "header", "dense_signpost")
    shown = visible_signposts(toc, most).select(F.struct("doc_id", "pos", line.alias("line")).alias("x"))
    listed = shown.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("listed"))
    template = "Question:\n%s\n\nSections, each with its id:\n%s"
    prompts = subqueries.join(F.broadcast(listed), how="cross").select("query_id", "sub", F.format_string(template, "subquery", "listed").alias("prompt"))
    asked = keep(complete(prompts, completer, ROUTE)).select("query_id", "sub", A.routed(F.coalesce("answer", F.lit(""))).alias("ids"))
    named = asked.select("query_id", "sub", F.size("ids").alias("n"), F.posexplode_outer("ids").alias("k", "chunk_id"))
    valid = named.join(toc.select("chunk_id").distinct().withColumn("known", F.lit(True)), "chunk_id", "left")
    found = F.transform(F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("k", "chunk_id")))), lambda x: x["chunk_id"])
    return valid.groupBy("query_id", "sub", "n").agg(found.alias("chunk_ids")).select("query_id", "sub", "chunk_ids", F.when(F.col("n") > 0, F.size("chunk_ids") / F.col("n")).otherwise(0.0).alias("confidence"))


def _route_by_words(subqueries: DataFrame, toc: DataFrame, most: int) -> DataFrame:
    shown = visible_signposts(toc, most).select("doc_id", "pos", "chunk_id", F.explode(F.array_distinct(X.tokens(F.col("dense_signpost")))).alias("term"))
    asked = subqueries.select("query_id", "sub", F.explode(F.array_distinct(X.tokens(F.col("subquery")))).alias("term"))
    hits = asked.join(F.broadcast(shown), "term").groupBy("query_id", "sub", "doc_id", "pos", "chunk_id").agg(F.count(F.lit(1)).alias("shared"))  # at most `most` entries
    best = Window.partitionBy("query_id", "sub").orderBy(F.desc("shared"), "doc_id", "pos")
    top = hits.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= ROUTES).groupBy("query_id", "sub").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    none = F.array().cast("array<string>")
    return subqueries.select("query_id", "sub").join(top, ["query_id", "sub"], "left").select("query_id", "sub", F.coalesce("ids", none).alias("chunk_ids"), F.when(F.size(F.coalesce("ids", none)) > 0, 1.0).otherwise(0.0).alias("confidence"))


def _facts_by_words(query: F.Column, content: F.Column) -> F.Column:
    """Sentences that share a word with the query; a stand-in for a model."""
    asked = X.tokens(query)
    sentences = F.transform(F.regexp_extract_all(X.collapse(content), F.lit(r"[^.!?]*[.!?]"), F.lit(0)), X.strip)
    return F.array_join(F.filter(sentences, lambda s: F.arrays_overlap(X.tokens(s), asked)), " ")


#: What sections say about a query and whether they send on to their parent, without a model: columns of the query and of the content.
Rule = Callable[[F.Column, F.Column], tuple[F.Column, F.Column]]


def words_or_parent(query: F.Column, content: F.Column) -> tuple[F.Column, F.Column]:
    """Sentences that share a word with the query; a section without any asks for its parent."""
    facts = _facts_by_words(query, content)
    return facts, facts == ""


def extract(wanted: DataFrame, toc: DataFrame, completer: Completer | None = None, rule: Rule = words_or_parent) -> DataFrame:
    """``query_id``, ``query``, ``chunk_id``, ``facts``, ``needs_parent``, ``target`` for each of ``wanted`` (``query_id``, ``query``, ``chunk_id``) that the index has."""
    rows = wanted.join(lookup(toc, wanted).select("chunk_id", "header", F.nullif("parent_id", F.lit("")).alias("parent_id"), F.substring("raw_markdown", 1, CONTEXT).alias("part")), "chunk_id")
    if completer is None:
        facts, asks = rule(F.col("query"), F.col("part"))
        return rows.select("query_id", "query", "chunk_id", F.when(asks, "").otherwise(facts).alias("facts"), asks.alias("needs_parent"), F.col("parent_id").alias("target"))
    template = "Question:\n%s\n\nSection %s, titled %s, inside of section %s:\n%s"
    prompts = rows.select("query_id", "query", "chunk_id", "parent_id", F.format_string(template, "query", "chunk_id", "header", F.coalesce("parent_id", F.lit("none")), "part").alias("prompt"))
    answered = complete(prompts, completer, EXTRACT).withColumn("e", A.extracted(F.coalesce("answer", F.lit("")), F.col("parent_id")))
    return answered.select("query_id", "query", "chunk_id", "e.facts", "e.needs_parent", F.coalesce(F.nullif("e.parent_target", F.lit("")), "parent_id").alias("target"))


def explore(wanted: DataFrame, toc: DataFrame, completer: Completer | None = None, most_parents: int = PARENTS, rule: Rule = words_or_parent) -> DataFrame:
    """``query_id``, ``answer``, ``chunks_explored``, ``parent_explorations`` for ``wanted`` (``query_id``, ``query``, ``rank``, ``chunk_id``).

    Sections may send on to their parents, ``most_parents`` times a query; see operators.explore.
    """
    visited = walk(wanted, lambda rows: extract(rows, toc, completer, rule), most_parents)
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("facts") != "", F.struct("rank", "chunk_id", "facts")))), lambda x: F.format_string("From %s:\n%s", x["chunk_id"], x["facts"])), "\n\n")
    by_query = visited.groupBy("query_id").agg(F.first("query").alias("query"), F.count(F.lit(1)).cast("int").alias("chunks_explored"), F.count_if(F.size("rank") > 1).cast("int").alias("parent_explorations"), told.alias("told"))
    nothing = X.strip(F.col("told")) == ""
    if completer is None:
        return by_query.select("query_id", F.when(nothing, NOT_FOUND).otherwise(F.col("told")).alias("answer"), "chunks_explored", "parent_explorations")
    prompt = F.when(~nothing, F.format_string("Question:\n%s\n\nNotes:\n%s", "query", "told"))
    asked = keep(complete(by_query.withColumn("prompt", prompt), completer, SYNTHESIZE, temperature=0.3))
    return asked.select("query_id", F.when(nothing, NOT_FOUND).otherwise(X.strip(F.col("answer"))).alias("answer"), "chunks_explored", "parent_explorations")


def prepared(toc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the fallback's search needs of an index, made once for many calls of retrieve()."""
    return bm25.prepared(_searchable(toc), "chunk_id", "body")


def _searchable(toc: DataFrame) -> DataFrame:
    """``chunk_id`` and ``body`` of every entry; bodies are cut before the first entry of an id is looked for, so whole texts are not shuffled."""
    return entries(bm25.entry_text(toc).select("chunk_id", "doc_id", "pos", "body")).select("chunk_id", "body")


def retrieve(queries: DataFrame, toc: DataFrame, completer: Completer | None = None, signposts: int = SIGNPOSTS, ready: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``query_id``, ``query``, ``answer``, ``layer_used``, ``chunks_used``, ``success`` for every query.

    Queries that routing finds sections for are explored; the others, by an anti
    join, fall back to BM25 and are answered from its best entry.  A model's
    answers are kept before they are used, so every prompt is asked once.
    ``ready``: what prepared() made of the index.
    """
    sieved = sieve(queries, completer)
    subs = sieved.select("query_id", F.posexplode("queries").alias("sub", "subquery"))
    routes = keep(route(subs, toc, completer, signposts))
    chosen = routes.select("query_id", "sub", F.posexplode("chunk_ids").alias("k", "chunk_id")).groupBy("query_id", "chunk_id").agg(F.min(F.struct("sub", "k")).alias("at"))
    ranked = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).select("query_id", "rank", "chunk_id")
    wanted = ranked.join(queries.select("query_id", "query"), "query_id")
    explored = explore(wanted.select("query_id", "query", "rank", "chunk_id"), toc, completer).select("query_id", "answer", F.lit("explorer").alias("layer_used"), F.col("chunks_explored").alias("chunks_used"))
    missed = queries.select("query_id", "query").join(ranked, "query_id", "left_anti")
    if missed.isEmpty():  # the whole index is searched for those alone
        return _results(queries, explored)
    best = keep(bm25.search(_searchable(toc), missed, 1, "chunk_id", "body", ready=ready).select("query_id", "chunk_id"))
    context = missed.join(best, "query_id", "left").join(lookup(toc, best).select("chunk_id", F.substring("raw_markdown", 1, CONTEXT).alias("context")), "chunk_id", "left")
    if completer is None:
        answer = F.when(F.col("context").isNull(), NOT_FOUND).otherwise(F.coalesce(F.nullif(_facts_by_words(F.col("query"), F.col("context")), F.lit("")), F.lit(NOT_FOUND)))
        fallen = context.select("query_id", answer.alias("answer"))
    else:
        prompt = F.when(F.col("context").isNotNull(), F.format_string("Question:\n%s\n\nPassage:\n%s", "query", "context"))
        asked = keep(complete(context.withColumn("prompt", prompt), completer, FALLBACK))
        fallen = asked.select("query_id", F.when(F.col("context").isNull(), NOT_FOUND).otherwise(X.strip(F.col("answer"))).alias("answer"))
    fallen = fallen.select("query_id", "answer", F.lit("bm25_fallback").alias("layer_used"), F.lit(0).alias("chunks_used"))
    return _results(queries, explored.unionByName(fallen))


def _results(queries: DataFrame, answered: DataFrame) -> DataFrame:
    return queries.select("query_id", "query").join(answered, "query_id").withColumn("success", X.is_answer(F.coalesce("answer", F.lit(""))))


def characters(answers: DataFrame) -> DataFrame:
    """``query_id``, ``k``, ``char``: answers character by character, for clients that read a stream."""
    return answers.select("query_id", F.posexplode(F.split("answer", "")).alias("k", "char")).filter("char <> ''")

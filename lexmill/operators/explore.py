"""Exploration of sections, some of which send the reader on to the section around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..steps import keep

#: ``query_id``, ``query``, ``chunk_id`` -> those that the index has, with ``facts``, ``needs_parent``, ``target``
Extract = Callable[[DataFrame], DataFrame]


def walk(wanted: DataFrame, extract: Extract, most_parents: int = 2) -> DataFrame:
    """``query_id``, ``query``, ``rank``, ``chunk_id``, ``facts``, ``needs_parent``, ``target`` of every section that a query visits.

    ``wanted`` (``query_id``, ``query``, ``rank``, ``chunk_id``) is visited by rank.  A
    section that needs its parent names it as ``target``; it is visited next, before
    the sections that still wait, unless it was visited already or the query has been
    sent on ``most_parents`` times.  A section that waits and has been visited as a
    parent is not visited again.  A section that the index lacks is visited and has
    no ``facts`` (null).

    ``rank`` is an array, and a parent's is that of who asked with a 0 behind it, so
    arrays in order are visits in order.  Each hop finds, for all queries at once, the
    first section that may still ask: joins and aggregates by query, a fixed number of
    hops.  Every section is extracted once a query, and none that is not visited.
    """
    visits = wanted.groupBy("query_id", "chunk_id").agg(F.min(F.struct(F.array("rank").alias("rank"), "query")).alias("x")).select("query_id", "chunk_id", "x.*")
    visits = keep(visits)
    known = keep(extract(visits.select("query_id", "query", "chunk_id")))
    granted = None
    for _ in range(most_parents):
        asks = visits.join(known.filter("needs_parent and target is not null").select("query_id", "chunk_id", "target"), ["query_id", "chunk_id"])
        if granted is not None:  # asks are answered in order
            asks = asks.join(granted, "query_id", "left").filter(F.col("last").isNull() | (F.col("rank") > F.col("last")))
        before = visits.select(F.col("query_id").alias("of"), F.col("chunk_id").alias("seen"), F.col("rank").alias("seen_at"))
        fresh = asks.join(before, (F.col("query_id") == F.col("of")) & (F.col("target") == F.col("seen")) & (F.col("seen_at") <= F.col("rank")), "left_anti")
        first = keep(fresh.groupBy("query_id").agg(F.min_by(F.struct("query", "rank", "target"), "rank").alias("x")).select("query_id", "x.*"))
        if first.isEmpty():
            break
        sent = first.select("query_id", F.col("target").alias("chunk_id"), F.concat("rank", F.array(F.lit(0))).alias("rank"), "query")
        new = sent.join(visits, ["query_id", "chunk_id"], "left_anti")
        known = known.unionByName(keep(extract(new.select("query_id", "query", "chunk_id"))))
        visits = keep(visits.unionByName(sent).groupBy("query_id", "chunk_id").agg(F.min(F.struct("rank", "query")).alias("x")).select("query_id", "chunk_id", "x.*"))
        last = first.select("query_id", F.col("rank").alias("last"))
        granted = last if granted is None else granted.join(last.withColumnRenamed("last", "later"), "query_id", "left").select("query_id", F.coalesce("later", "last").alias("last"))
    return visits.join(known.select("query_id", "chunk_id", "facts", "needs_parent", "target"), ["query_id", "chunk_id"], "left").select("query_id", "query", "rank", "chunk_id", "facts", "needs_parent", "target")

"""Importance resampling towards a target distribution, over hashed n-grams.

A text's features are its words and its pairs of neighbouring words; each is
hashed into one of a fixed number of buckets.  A bucket's gain is the logarithm
of how much more often the target's texts use it than the corpus, and a
document's weight is the mean gain of its features.  Gumbel noise made from the
document's id is added, so that taking the highest scores draws documents
without replacement, each in proportion to the exponential of its weight.

* Texts are read once.  Higher-order functions turn a text into the array of its
  buckets, which is stored; no feature ever becomes a row of a shuffle.
* The counts of buckets are added up in every task; only those totals, one row a
  bucket, are shuffled and reach the driver: as many numbers as there are buckets.
* Scores come from ``element_at`` of a literal array of the gains, inside the row.
* Scores are whole numbers within some 100,000 of each other (logarithms of
  counts), so a table of how many documents have each is bounded; it gives the
  score at which the draw ends.  Only rows at or over it are sorted, by ranges,
  which split however many rows are alike; a rank is the rows of the ranges before
  and the place in the range.

Null and empty texts have no features and weigh 0.  A null id is hashed as the
empty string and comes after other ids in ties.  Repeated rows are rows like
others, each with a rank of its own.  An empty target, corpus or table gives
gains, and rows, by the same formulas.  A very long text is one array in one
task.  Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, parts_for, step, store

BUCKETS = 10_000
#: What parts words, once A-Z are lower-case.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of a range that is sorted in one task, about.
ROWS_A_RANGE = 500_000


def words(text: F.Column) -> F.Column:
    return F.filter(F.split(F.translate(text, UPPER, UPPER.lower()), SEPARATOR), lambda w: w != "")


def _bucket(feature: F.Column, buckets: int) -> F.Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucketed(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id``, ``n_words`` and ``buckets``, those of words and then of pairs of words."""
    w = docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("w"))
    pairs = F.greatest(F.size("w") - 1, F.lit(0))
    of_pairs = F.zip_with(F.slice("w", F.lit(1), pairs), F.slice("w", F.lit(2), pairs), lambda a, b: _bucket(F.concat(a, F.lit(" "), b), buckets))
    return w.select("doc_id", F.size("w").alias("n_words"), F.concat(F.transform("w", lambda x: _bucket(x, buckets)), of_pairs).alias("buckets"))


def totals(rows: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How many features fall into each bucket."""
    with step(rows.sparkSession):
        found = rows.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a bucket
    out = [0] * buckets
    for b, n in found:
        out[b] = n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousands of natural logarithms of the target's smoothed share over the corpus's, rounded down."""
    k, of, to = len(corpus), float(sum(corpus)), float(sum(target))
    return [math.floor(1000 * math.log(((t + 1) * (of + k)) / ((s + 1) * (to + k)))) for s, t in zip(corpus, target, strict=True)]


def scored(rows: DataFrame, gain: list[int], seed: int) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score``."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded into one literal
    n = F.size("buckets").cast("long")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b + 1))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    with_total = rows.select("doc_id", "n_words", n.alias("n_features"), total.alias("total"), noise.alias("noise"))
    weight = F.expr("if(n_features = 0, 0L, (total - pmod(total, n_features)) div n_features)")
    return with_total.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + F.col("noise")).alias("score"))


def _last_score(eligible: DataFrame, percent: int) -> tuple[int, int | None]:
    """How many documents are drawn, and the least score among them."""
    by_score = eligible.groupBy("score").agg(F.count(F.lit(1)).alias("n"))  # bounded, see above
    down = Window.orderBy(F.desc("score"))
    sums = by_score.select("score", F.sum("n").over(down).alias("until"), F.sum("n").over(Window.partitionBy()).alias("of"))
    quota = F.expr(f"(of * {percent}L) div 100L")
    found = sums.agg(F.first(quota).alias("quota"), F.max(F.when(F.col("until") >= quota, F.col("score"))).alias("last")).first()
    return found["quota"] or 0, found["last"]


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score``, ``rank`` of every document; those not drawn have no rank.

    Drawn is the given share of the documents of at least ``least_words`` words,
    those of the highest scores, ties to smaller ids.
    """
    made = store(bucketed(docs, buckets))
    gain = gains(totals(made, buckets), totals(bucketed(target.select(F.lit(None).alias("doc_id"), "text"), buckets), buckets))
    rows = store(scored(made, gain, seed))
    drop_stored(made)
    enough = F.col("n_words") >= least_words
    with step(rows.sparkSession):
        drawn, last = _last_score(rows.filter(enough), percent)
    kept = ["doc_id", "n_features", "weight", "score"]
    within = enough & (F.col("score") >= last) if drawn else F.lit(False)
    # Rows at or over the last score, in order: ranges by score, id and, for rows alike, the place in the stored table.
    spread = F.xxhash64("_metadata.file_name", "_metadata.row_index")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("spread")]
    sorted_ = rows.filter(within).select(*kept, spread.alias("spread")).repartitionByRange(parts_for(drawn, ROWS_A_RANGE), *order).sortWithinPartitions(*order)
    placed = store(sorted_.select(*kept, F.monotonically_increasing_id().alias("place")))
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # one row a range
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("at") + 1
    ranked = placed.select(*kept, part.alias("part"), at.alias("at")).join(F.broadcast(before), "part").select(*kept, F.when(rank <= drawn, rank).alias("rank"))
    return ranked.unionByName(rows.filter(~within).select(*kept, F.lit(None).cast("long").alias("rank")))

"""Proportional stratified interleaving of rows into shards.

Within each source, rows are put in a seeded random order and ranked; a row's
fractional rank is (rank + phase) / rows of its source.  All rows in order of
fractional rank are cut into shards of equal row counts, so each shard holds
its proportion of every source, within one row.  The phase, a hash of the
source, keeps many tiny sources from all asking for the same place.

Built from DataFrame operations only.  No window spans a source or the table:
rows are ranked inside buckets of a bounded size (of the hash order, then of the
fractional rank), and the buckets' offsets come from running sums over the
small tables of their counts.  So a source may hold any share of the rows.

Null ids, sources and texts are values like others (a null source is a source).
Repeated rows each get a slot.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts_for


def _running(counts: DataFrame, within: list[str], order: str, total: str = "n") -> DataFrame:
    """``before``: the running sum of ``total`` over earlier ``order`` values."""
    w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum(total).over(w), F.lit(0).cast("long")))


def interleave(docs: DataFrame, shards: int, seed: int = 17, rows_per_bucket: int = 20_000) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``; the law is ``rows``."""
    n = docs.select(F.count(F.lit(1))).first()[0]
    buckets = parts_for(n, rows_per_bucket, 64)
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))).alias("stratum"),
        (F.octet_length(body) + F.lit(16)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(F.lit(seed), "doc_id").alias("key"),
    ).withColumn("bucket", F.pmod("key", F.lit(buckets)))

    strata = cut(docs.select(
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))).alias("stratum"),
        F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(buckets)).alias("bucket"),
    ).groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n")))
    sums = _running(strata, ["stratum"], "bucket").withColumn("of", F.sum("n").over(Window.partitionBy("stratum")))
    inner = Window.partitionBy("stratum", "bucket").orderBy("key", "doc_id", "text_crc32", "size")
    phase = F.pmod(F.xxhash64(F.lit(seed), F.lit("phase"), "stratum"), F.lit(1 << 20)) / F.lit(1 << 20)
    ranked = cut(
        rows.join(sums.drop("n"), ["stratum", "bucket"])
        .withColumn("rank", F.col("before") + F.row_number().over(inner) - 1)
        .withColumn("fraction", (F.col("rank") + phase) / F.col("of"))
        .select("doc_id", "size", "text_crc32", "stratum", "fraction", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)).alias("cell"))
    )
    cells = _running(ranked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), [], "cell").drop("n")
    order = Window.partitionBy("cell").orderBy("fraction", "stratum", "doc_id", "text_crc32", "size")
    place = F.col("before") + F.row_number().over(order) - 1
    # Integer arithmetic, so shards differ by one row at most.
    shard = F.expr(f"cast((place * {shards}L) div {max(n, 1)}L as int)")
    first = F.expr(f"((shard * {n}L) + {shards - 1}L) div {shards}L")
    return (
        ranked.join(cells, "cell")
        .withColumn("place", place)
        .withColumn("shard", shard)
        .withColumn("slot", F.col("place") - first)
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.when(F.col("stratum") != "n", F.substring("stratum", 2, 1 << 30)).alias("source"))
    )

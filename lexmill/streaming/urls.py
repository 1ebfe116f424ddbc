"""URLs of a stream, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as L


def unique(stream: DataFrame, url: str = "url", time: str | None = None, within: str = "1 day") -> DataFrame:
    """Rows of URLs not seen before, normalized, across batches.

    With an event time, state is kept for the time ``within`` which repeats are
    looked for; without one it grows with the number of URLs.
    """
    rows = stream.withColumn(url, L.normalize(F.col(url)))
    if time is None:
        return rows.dropDuplicates([url])
    return rows.withWatermark(time, within).dropDuplicatesWithinWatermark([url])


def discovered(stream: DataFrame, same_domain_as: str | None = None) -> DataFrame:
    """``url``, ``depth``, ``parent_url``: links that a stream of pages (``url``, ``content``, ``depth``) leads to, each once."""
    rows = stream.select(L.normalize(F.col("url")).alias("parent_url"), (F.col("depth") + 1).alias("depth"), F.explode(L.links(F.col("content"), F.col("url"))).alias("url"))
    if same_domain_as is not None:
        rows = rows.filter(L.same_domain(F.col("url"), F.lit(same_domain_as)))
    return rows.dropDuplicates(["url"])

"""Connected components of a graph of links, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, spread_join, step, store


#: So few links may meet in one task.
FEW_LINKS = 100_000


def _state(links: DataFrame) -> tuple:
    with step(links.sparkSession):
        return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _with_least(links: DataFrame, total: int) -> DataFrame:
    """``links`` with ``m``, the least neighbour of ``a`` or ``a`` itself; no node's neighbours are gathered."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n")).select("a", F.least("a", "m").alias("m"), "_n")
    joined = spread_join(links, store(least), "a", "_n", total) if total > FEW_LINKS else links.join(least, "a")
    return joined.select("a", "b", "m")


def _few(links: DataFrame) -> DataFrame:
    """components() of at most FEW_LINKS links: one task keeps each node's parent, a lesser node of its component."""
    kind = links.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):  # noqa: ANN001, ANN202
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for b in batches:
            for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = map(root, pair)
                parent[max(x, y)] = min(x, y)
            of = b.schema.field(0).type
        if parent:
            yield pa.RecordBatch.from_arrays([pa.array(list(parent), of), pa.array([root(x) for x in list(parent)], of)], ["node", "root"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, from links ``a``, ``b``.

    Large-star and small-star steps alternate until nothing changes.  A step
    aggregates the least neighbour of each node (partially before the shuffle)
    and joins it back; the links of a node that has many stay where they are.
    The number of links never grows.  Few links are joined up in one task, with the
    same result: each step costs several exchanges, however little there is to do.
    """
    links = store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    before = _state(links)
    if before[0] <= FEW_LINKS:
        return _few(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours link to the least
        larger = _with_least(both, 2 * before[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        larger = store(larger)  # else the plan of the next step holds several copies of this one
        # small star: smaller neighbours and the node itself link to the least
        joined = _with_least(larger, before[0])
        made = store(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).filter("a != b").distinct())
        drop_stored(links, larger)
        links, after = made, _state(made)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def extended(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of what ``labels`` (``node``, ``root``) already joins and of new ``links``; stored.

    Only the roots that new links join are looked at again.
    """
    if labels is None:
        return store(components(links))
    root_of = lambda x: labels.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    between = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    moved = store(components(between))
    to = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
    out = store(labels.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")).unionByName(moved.join(labels, "node", "left_anti")))
    drop_stored(moved, labels)
    return out

"""SimHash near-duplicates, linked through pigeonring filtering.

**Fingerprints.**  A text's words (parted by white space, A-Z in lower case) give
its shingles of four words, repeats included, or one shingle of all words where
there are fewer.  Each is hashed to 64 bits; a bit of the fingerprint is 1 if it
is set in over half of the hashes.  A text without words has fingerprint zero.

**Links.**  Fingerprints link where at most ``most`` (4) bits differ.  The 64 bits
are cut into ``most + 1`` segments that form a ring.  If two fingerprints differ
in no more than ``most`` bits, then from at least one segment on, *every* chain of
consecutive segments, of length l = 1, 2, ..., differs in at most
``l * most / (most + 1)`` bits, rounded down: 0, 1, 2, 3, 4.  So

* for each start, the first segment and one of the two halves of the second must
  be equal.  Those bits are the keys under which fingerprints meet, ten each;
* within a key, pairs must keep to the budgets of the chains of two, three and
  four segments, and what is left gets the full Hamming check, which is the budget
  of the whole ring.

Exact copies are one fingerprint before any of this, whatever their number.  Under
a key, rows come as a sorted stream and no pairs are listed: a search from
fingerprint to fingerprint takes those that it reaches out of the rows still to
be compared, and gives one link for each.  A key with more fingerprints than a
block holds is dealt out by hash, and each pair of blocks is a group of its own;
so every two fingerprints still meet, and no task holds more than two blocks.

**Components** of the links are found by large and small stars (graph.py), on
fingerprints alone.

Null and empty texts have fingerprint zero and are linked like any other.  Null
ids are never the least id; a component with no other id has a null
``component_id``.  Repeated rows and ids give a row each.  An empty table gives an
empty table.  A very long text takes memory of a few times its size in one task.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import drop_stored, parts_for, spread_join, step, store

SHINGLE, SEED, MOST = 4, 42, 4
#: Fingerprints in a block of a key, and shingles hashed at a time.
BLOCK, HASHED_AT_ONCE = 2048, 1 << 14
#: Texts and their characters that are Python objects at a time.
TEXTS = 200


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text in UTF-8."""
    words = text.lower().split()  # of bytes: A-Z only, and white space of ASCII
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    ends = ends[min(shingle, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    for k in range(0, n, HASHED_AT_ONCE):
        spans = zip(starts[k : min(n, k + HASHED_AT_ONCE)].tolist(), ends[k : k + HASHED_AT_ONCE].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(body[a:b], seed) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                made = np.array([fingerprint(x.as_py() or b"") for x in part.column(1)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def ring(most: int = MOST) -> list[tuple[int, int]]:
    """First bit and number of bits of each segment."""
    n = most + 1
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _mask(first: int, bits: int) -> int:
    return ((1 << bits) - 1) << first


def chain_masks(start: int, most: int = MOST) -> list[int]:
    """Bits of the chains of 1, 2, ... segments from ``start`` on."""
    segments, out = ring(most), [0]
    for k in range(len(segments)):
        out.append(out[-1] | _mask(*segments[(start + k) % len(segments)]))
    return out[1:]


def key_masks(most: int = MOST) -> list[tuple[int, int]]:
    """Start, and bits that must be equal: a segment and half of the next."""
    segments, out = ring(most), []
    for start, (first, bits) in enumerate(segments):
        nfirst, nbits = segments[(start + 1) % len(segments)]
        out += [(start, _mask(first, bits) | _mask(nfirst, nbits // 2)), (start, _mask(first, bits) | _mask(nfirst + nbits // 2, nbits - nbits // 2))]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """``which``, ``bits``, ``fp``: every fingerprint under each of its keys."""
    masks = F.array(*[F.lit(_signed(m)) for _, m in key_masks(most)])
    return distinct.select("fp", F.posexplode(masks).alias("which", "m")).select(F.col("which").cast("byte").alias("which"), F.col("fp").bitwiseAND(F.col("m")).alias("bits"), "fp")


def grouped(keys: DataFrame, total: int, block: int = BLOCK) -> DataFrame:
    """Rows (``total`` in all) of keys that several fingerprints have, with ``pair``: the two blocks that meet, 0 where the key has one block."""
    counts = keys.groupBy("which", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    of = spread_join(keys, counts, ["which", "bits"], "n", total)
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = of.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    # a block meets each other one; with two or more, its own rows meet on the way
    met = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.filter(other, lambda o: o != F.col("mine")), lambda o: F.least(o, F.col("mine")).cast("long") * F.col("blocks") + F.greatest(o, F.col("mine")))
    )
    return dealt.select("which", "bits", "fp", F.explode(met).alias("pair"))


def links_of(fps: np.ndarray, start: int, most: int = MOST) -> list[tuple[int, int]]:
    """Links that join what hangs together among distinct fingerprints, by chains from ``start`` on; no others."""
    masks = [(np.uint64(m), most * k // (most + 1)) for k, m in enumerate(chain_masks(start, most), 1)][1:]
    left, found = fps, []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            apart = left ^ at
            near = np.arange(len(left))
            for mask, budget in masks:  # the last is the whole of the bits
                near = near[np.bitwise_count(apart[near] & mask) <= budget]
                if not len(near):
                    break
            if len(near):
                found += [(int(at), int(x)) for x in left[near]]
                todo += list(left[near])
                left = np.delete(left, near)
    return found


def links(distinct: DataFrame, n: int, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """``a``, ``b``: links that join all fingerprints (``fp``, each once) within ``most`` bits of each other, over other links."""
    total = n * len(key_masks(most))
    rows = grouped(keyed(distinct, most), total, block)
    parts = parts_for(total, 1_000_000, 12)
    met = rows.repartition(parts, "which", "bits", "pair").sortWithinPartitions("which", "bits", "pair", "fp")
    starts = [start for start, _ in key_masks(most)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_group(which: int, fps: np.ndarray) -> list[tuple[int, int]]:
            return links_of(np.unique(fps).view(np.uint64), starts[which], most)

        held: list[tuple[tuple, np.ndarray]] = []  # the group that may go on in the next batch: at most two blocks
        for batch in batches:
            which, bits, pair, fp = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("which", "bits", "pair", "fp"))
            new = (which[1:] != which[:-1]) | (bits[1:] != bits[:-1]) | (pair[1:] != pair[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(fp)] if len(fp) else []
            found: list[tuple[int, int]] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                group = (which[a], bits[a], pair[a])
                if held and held[0][0] != group:
                    found += of_group(held[0][0][0], np.concatenate([x for _, x in held]))
                    held = []
                held.append((group, fp[a:b]))
            if found:
                yield _links(found)
        if held:
            yield _links(of_group(held[0][0][0], np.concatenate([x for _, x in held])))

    return met.mapInArrow(run, "a long, b long")


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def components_of(docs: DataFrame, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the least id that links lead to, of every document."""
    prints = store(fingerprints(docs))
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    with step(docs.sparkSession):
        n, total = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    roots = store(graph.components(store(links(distinct.select("fp"), n, most, block))))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_prints"))
    facts = store(spread_join(placed, ids, "root", "n_prints", n).select("fp", "copies", "component_id"))
    drop_stored(distinct, roots)
    found = spread_join(prints, facts, "fp", "copies", total)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

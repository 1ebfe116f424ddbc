"""Near-duplicates by consistent weighted sampling of TF-IDF word shingles.

A text is a bag of word shingles, each weighing its count times an inverse
document frequency.  Improved consistent weighted sampling draws samples that
two bags share with the probability of their weighted Jaccard similarity; they
are banded, and texts that share a band are candidates, verified by the weighted
Jaccard similarity of the whole texts.  Classes are the connected components of
verified links.

Document frequencies cover all documents.  They are counted in a hashed table of
a fixed size, so a shingle's frequency is overstated by about the mean number of
shingles of a document over the table's size, whatever the number of documents.
The weight starts to fall where a shingle is in more than ``common`` of all
documents, and has a floor, because a large group of near copies makes its own
shingles frequent and must still be found.

Equal texts are one candidate.  Within a band's bucket every text is compared
with a leader, the one whose shingles are the most frequent: of a group of near
copies, the one that most resembles the others.  Buckets whose texts are then in
one class are done.  The others are joined up by the texts that they share.
Where few texts hang together so, one task compares all of them by an index of
their shingles.  Where many do, they are matched by an exact prefix filter: with
a text's shingles in order of frequency, those from the first that two texts
share must weigh as much as the threshold asks of both together.  So texts of
nearly equal weight meet at the shingles of a short, rare prefix, and only there;
in each such list the texts outside of its largest class are compared with those
of other classes, a fixed number of them at a time until all have been.  No pairs
are sent within a class, nor of texts that the filter parts.

A null text is the empty text.  Texts without words are near only to equal
texts.  Repeated rows are equal texts.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, drop_stored, maybe_in, spread_join, step, store
from .graph import components, extended
from .shingles import U, bags, groups_of, mix, numbers, slices_of

WIDTH, THRESHOLD = 5, 0.8
#: At similarity 0.8 a pair shares none of 16 bands of 3 samples once in 90,000 times.
BANDS, ROWS = 16, 3
TABLE_BITS = 20
#: Texts of a list that are compared with the others at a time, and the ratio of a class of weights.
LEADERS, CLASS_RATIO = 512, 1.1
#: Tasks whose counts are added up first.
TASKS_A_GROUP = 64
#: Size of the table of frequencies among candidates, which orders their shingles.
ORDER_BITS = 20
#: Texts, and bytes of them, that one task compares with each other.
TOGETHER_TEXTS, TOGETHER_BYTES = 512, 8_000_000
#: Share of documents from which a shingle loses weight, and the least weight.
COMMON, FLOOR = 0.01, 0.75
#: Pre-drawn parameters of the sampling, picked by hash for each shingle and sample.
POOL_BITS = 16
_CHUNK_BITS = 12


def text_key() -> F.Column:
    """Identity of a text: 16 bytes of its SHA-256."""
    return F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32))


def document_frequencies(docs: DataFrame, width: int = WIDTH, bits: int = TABLE_BITS) -> np.ndarray:
    """How many documents have a shingle of each hash value; 2^bits counts, over all documents.

    Tasks' counts are added up in two steps, first within groups of tasks, so
    that the number of those that add grows with the number of tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint32)  # a task has fewer texts
        for b in batches:
            for _, some in slices_of(b.column(0)):
                for _, texts in groups_of(some):
                    at, n = np.unique((bags(texts, width)[0] & U(len(table) - 1)).astype(np.uint32), return_counts=True)
                    table[at] += n.astype(np.uint32)
        if table.any():
            parts = table.reshape(-1, 1 << _CHUNK_BITS)
            some = np.flatnonzero(parts.any(axis=1))
            group = [TaskContext.get().partitionId() // TASKS_A_GROUP] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(group, pa.int32()), pa.array([_packed(parts[k]) for k in some], pa.binary())], ["part", "of_tasks", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = _unpacked(x)
                sums[k] = sums[k] + x if k in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([_packed(x) for x in sums.values()], pa.binary())], ["part", "of_tasks", "counts"])

    schema = "part int, of_tasks int, counts binary"
    made = docs.select("text").mapInArrow(count, schema).repartition("part", "of_tasks").mapInArrow(add, schema).repartition("part").mapInArrow(add, schema)
    out = np.zeros((1 << (bits - _CHUNK_BITS), 1 << _CHUNK_BITS), np.float32)
    with step(docs.sparkSession):
        for r in made.toLocalIterator():
            out[r["part"]] = _unpacked(r["counts"])
    return out.reshape(-1)


def _packed(counts: np.ndarray) -> bytes:
    """Counts as a list of those that are not zero, or all of them, whichever is shorter."""
    at = np.flatnonzero(counts)
    if 10 * len(at) < 4 * len(counts):
        return b"s" + at.astype("<u2").tobytes() + counts[at].astype("<u8").tobytes()
    return b"d" + counts.astype("<u4").tobytes() if counts.max() < 1 << 32 else b"D" + counts.astype("<u8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if data[:1] != b"s":
        return np.frombuffer(data, "<u4" if data[:1] == b"d" else "<u8", offset=1).astype(np.int64)
    n = (len(data) - 1) // 10
    out = np.zeros(1 << _CHUNK_BITS, np.int64)
    out[np.frombuffer(data, "<u2", n, 1)] = np.frombuffer(data, "<u8", n, 1 + 2 * n).astype(np.int64)
    return out


def idf_weights(frequencies: np.ndarray, n_docs: int) -> np.ndarray:
    """Weight of a shingle of each hash value."""
    share = np.maximum(frequencies, 1) / max(n_docs, 1)
    return np.clip(-np.log(np.minimum(share, 1.0)) / -np.log(COMMON), FLOOR, 1.0).astype(np.float32)


@lru_cache(maxsize=1)
def _pool() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """r and ln c of Gamma(2, 1), beta of Uniform(0, 1), multipliers that pick from them, and ln a of weight 1 in sortable form."""
    n = 1 << POOL_BITS
    u = (numbers(5 * n, 21).reshape(5, n) >> U(11)).astype(np.float64) / (1 << 53) + 2.0**-60
    r = -np.log(u[0] * u[1])
    lnc = np.log(-np.log(u[2] * u[3]))
    beta = u[4]
    return r, lnc, beta, numbers(BANDS * ROWS, 22) | U(1), _sortable(lnc + r * beta - r)


def _sortable(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of 32-bit floats, in the upper half of 64 bits."""
    i = x.astype(np.float32).view(np.int32)
    return ((i ^ ((i >> 31) & 0x7FFFFFFF)).astype(np.int64) + (1 << 31)).astype(U) << U(32)


def samples(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Consistent weighted samples, as 32-bit names, of bags that begin at ``starts``: one row a sample."""
    r, lnc, beta, pick, of_one = _pool()
    names = (hashes ^ (hashes >> U(17))) & U(0xFFFFFFFF)
    other = np.flatnonzero(weights != 1.0)
    lns = np.log(weights[other].astype(np.float64))
    spread = mix(hashes)
    out = np.empty((len(pick), len(starts)), U)
    for k, p in enumerate(pick):
        at = (spread * p) >> U(64 - POOL_BITS)
        packed = of_one[at] | names
        if len(other):
            i = at[other]
            t = np.floor(lns / r[i] + beta[i])
            lna = lnc[i] - r[i] * (t - beta[i] + 1.0)
            packed[other] = _sortable(lna) | ((names[other] + t.astype(np.int64).astype(U) * U(0x9E3779B1)) & U(0xFFFFFFFF))
        out[k] = np.minimum.reduceat(packed, starts) & U(0xFFFFFFFF)
    return out


def band_keys(texts: list[str], idf: np.ndarray, frequencies: np.ndarray, width: int = WIDTH) -> tuple[list[np.ndarray | None], list[float]]:
    """The keys of each text's bands (none for a text without words), and how rare its shingles are."""
    out: list[np.ndarray | None] = [None] * len(texts)
    rarity = [0.0] * len(texts)
    for first, some in groups_of(texts):
        hashes, owner, counts = bags(some, width)
        if not len(hashes):
            continue
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        at = (hashes & U(len(idf) - 1)).astype(np.int64)
        weights = counts.astype(np.float32) * idf[at]
        sums = np.add.reduceat(-np.log(frequencies[at] + 1.0), starts)
        drawn = samples(hashes, weights, starts)
        keys = np.zeros((BANDS, len(starts)), U)
        for j in range(BANDS):
            for i in range(ROWS):
                keys[j] = mix(keys[j] * U(0x9E3779B97F4A7C15) + drawn[j * ROWS + i] + U(j + 1))
        for i, who in enumerate(owner[starts]):
            out[first + who] = keys[:, i].view(np.int64)
            rarity[first + who] = float(sums[i]) / (np.append(starts, len(hashes))[i + 1] - starts[i])
    return out, rarity


def prefix(text: str, idf: np.ndarray, order_by: np.ndarray, threshold: float, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Where a text looks for others: keys, whether it may be found there by heavier ones, weight from the key's shingle on, and its weight.

    With weights V <= W and overlap from the first common shingle on of at most
    s, a pair reaches the threshold t only if s >= t / (1 + t) * (V + W).  Keys
    join a shingle with a class of weights: a text is found under its own class
    where s allows for two texts of its weight, and looks for lighter ones under
    each class down to t times its weight where s allows for the class's least.
    Shingles of a table place that only one text is counted for get no keys.
    """
    hashes, _, counts = bags([text], width)
    weights = counts * idf[(hashes & U(len(idf) - 1)).astype(np.int64)]
    places = order_by[(hashes & U(len(order_by) - 1)).astype(np.int64)]
    order = np.lexsort((hashes, places))
    hashes, weights, shared = hashes[order], weights[order].astype(np.float64), places[order] > 1
    rest = weights[::-1].cumsum()[::-1]
    whole = float(rest[0])
    slack, share = 1e-6 * whole, threshold / (1.0 + threshold)
    own = int(np.floor(np.log(whole) / np.log(CLASS_RATIO)))
    low = int(np.floor(np.log(threshold * whole - slack) / np.log(CLASS_RATIO)))
    keys, found, rests = [], [], []
    for c in range(low, own + 1):
        i = np.flatnonzero(shared & (rest >= share * (whole + min(whole, max(CLASS_RATIO**c, threshold * whole))) - slack))
        keys.append(mix(hashes[i] * U(0x9E3779B97F4A7C15) + U(c + (1 << 20))).view(np.int64))
        found.append((rest[i] >= 2 * share * whole - slack) & (c == own))
        rests.append(rest[i])
    return np.concatenate(keys), np.concatenate(found), np.concatenate(rests), whole


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two bags: sorted distinct hashes and their weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64)
    total = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - both
    return float(both / total) if total > 0 else 0.0


def weighted_bag(text: str, idf: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, counts = bags([text], width)
    return hashes, counts.astype(np.float32) * idf[(hashes & U(len(idf) - 1)).astype(np.int64)]


def near_within(texts: list[str], idf: np.ndarray, threshold: float, width: int = WIDTH) -> list[tuple[int, int]]:
    """Links that join up all texts between which there are chains of near ones; every two are compared."""
    found = [weighted_bag(t, idf, width) for t in texts]
    n = len(texts)
    shared = np.zeros((n, n))
    hashes, weights = np.concatenate([h for h, _ in found]), np.concatenate([w for _, w in found]).astype(np.float64)
    owner = np.repeat(np.arange(n), [len(h) for h, _ in found])
    order = np.argsort(hashes, kind="stable")
    hashes, weights, owner = hashes[order], weights[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1], [True]]))
    sizes = np.diff(starts)
    for size in np.unique(sizes[sizes > 1]):  # shingles that as many texts have, at once
        for some in np.array_split(starts[:-1][sizes == size], max(1, int(size * size * (sizes == size).sum()) >> 19)):
            at = some[:, None] + np.arange(size)
            who, w = owner[at], weights[at]
            np.add.at(shared, (np.repeat(who, size, axis=1).ravel(), np.tile(who, size).ravel()), np.minimum(np.repeat(w, size, axis=1), np.tile(w, size)).ravel())
    total = np.array([w.sum(dtype=np.float64) for _, w in found])
    both = total[:, None] + total[None, :] - shared
    near = np.triu((shared > 0) & (shared >= threshold * both - 1e-9), 1)
    parent, out = list(range(n)), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True):
        if (a := root(i)) != (b := root(j)):
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float, width: int) -> DataFrame:
    """``pairs`` of keys ``lead``, ``key`` with ``near``.  Both joins read one exchange of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag_of = lru_cache(maxsize=16)(lambda t: weighted_bag(t, idf.value, width))  # leaders recur
        for b in batches:
            near = []
            for (_, xs), (_, ys) in zip(slices_of(b.column(2)), slices_of(b.column(3)), strict=True):
                near += [weighted_jaccard(bag_of(x), weighted_bag(y, idf.value, width)) >= threshold for x, y in zip(xs, ys, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.bool_())], ["lead", "key", "near"])

    one, two = texts.alias("one"), texts.alias("two")
    of_key = pairs.join(one, F.col("key") == F.col("one.id")).select("lead", "key", F.col("one.text").alias("text"))
    both = of_key.join(two, F.col("lead") == F.col("two.id")).select("lead", "key", F.col("two.text").alias("lead_text"), of_key["text"])
    return both.mapInArrow(run, "lead binary, key binary, near boolean")


def signatures(docs: DataFrame, threshold: float, width: int) -> tuple[DataFrame, object, object, int]:
    """Each distinct text's ``key``, ``least`` (doc_id), ``copies``, ``rarity`` and ``bands``, stored; the broadcast weights and frequencies; the number of rows."""
    spark = docs.sparkSession
    with step(spark):
        n_docs = docs.select(F.count(F.lit(1))).first()[0]
    counted = document_frequencies(docs, width)
    frequencies = spark.sparkContext.broadcast(counted)  # 4 MB, as are the weights
    idf = spark.sparkContext.broadcast(idf_weights(counted, n_docs))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, some in slices_of(b.column(2)):
                keys, rarity = band_keys(some, idf.value, frequencies.value, width)
                ids, names = (b.column(k).slice(first, len(some)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, names, pa.array(rarity, pa.float32()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "key", "rarity", "bands"])

    signed = docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(sign, f"doc_id {kind}, key binary, rarity float, bands array<bigint>")
    texts = signed.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("rarity").alias("rarity"), F.first("bands").alias("bands"))
    return store(texts), idf, frequencies, n_docs


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id`` (the key) and ``text`` of the texts ``wanted`` (``key``, ``least``), once each.

    A bitmap of what is wanted spares most other texts the shuffle.
    """
    n = wanted.count()
    name = F.xxhash64("key", "least")
    rows = docs.select(text_key().alias("key"), F.col("doc_id").alias("least"), F.coalesce("text", F.lit("")).alias("text"))
    rows = maybe_in(rows, name, bitmap(wanted.select(name.alias("h")), n)).alias("r")
    w = wanted.alias("w")
    found = store(rows.join(w, (F.col("r.key") == F.col("w.key")) & F.col("r.least").eqNullSafe(F.col("w.least"))).select(F.col("r.key").alias("id"), "text"))
    if found.count() == n:
        return found
    once = store(found.dropDuplicates(["id"]))  # rows are repeated
    drop_stored(found)
    return once


def near_links(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Verified links ``a``, ``b`` between different texts; ``node``, ``root`` of the texts that have any; ``key``, ``least``, ``copies`` of every text; the number of rows."""
    spark = docs.sparkSession
    signed, idf, _, n_docs = signatures(docs, threshold, width)
    texts = signed.select("key", "least", "copies")
    members = signed.select("key", "rarity", F.explode("bands").alias("band"))
    buckets = store(members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rarity", "key")).alias("x")).filter("n > 1").select("band", "n", F.col("x.key").alias("lead")))
    n_crowded = buckets.agg(F.sum("n")).first()[0] or 0
    if not n_crowded:
        none = spark.createDataFrame([], "a binary, b binary")
        return none, none.toDF("node", "root"), texts, n_docs
    crowded = store(spread_join(members.select("key", "band"), buckets, "band", "n", n_crowded))  # band, key, n, lead
    # The texts of all candidates, once.
    bodies = _bodies(docs, store(texts.join(crowded.select("key").distinct(), "key").select("key", "least")))
    verified = lambda pairs: store(_verified(pairs, bodies, idf, threshold, width))
    near = lambda judged: judged.filter("near").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    judged = [verified(_ordered(crowded.filter("key != lead")))]
    labels = extended(None, near(judged[0]))

    split = store(_split(crowded, judged[0], labels))
    hanging = components(spread_join(crowded.select("band", "key"), split, "band", "n", n_crowded).select(F.col("key").alias("a"), "b").filter("a != b"))
    rest = store(hanging.join(bodies, F.col("node") == F.col("id")).select(F.col("root").alias("group"), F.col("node").alias("key"), "text"))
    drop_stored(buckets, crowded, split)
    groups = rest.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    groups = store(groups.select("group", ((F.col("n") <= TOGETHER_TEXTS) & (F.col("bytes") <= TOGETHER_BYTES)).alias("small"), "n"))

    def compare(some: pa.Table) -> pa.Table:
        order = pc.sort_indices(some, [("key", "ascending")])
        keys, texts = (some[c].take(order).to_pylist() for c in ("key", "text"))
        links = near_within(texts, idf.value, threshold, width)
        return pa.table([pa.array([keys[k[i]] for k in links], pa.binary()) for i in (0, 1)], ["a", "b"])

    together = store(rest.join(groups.filter("small"), "group").select("group", "key", "text").groupBy("group").applyInArrow(compare, "a binary, b binary"))
    labels = extended(labels, together)
    n_rest = rest.count()
    lists = _lists(store(spread_join(rest, groups.filter("not small"), "group", "n", n_rest).select("key", "text")), labels, idf, threshold, width)
    while lists is not None:
        lists = _open_lists(lists)
        if not lists.count():
            break
        some = store(_leaders(lists))
        lead = lists.join(some, ["band", "key"]).select("band", *[F.col(c).alias(f"lead_{c}") for c in ("key", "class", "found", "rest", "whole")])
        met = lists.join(lead, "band").filter("class != lead_class and (found or lead_found)")
        enough = threshold / (1 + threshold) * (F.col("whole") + F.col("lead_whole")) * (1 - 1e-6)
        met = met.filter((F.least("rest", "lead_rest") >= enough) & (F.least("whole", "lead_whole") >= threshold * (1 - 1e-6) * F.greatest("whole", "lead_whole")))
        pairs = _ordered(met.select("key", F.col("lead_key").alias("lead")))
        for before in judged:
            pairs = pairs.join(before, ["lead", "key"], "left_anti")
        judged.append(verified(pairs))
        labels = extended(labels, near(judged[-1]))
        # Those that have been compared with all others of the list are done.
        left = store(_classed(lists.drop("class").join(some, ["band", "key"], "left_anti"), labels))
        drop_stored(lists, some)
        lists = left
    drop_stored(bodies, rest)
    links = reduce(DataFrame.unionByName, map(near, judged), together)
    return links, labels, texts, n_docs


def _split(crowded: DataFrame, judged: DataFrame, labels: DataFrame) -> DataFrame:
    """``band``, ``n`` and one text, ``b``, of each bucket of ``crowded`` whose texts are in several classes.

    A text near its bucket's leader is in the leader's class, so only those apart from it are looked up.
    """
    met = crowded.select("band", "n", F.col("lead").alias("b"), F.col("key").alias("a"), F.least("lead", "key").alias("lead"), F.greatest("lead", "key").alias("key"))
    apart = met.join(judged.filter("not near").select("lead", "key"), ["lead", "key"]).select("band", "n", "a", "b")
    root_of = lambda x: labels.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    several = F.coalesce("a_root", "a") != F.coalesce("b_root", "b")
    return apart.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").filter(several).select("band", "n", "b").distinct()


def _lists(rest: DataFrame, labels: DataFrame, idf, threshold: float, width: int) -> DataFrame | None:
    """Where the texts ``rest`` look for each other: ``key``, ``class``, ``band`` and what prefix() says; stored.  None if there are no such texts."""
    if rest.isEmpty():
        return None
    # Any order of shingles will do; one by frequency among these texts keeps the lists short.
    rarest = rest.sparkSession.sparkContext.broadcast(document_frequencies(rest, width, ORDER_BITS))  # 4 MB

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in ((k + j, t) for k, some in slices_of(b.column(2)) for j, t in enumerate(some)):
                bands, found, rests, whole = prefix(t, idf.value, rarest.value, threshold, width)
                n = len(bands)
                if n:
                    keys, of_class = (pa.array([b.column(c)[i].as_py()] * n, pa.binary()) for c in (0, 1))
                    yield pa.RecordBatch.from_arrays([keys, of_class, pa.array(bands), pa.array(found), pa.array(rests), pa.array(np.full(n, whole))], ["key", "class", "band", "found", "rest", "whole"])

    # The class is looked up once a text, not once a list.
    return store(_classed(rest, labels).select("key", "class", "text").mapInArrow(prefixes, "key binary, class binary, band long, found boolean, rest double, whole double"))


def _open_lists(lists: DataFrame) -> DataFrame:
    """Rows of the lists that have texts of several classes; stored."""
    several = lists.groupBy("band").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.max("found").alias("any"), F.count(F.lit(1)).alias("_n")).filter("x != y and any").select("band", "_n")
    out = store(spread_join(lists, store(several), "band", "_n", lists.count()).drop("_n"))
    drop_stored(lists)
    return out


def _leaders(lists: DataFrame) -> DataFrame:
    """``band`` and ``key`` of at most LEADERS texts of each list, outside of its largest class."""
    sizes = lists.groupBy("band", "class").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("band").agg(F.max_by("class", "size").alias("largest"), F.sum("size").alias("_n"))
    outside = spread_join(lists, store(largest), "band", "_n", lists.count()).filter("class != largest")
    return outside.groupBy("band", F.pmod(F.xxhash64("key"), F.lit(LEADERS)).alias("k")).agg(F.min("key").alias("key")).select("band", "key")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each pair of keys once, the lesser as ``lead``."""
    return pairs.select(F.least("lead", "key").alias("lead"), F.greatest("lead", "key").alias("key")).distinct()


def _classed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with the ``class`` of each key so far."""
    return members.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("class", F.coalesce("root", "key")).drop("root")


def _text_classes(docs: DataFrame, threshold: float, width: int) -> tuple[DataFrame, int]:
    """Of every text: ``key``, ``copies``, ``class_key``, ``class_id``, ``class_rows``, ``head`` (key of a text of the class's least id), ``n_leader_links``; stored.  And the number of rows."""
    links, labels, texts, n_docs = near_links(docs, threshold, width)
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_leader_links"))
    linked = store(texts.join(labels.withColumnRenamed("node", "key"), "key").join(degree, "key", "left").withColumnRenamed("root", "class_key"))
    heads = linked.groupBy("class_key").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_rows"), F.min(F.struct(F.col("least").isNull().alias("none"), "least", "key")).alias("x"), F.count(F.lit(1)).alias("_n")).select("class_key", "class_id", "class_rows", F.col("x.key").alias("head"), "_n")
    columns = ["key", "copies", "class_key", "class_id", "class_rows", "head", F.coalesce("n_leader_links", F.lit(0).cast("long")).alias("n_leader_links")]
    several = spread_join(linked, store(heads), "class_key", "_n", linked.count()).select(*columns)
    alone = texts.join(labels.select(F.col("node").alias("key")), "key", "left_anti").select("key", "copies", F.col("key").alias("class_key"), F.col("least").alias("class_id"), F.col("copies").alias("class_rows"), F.col("key").alias("head"), F.lit(0).cast("long").alias("n_leader_links"))
    return store(several.unionByName(alone)), n_docs


def classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``doc_id``, ``key``, ``class_key``, ``class_id`` (the least doc_id of the class), ``class_rows``, ``n_leader_links`` (of its text) of every row.

    ``class_key``, the key of one of its texts, tells classes apart.  ``class_id``
    does not where ids are null or repeat: it is null for a class without ids, and
    classes with the same least id share it.

    ``n_leader_links`` counts the links of the row's text that were verified: with
    a bucket's leader, as one, and those that join classes.  It is not the number of near
    texts, as pairs within a class are not compared; equal texts need none.  It
    depends on which texts lead, that is on the other rows of the table.
    """
    of_text, n_docs = _text_classes(docs, threshold, width)
    rows = docs.select("doc_id", text_key().alias("key"))
    return spread_join(rows, of_text, "key", "copies", n_docs).select("doc_id", "key", "class_key", "class_id", "class_rows", "n_leader_links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``docs`` with one document of each class: that of the least doc_id (of its repeated rows, one).

    Most rows that are alone in their class stay where they are: a bitmap of the
    others tells which have to be looked up, and only rows that are kept are shuffled.
    """
    of_text, _ = _text_classes(docs, threshold, width)
    several = of_text.filter("class_rows > 1").select(F.col("key").alias("_key"), "class_id", "head", "copies")
    n_several, n_rows = several.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    in_several = bitmap(several.select(F.xxhash64("_key").alias("h")), n_several)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_doc"), text_key().alias("_key"))
    # Which of the rows that the bitmap has stay: heads, and rows that only seem to be among several.
    asked = maybe_in(rows.select("_doc", "_key"), F.xxhash64("_key"), in_several)
    head = F.col("_doc").eqNullSafe(F.col("class_id")) & (F.col("_key") == F.col("head"))
    staying = spread_join(asked, several, "_key", "copies", n_rows, "left").filter(F.col("copies").isNull() | head)
    staying = store(staying.groupBy("_doc", "_key").agg(F.count(F.lit(1)).alias("_n")))
    n_staying, most = staying.agg(F.count(F.lit(1)), F.max("_n")).first()
    name = F.xxhash64("_doc", "_key")
    r, k = maybe_in(rows, name, bitmap(staying.select(name.alias("h")), n_staying)).alias("r"), staying.alias("k")
    kept = r.join(k, F.col("r._doc").eqNullSafe(F.col("k._doc")) & (F.col("r._key") == F.col("k._key"))).select("r.row", "r._doc", "r._key")
    if (most or 0) > 1:  # rows are repeated
        kept = kept.dropDuplicates(["_doc", "_key"])
    return maybe_in(rows, F.xxhash64("_key"), in_several, keep=False).select("row.*").unionByName(kept.select("row.*"))

"""Language-model scoring by a hashed maximum-entropy model.

The probability of a token is a product of softmaxes down a tree of classes: of
its class given the tokens before it, of its class within that one, and so on to
the token itself.  A class has two parts, so a softmax has two branches and one
weight a feature.  The features are hashed: each joins the class with the token
before (n-gram), the one before that (skip) or the endings of both.  The most
frequent tokens have leaves of their own, in order of a hash of their last two
bytes, so those with one ending are in one class.  The others
share leaves by a hash of their last two bytes; within such a leaf a token has
its smoothed share of the training counts, whatever the context, and the leaf
keeps room for one unseen token.  So the probabilities of all known tokens and of
an unseen one add up to 1 (for each leaf of the last kind).

Counting: documents are dealt into blocks by a hash.  A block sends the hashes of
its distinct tokens with their training counts to buckets of hashes; the buckets
add up and send each block the totals of its tokens.  So counts cover all
training documents, every block gets those it needs, and nothing that grows with
the corpus is collected or broadcast.  (Tokens are told apart by 64-bit hashes.)

Training: every block updates its own copy of the weights by gradient steps on
batches of all its training tokens, in an order that hashes fix; a row's weights
are then averaged over blocks by the tokens that had it, in two steps, and so on for a number of rounds.  So the model depends on the rows of the table and not
on its files.  The table of weights grows with the input up to MOST_ROWS rows.
Scoring works on batches of tokens in numpy, with only the rows that their
features name.

A null text is the empty text, which has one token, the end.  A row without a
doc_id counts as a training row.  Repeated rows are counted and scored each.
Ties in frequency go to the lesser hash.  Texts of any length are scored whole.
Without training rows nothing is known.  An empty table gives an empty table.
Columns beyond ``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts_for, step
from .shingles import U, groups_of, mix, numbers, slices_of, word_hashes

#: Levels of classes, and the leaves: those of one token, and those by ending.
LEVELS = 14
LEAVES = 1 << LEVELS
ENDINGS = LEAVES // 8
SINGLES = LEAVES - ENDINGS
#: Kinds of features, and weights: one for so many bytes of text, within bounds.
KINDS = 3
BYTES_A_WEIGHT, LEAST_WEIGHTS, MOST_WEIGHTS = 16, 1 << 16, 1 << 20
#: Passes over the training tokens, step size, tokens in a batch.
ROUNDS, RATE, BATCH = 1, 0.4, 1 << 14
#: A weight is drawn to zero as if its feature had been seen so many times more without effect.
SHRINK = 10.0
BLOCK_BYTES, BUCKET_BYTES = 16_000_000, 48_000_000
#: Blocks whose weights are added up first, and weights that are sent together.
BLOCKS_A_GROUP, WEIGHTS_A_PART = 64, 4096
END = U(0xE2D0F00DC0FFEE11)
END_ENDING = U(0x1234567)

# Bytes that part words are 0x20 and 0x09 to 0x0D; A-Z count as a-z.
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUES = numbers(256, 41)[_LOWER]


@dataclass
class Tokens:
    """Tokens of several texts, one after another: hash, hash of the ending, number of the text."""

    hashes: np.ndarray
    endings: np.ndarray
    owner: np.ndarray
    n_texts: int

    def contexts(self) -> np.ndarray:
        """Hashes of each token's context, one row a kind."""
        n = len(self.hashes)
        back = [np.concatenate([np.zeros(k, x.dtype), x[: n - k]]) for x in (self.hashes, self.endings) for k in (1, 2)]
        for k, x in zip((1, 2, 1, 2), back, strict=True):  # nothing before a text's first token
            x[:k] = U(7)
            if n > k:
                x[k:][self.owner[k:] != self.owner[:-k]] = U(7)
        one, two, end_one, end_two = back
        return np.stack([mix(one + U(1)), mix(two + U(2)), mix(mix(end_one * U(0x9E3779B97F4A7C15) + end_two) + U(3))])


def tokens_of(texts: list[str]) -> Tokens:
    """Words of the texts and one end token each."""
    bodies = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(bodies), np.uint8)
    bounds = np.cumsum([len(b) + 1 for b in bodies])
    hashes, starts, ends = word_hashes(data, _IS_WORD, _VALUES)
    owner = np.searchsorted(bounds, starts, side="right")
    last = _VALUES[data[ends - 1]] if len(ends) else np.zeros(0, U)
    before = np.where(ends - starts > 1, _VALUES[data[np.maximum(ends - 2, 0)]], U(0)) if len(ends) else np.zeros(0, U)
    endings = mix(last * U(0xD6E8FEB86659FD93) + before)
    n = np.bincount(owner, minlength=len(texts))
    at_end = np.cumsum(n)
    return Tokens(np.insert(hashes, at_end, END), np.insert(endings, at_end, END_ENDING), np.insert(owner, at_end, np.arange(len(texts))), len(texts))


@dataclass
class Model:
    """What scoring needs besides counts: sizes, leaves and weights; of bounded size."""

    n: int = 0
    v: int = 0
    singles: list[int] = field(default_factory=list)  # hashes, as signed, in order of leaves
    room: np.ndarray = field(default_factory=lambda: np.ones(ENDINGS))  # tokens, distinct tokens and one, of each leaf by ending
    prior: np.ndarray = field(default_factory=lambda: np.ones(LEAVES))  # tokens of each leaf, and one
    weights: np.ndarray = field(default_factory=lambda: np.zeros(LEAST_WEIGHTS, np.float32))

    def __post_init__(self) -> None:
        #: Log odds of the second branch of each class; classes are numbered from the root, 1, and k has 2 k and 2 k + 1.
        self.bias = np.zeros(LEAVES, np.float32)
        for level in range(LEVELS):
            first, second = self.prior.reshape(1 << level, 2, -1).sum(axis=2).T
            self.bias[1 << level : 2 << level] = np.log(second / first)

    def leaves(self, t: Tokens) -> np.ndarray:
        out = SINGLES + (t.endings % U(ENDINGS)).astype(np.int64)
        if self.singles:
            names = np.array(self.singles, np.int64).view(U)
            order = np.argsort(names)
            at = np.minimum(np.searchsorted(names[order], t.hashes), len(names) - 1)
            hit = names[order][at] == t.hashes
            out[hit] = order[at[hit]]
        return out

    def steps(self, contexts: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each level and token: places of the weights (one for each kind, first), log odds of the second branch, whether it is taken."""
        nodes = (leaves.astype(np.int32) + LEAVES) >> np.arange(LEVELS, 0, -1, dtype=np.int32)[:, None]
        taken = (leaves.astype(np.int32) >> np.arange(LEVELS - 1, -1, -1, dtype=np.int32)[:, None]) & 1
        names = nodes.astype(U)
        names *= U(0xD6E8FEB86659FD93)
        odds = self.bias.take(nodes)
        places = np.empty((KINDS, *nodes.shape), np.int32)
        x = np.empty_like(names)
        for k in range(KINDS):
            np.bitwise_xor(contexts[k], names, out=x)
            x *= U(0x9E3779B97F4A7C15)
            x >>= U(65 - len(self.weights).bit_length())
            places[k] = x
            odds += self.weights.take(places[k])
        return places, odds, taken

    def score(self, t: Tokens, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each text; ``counts``: training count of each token."""
        contexts, leaves = t.contexts(), self.leaves(t)
        of_leaf = np.empty(len(leaves))
        for s in range(0, len(leaves), BATCH):
            _, odds, taken = self.steps(contexts[:, s : s + BATCH], leaves[s : s + BATCH])
            np.negative(odds, out=odds, where=taken.astype(bool))
            np.exp(np.minimum(odds, 40, out=odds), out=odds)
            of_leaf[s : s + BATCH] = -np.log10(np.prod(1 + odds, axis=0, dtype=np.float64))
        inside = np.where(leaves < SINGLES, 0.0, np.log10(counts + 1.0) - np.log10(self.room)[np.maximum(leaves - SINGLES, 0)])
        return np.bincount(t.owner, of_leaf + inside, t.n_texts)


class Trainer:
    """A copy of a model's weights that learns, how often each had its feature, and room for its steps."""

    def __init__(self, model: Model) -> None:
        self.model = replace(model, weights=model.weights.copy())
        self.squares = np.full(len(model.weights), 1e-6, np.float32)
        self.seen, self.step, self.spare = (np.zeros(len(model.weights), np.float32) for _ in range(3))

    def train(self, t: Tokens) -> None:
        """Gradient steps on batches of the tokens, scaled for each weight by its past gradients."""
        contexts, leaves = t.contexts(), self.model.leaves(t)
        for s in range(0, len(leaves), BATCH):
            places, odds, taken = self.model.steps(contexts[:, s : s + BATCH], leaves[s : s + BATCH])
            g = (1 / (1 + np.exp(-odds)) - taken).astype(np.float32).ravel()
            self.step.fill(0)
            for of_kind in places.reshape(KINDS, -1):
                np.add.at(self.step, of_kind, g)
                np.add.at(self.seen, of_kind, np.ones_like(g))
            self.squares += np.multiply(self.step, self.step, out=self.spare)
            self.step /= np.sqrt(self.squares, out=self.spare)
            self.step *= np.float32(RATE)
            self.model.weights -= self.step


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _concatenated(texts: list[str]) -> Tokens:
    parts = [(first, tokens_of(some)) for first, some in groups_of(texts)]
    if not parts:
        return tokens_of([])
    return Tokens(np.concatenate([t.hashes for _, t in parts]), np.concatenate([t.endings for _, t in parts]), np.concatenate([t.owner + first for first, t in parts]), len(texts))


_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()), ("endings", pa.binary())])
_TOLD = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("class", pa.int32()), ("hash", pa.int64()), ("n", pa.int64()), ("v", pa.int64())])


def _bucketed(hashes: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places, in order, of the sorted distinct hashes that go to each bucket."""
    bucket = (mix(hashes) % U(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    for b in range(n_buckets):
        if edges[b] < edges[b + 1]:
            yield b, order[edges[b] : edges[b + 1]]


def token_counts(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Training counts of every block's tokens (kind 0), sums by class (kind 1), and each bucket's most frequent tokens (kind 2).

    ``rows``: ``block``, ``held_out``, ``text``.
    """

    def send(block: pa.Table) -> pa.Table:
        t = _concatenated([x or "" for x in block["text"].to_pylist()])
        train = ~np.array(block["held_out"].to_pylist(), bool)
        names, first, inverse = np.unique(t.hashes, return_index=True, return_inverse=True)
        counts = np.bincount(inverse, train[t.owner], len(names)).astype("<u4")
        endings = (t.endings[first] % U(ENDINGS)).astype("<u2")
        at = block["block"][0].as_py()
        out = [(b, at, _planes(names[i].astype("<u8")), _planes(counts[i]), endings[i].tobytes()) for b, i in _bucketed(names, n_buckets)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SENT, strict=True)], schema=_SENT)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, held in _grouped(batches):
            names = np.concatenate([_from_planes(r["hashes"], "<u8") for r in held])
            sizes = [len(r["hashes"]) // 8 for r in held]
            counts = np.concatenate([_from_planes(r["counts"], "<u4") for r in held])
            endings = np.concatenate([np.frombuffer(r["endings"], "<u2") for r in held])
            names, first, inverse = np.unique(names, return_index=True, return_inverse=True)
            total = np.bincount(inverse, counts, len(names)).astype(np.int64)
            endings = endings[first]
            told = total[inverse]
            edges = np.cumsum([0, *sizes])
            out = [(0, r["block"], b, _planes(told[s:e].astype("<u8")), None, None, None, None) for r, s, e in zip(held, edges[:-1], edges[1:], strict=True)]
            known = total > 0
            n, v = np.bincount(endings[known], total[known], ENDINGS).astype(np.int64), np.bincount(endings[known], minlength=ENDINGS)
            out += [(1, None, b, None, int(k), None, int(n[k]), int(v[k])) for k in np.flatnonzero(v)]
            # The most frequent of all are spread over the buckets by a hash.
            for i in np.lexsort((names, -total))[: min(SINGLES, 64 + 4 * SINGLES // n_buckets)]:
                if total[i]:
                    out.append((2, None, b, None, int(endings[i]), int(names[i].view(np.int64)), int(total[i]), None))
            for k in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 2000], strict=True), _TOLD, strict=True)], schema=_TOLD)

    sent = rows.groupBy("block").applyInArrow(send, "bucket int, block long, hashes binary, counts binary, endings binary")
    told = sent.repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket", "block")
    return told.mapInArrow(add, "kind int, block long, bucket int, counts binary, class int, hash long, n long, v long")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    at, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["bucket"] != at:
                if held:
                    yield at, held
                at, held = r["bucket"], []
            held.append(r)
    if held:
        yield at, held


def _averaged(dealt: DataFrame, model: Model) -> Model:
    """One round: gradient steps in every block, then the average."""
    spark = dealt.sparkSession
    sent = spark.sparkContext.broadcast(model)  # as large as its weights

    def steps(block: pa.Table) -> pa.Table:
        trainer = Trainer(sent.value)
        # In an order of their own, as rows come in any order.
        order = pc.sort_indices(block, [("name", "ascending"), ("text", "ascending")])
        for _, some in slices_of(block["text"].take(order)):
            for _, texts in groups_of(some):
                trainer.train(tokens_of(texts))
        weights, seen = trainer.model.weights, trainer.seen
        parts = [k for k in range(0, len(weights), WEIGHTS_A_PART) if seen[k : k + WEIGHTS_A_PART].any()]
        at = [slice(k, k + WEIGHTS_A_PART) for k in parts]
        blobs = [np.stack([weights[i] * seen[i], seen[i]]).astype("<f4").tobytes() for i in at]
        of = block["block"][0].as_py() if len(block) else 0
        return pa.table([pa.array(parts, pa.int32()), pa.array([of // BLOCKS_A_GROUP] * len(parts), pa.int64()), pa.array([of] * len(parts), pa.int64()), pa.array(blobs, pa.binary())], ["part", "of_blocks", "block", "sums"])

    def add(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for k, group, x in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                    x = np.frombuffer(x, kind).astype(np.float64)
                    sums[k, group] = sums[k, group] + x if (k, group) in sums else x
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([0] * len(keys), pa.int64()), pa.array([g for _, g in keys], pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "of_blocks", "block", "sums"])

        return run

    schema = "part int, of_blocks long, block long, sums binary"
    made = dealt.filter("not held_out").groupBy("block").applyInArrow(steps, schema)
    # In a fixed order, so that the sums are the same whenever a task runs again.
    made = made.repartition("part", "of_blocks").sortWithinPartitions("part", "of_blocks", "block").mapInArrow(add("<f4"), schema)
    made = made.repartition("part").sortWithinPartitions("part", "block").mapInArrow(add("<f8"), schema)
    weights = model.weights.copy()
    with step(spark):
        for r in made.collect():
            sums, seen = np.frombuffer(r["sums"]).reshape(2, -1)
            some = seen > 0
            weights[r["part"] : r["part"] + len(seen)][some] = (sums[some] / (seen[some] + SHRINK)).astype(np.float32)
    return replace(model, weights=weights)


def _dealt(docs: DataFrame, held_out: F.Column) -> tuple[DataFrame, int, int]:
    """Rows with their blocks, the number of buckets, and the number of weights."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    with step(docs.sparkSession):
        n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_weights = LEAST_WEIGHTS
    while n_weights < min(n_bytes // BYTES_A_WEIGHT, MOST_WEIGHTS):
        n_weights *= 2
    name = F.xxhash64("doc_id", "text")
    return rows.withColumn("name", name).withColumn("block", F.pmod("name", F.lit(parts_for(n_bytes, BLOCK_BYTES, 8)))), parts_for(n_bytes, BUCKET_BYTES, 8), n_weights


def learn(dealt: DataFrame, told: DataFrame, n_weights: int, rounds: int = ROUNDS) -> Model:
    """The model of the training rows among ``dealt``, whose counts are ``told``."""
    with step(dealt.sparkSession):
        by_ending = {r["class"]: (r["n"], r["v"]) for r in told.filter("kind = 1").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
        top = told.filter("kind = 2").select("class", "hash", "n").orderBy(F.desc("n"), "hash").limit(SINGLES).collect()
    top.sort(key=lambda r: (r["class"], -r["n"], r["hash"]))
    n, v = (np.array([by_ending.get(k, (0, 0))[i] for k in range(ENDINGS)], np.float64) for i in range(2))
    sizes = int(n.sum()), int(v.sum())
    for r in top:
        n[r["class"]] -= r["n"]
        v[r["class"]] -= 1
    prior = np.concatenate([np.pad(np.array([r["n"] for r in top], np.float64), (0, SINGLES - len(top))), n]) + 1
    model = Model(*sizes, [r["hash"] for r in top], n + v + 1, prior, np.zeros(n_weights, np.float32))
    for _ in range(rounds):
        model = _averaged(dealt, model)
    return model


def score_documents(docs: DataFrame, held_out: F.Column, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Learns from the rows for which ``held_out`` is not true.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt, n_buckets, n_weights = _dealt(docs, held_out)
    told = cut(token_counts(dealt.select("block", "held_out", "text"), n_buckets))
    sent = docs.sparkSession.sparkContext.broadcast(learn(dealt.select("block", "name", "held_out", "text"), told, n_weights, rounds))

    def score(block: pa.Table, counts: pa.Table) -> pa.Table:
        m = sent.value
        t = _concatenated(block["text"].to_pylist())
        names, inverse = np.unique(t.hashes, return_inverse=True)
        of_name = np.zeros(len(names), np.int64)
        by_bucket = dict(zip(counts["bucket"].to_pylist(), counts["counts"].to_pylist(), strict=True))
        for b, i in _bucketed(names, n_buckets):
            of_name[i] = _from_planes(by_bucket[b], "<u8").astype(np.int64)
        c = of_name[inverse]
        n_tokens = np.bincount(t.owner, minlength=t.n_texts)
        base = np.bincount(t.owner, np.log10(c + 1.0), t.n_texts) - n_tokens * np.log10(m.n + m.v + 1.0)
        return pa.Table.from_arrays(
            [block["doc_id"], block["held_out"], pa.array(n_tokens, pa.int64()), pa.array(np.bincount(t.owner[c > 0], minlength=t.n_texts), pa.int64()), pa.array(np.full(t.n_texts, m.n), pa.int64()), pa.array(base), pa.array(m.score(t, c))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    replies = told.filter("kind = 0").select("block", "bucket", "counts")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.select("block", "doc_id", "held_out", "text").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, schema)
